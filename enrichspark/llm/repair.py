"""Repair of conversations whose rows were lost, repeated, blanked, cut or given to the wrong speaker.

The repaired roles are nothing, or an optional system turn and then user and assistant in turn. Each row is kept, given
to the role that is due, or deleted, and empty turns may be inserted before it; the cheapest edits are found by Viterbi
over four states, the last role so far. Ties go to the edits whose initials come first as text.

Paths are a tree of backpointers with reference counts. A row makes a node for each state that a path survives in; nodes
no survivor leads to are freed, and states that cost more than others could ever catch up with survive no longer. Once
the root has one child, all survivors share it: its edits are final, are given out, and their rows forgotten. So memory
follows what is unresolved, not the conversation. Tied paths are compared by all of their unresolved edits: survivors are
kept in the order of these, so two paths compare by the order of what they extend, then by what they add. (Every path
ends in the edit of one and the same row, and inserts come before it, so no path is the beginning of another.)

Faults are found on columns; what one conversation needs in order goes through one task as a sorted stream, because its
digest is one chain, and no task holds more than the unresolved rows of one conversation. (Those are few, but for one
speaker alone: which rows change role then depends on how many come, and all stay unresolved.)
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # what each edit costs, and an undeleted truncated row
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # the last role given out
NAMES = {USER: "user", ASSISTANT: "assistant"}
DUE = (USER, USER, ASSISTANT, USER)  # what comes after each state, unless a system turn opens
INITIAL = {"u": USER, "a": ASSISTANT}
BLANKS = " \t\n\x0b\f\r"
SOUND, BLANK, TRUNCATED = range(3)
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "turn long, role string, text string, edit string"
BATCH = 1 << 20  # characters of repaired turns given out at a time


class Node:
    """Edits of one row, and of the turns inserted before it; `parent` leads to the row before."""

    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.children = parent, edits, []


class Walk:
    """Viterbi over one conversation: rows go in one by one, edits come out through `emit` as soon as they are certain."""

    def __init__(self, emit: Callable[[str, str | None, str | None], None]):
        self.emit = emit  # (initial of the edit, role, text); no role for what is deleted
        self.root = Node(None, "")
        # by state: cost, order among all survivors of the initials of its unresolved edits, last node
        self.survivors: dict[int, tuple[int, int, Node]] = {NOTHING: (0, 0, self.root)}
        self.rows: deque[tuple[str, str]] = deque()  # those whose edits are unresolved
        self.state = NOTHING  # at the root

    def step(self, role: str, text: str, delete: bool, cut: bool) -> None:
        """One more row; `delete` if it has to go, `cut` if it costs more unless it goes."""
        self.rows.append((role, text))
        best: dict[int, tuple[int, int, str, Node]] = {}  # cost, order, added edits, what they are added to

        def offer(state: int, *path) -> None:
            if state not in best or path[:3] < best[state][:3]:
                best[state] = path

        extra, initial = CUT if cut else 0, role[:1]
        for state, (cost, order, node) in self.survivors.items():
            inserted = ""
            # up to two inserts lead to any state once
            for _ in range(3 if state in (NOTHING, SYSTEM) else 2):
                offer(state, cost + DELETE, order, inserted + "D", node)
                if not delete:
                    due = DUE[state]
                    if INITIAL.get(initial) == due:
                        offer(due, cost + KEEP + extra, order, inserted + "K", node)
                    elif initial == "s" and state == NOTHING:
                        offer(SYSTEM, cost + KEEP + extra, order, inserted + "K", node)
                    offer(due, cost + REROLE + extra, order, inserted + "R", node)
                state, cost, inserted = DUE[state], cost + INSERT, inserted + "I"
        before = [node for _, _, node in self.survivors.values()]
        self.survivors = {}
        ordered = sorted(best.items(), key=lambda x: x[1][1:3])
        for place, (state, (cost, _, edits, node)) in enumerate(ordered):
            if not hopeless(state, cost, best):
                child = Node(node, edits)
                node.children.append(child)
                self.survivors[state] = cost, place, child
        for node in before:
            while not node.children and node.parent:  # nothing survives through it
                node.parent.children.remove(node)
                node = node.parent
        while len(self.root.children) == 1 and self.rows:  # the survivors share what comes next
            self.root = self.root.children[0]
            self.root.parent = None
            self._give(self.root.edits)

    def finish(self) -> int:
        """Gives out what is left; the cost of all edits."""
        tails = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        cost, _, tail, node = min(
            (cost + INSERT * len(tails[state]), order, tails[state], node) for state, (cost, order, node) in self.survivors.items()
        )
        path = [tail]
        while node is not self.root:
            path.append(node.edits)
            node = node.parent
        for edits in reversed(path):
            self._give(edits)
        return cost

    def _give(self, edits: str) -> None:
        for edit in edits:
            role, text = (None, "") if edit == "I" else self.rows.popleft()
            if edit == "D":
                self.emit(edit, None, None)
                continue
            if edit == "K" and role[:1] == "s":
                self.state = SYSTEM
            else:
                self.state = DUE[self.state]
            self.emit(edit, role if edit == "K" else NAMES[self.state], text)


# what is left costs at most this more from the second state than from the first: DETOUR[first][second]
DETOUR = {
    NOTHING: {SYSTEM: 6, USER: 7, ASSISTANT: 4},  # a system row not taken is deleted; a turn begun is completed
    SYSTEM: {NOTHING: 0, USER: 3, ASSISTANT: 0},
    USER: {NOTHING: 3, SYSTEM: 3, ASSISTANT: 3},
    ASSISTANT: {NOTHING: 0, SYSTEM: 6, USER: 3},
}


def hopeless(state: int, cost: int, best: dict[int, tuple]) -> bool:
    """Whether another state is so much cheaper that no path through this one can be among the cheapest."""
    return any(other != state and cost > best[other][0] + DETOUR[state][other] for other in best)


class Conversation:
    """What is counted of one conversation, and its repair."""

    def __init__(self, key, emit=None):
        self.key, self.also = key, emit
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self.walk = Walk(self.emit)

    def emit(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]
        if role is not None:
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1
        if self.also:
            self.also(self.key, self.lines, role, text, edit)

    def add(self, turn: int | None, role: str, text: str, fault: int, again: bool) -> None:
        this = (turn, role, text)
        again = again or this == self.last  # equal rows of one turn are neighbours
        if turn is not None and (self.high is None or turn > self.high):
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = this
        cut = fault == TRUNCATED and not again
        self.blank += fault == BLANK
        self.duplicate += again and fault != BLANK
        self.truncated += cut
        self.walk.step(role, text, again or fault == BLANK, cut)

    def summary(self) -> tuple:
        cost = self.walk.finish()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


def faulty(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone) with `fault` (blank, truncated) and `again`: role and text came in an earlier turn.

    The first turns of repeated rows are found by role and digest of the text, folded in each task before they move.
    """
    ends = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ends == "", BLANK).when(~F.substring(ends, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    rows = rows.select("conv", "turn", "role", "text", "gone", fault.alias("fault"), F.sha2("text", 256).alias("digest"))
    firsts = (
        rows.filter("not gone")
        .groupBy("conv", "role", "digest")
        .agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.bool_or(F.col("turn").isNull()).alias("unknown"))
        # what comes in one turn only needs no flag
        .filter("low < high or (unknown and low is not null)")
        .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "low", "unknown")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.when(F.col("unknown"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("low"))
    return rows.join(firsts, same, "left").select("conv", "turn", "role", "text", "gone", "fault", F.coalesce(later, F.lit(False)).alias("again"))


def _walked(rows: DataFrame, fields: str, kind: str, collect: type[Rows]) -> DataFrame:
    """Conversations as sorted streams through `collect()`: its `begin(key)`, `end(conversation)` and `rows`."""
    ordered = faulty(rows).repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    out = rows.sparkSession.createDataFrame([], f"conv {kind}, {fields}").schema

    def walk(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)

        def batch_of(given):
            columns = zip(*given) if given else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

        sink, now = collect(), None
        for batch in batches:
            for conv, turn, role, text, gone, fault, again in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.key != conv:
                    if now is not None:
                        sink.end(now)
                    now = sink.begin(conv)
                if not gone:
                    now.add(turn, role, text, fault, again)
                if sink.held > BATCH:
                    yield batch_of(sink.taken())
            yield batch_of(sink.taken())
        if now is not None:
            sink.end(now)
            yield batch_of(sink.taken())

    return ordered.mapInArrow(walk, out)


class Rows:
    """Rows to give out, and about how many characters they hold."""

    def __init__(self):
        self.rows, self.held = [], 0

    def taken(self) -> list[tuple]:
        rows, self.rows, self.held = self.rows, [], 0
        return rows


class Summaries(Rows):
    def begin(self, key) -> Conversation:
        return Conversation(key)

    def end(self, conversation: Conversation) -> None:
        self.rows.append((conversation.key, *conversation.summary()))
        self.held += len(self.rows[-1][-2])


class Turns(Rows):
    def begin(self, key) -> Conversation:
        return Conversation(key, self.put)

    def put(self, key, n: int, role: str | None, text: str | None, edit: str) -> None:
        if role is not None:
            self.rows.append((key, n - 1, role, text, edit))
            self.held += len(text) + 16

    def end(self, conversation: Conversation) -> None:
        conversation.summary()


def _plain(conversations: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    blank = F.lit(" ")
    return conversations.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"),
        F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"),
    )


def repairs(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation.

    Rows are taken by turn, NULL turns first, and within a turn by role and text. NULL roles and texts are one space, a
    NULL conversation is one like others. Rows of which `gone` holds only name their conversation, which has zeros and
    empty texts if it has no other. Roles count by their initials; a role that is empty has none and cannot be kept. Repeated rows are duplicates. Texts are read whole.
    An empty table gives an empty one; other columns are not read.
    """
    kind = conversations.schema[conv].dataType.simpleString()
    return _walked(_plain(conversations, conv, turn, role, text, gone), SUMMARY, kind, Summaries)


def repaired_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, edit): the turns of the repaired conversations, numbered from 0; edges as in `repairs`."""
    kind = conversations.schema[conv].dataType.simpleString()
    return _walked(_plain(conversations, conv, turn, role, text, gone), TURNS, kind, Turns)


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults chosen by the crc32 of conversation and turn; dropped rows stay, as `gone`."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), blank), F.coalesce(F.col("role"), blank)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("gone"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def op13_conversation_repair(conversations: DataFrame) -> DataFrame:
    return repairs(damaged(conversations), gone=F.col("gone")).withColumnRenamed("conv", "conv_id")
