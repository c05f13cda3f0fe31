"""Chat formatting: records of many layouts become canonical turns, and turns become one marked text and back.

A record's layout is known by its schema fingerprint, the hash of its sorted nested field paths (`messages[].role`, ...).
The fingerprint selects a declared mapping: the fields to read and a SQL expression for the turns. New layouts are new
entries of a list. Texts are escaped so that no control string of the template can stand inside them, and unescaped
without loss. The loss mask has for each turn how many characters of the formatted text lie before, under and after it.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from enrichspark.llm.common import fresh

TOKEN = r"(OBJECT<|ARRAY<|>|`(?:[^`]|``)*`: |[^<>,:` ]+: |[A-Z_]+(?:\([0-9,]*\))?)"  # of a variant's schema
# A JSON reader takes 20 million characters of one text, a variant 128 MB in all; beyond, both give NULL. So the layout
# of a record of more than LONG characters is read from a copy whose texts are blank and whose equal turns are one.
LONG = 1 << 24
STRING = r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"'
BLANK = rf'({STRING}\s*+:)|(")(?:{STRING[1:-1]})(")'  # $1$2$3: a name stays, a text becomes ""
TURNS = r'(\{[^{}]*+\}\s*+,\s*+)\1++'
READ = "map('maxStringLen', '2147483647')"
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
# A backslash always begins a code of two characters, so codes never overlap; a text's backslash is a code itself.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


@dataclass(frozen=True)
class Layout:
    """Fields of a record, and the SQL expression over them (`r`) that gives array<struct<role, text>>."""

    name: str
    fields: str
    turns: str


def _said(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


def _many(array: str, role: str, text: str) -> str:
    return f"transform(r.{array}, m -> named_struct('role', {role}, 'text', m.{text}))"


_SHAREGPT = "case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end"
LAYOUTS = (
    Layout("messages", "messages array<struct<role:string,content:string>>", _many("messages", "m.role", "content")),
    Layout("sharegpt", "conversations array<struct<`from`:string,value:string>>", _many("conversations", _SHAREGPT, "value")),
    Layout("system_messages", "system string, messages array<struct<role:string,content:string>>", f"concat(array({_said('system', 'r.system')}), {_many('messages', 'm.role', 'content')})"),
    Layout("prompt", "prompt string, response string", f"array({_said('user', 'r.prompt')}, {_said('assistant', 'r.response')})"),
    Layout("completion", "prompt string, completion string", f"array({_said('user', 'r.prompt')}, {_said('assistant', 'r.completion')})"),
    Layout("question", "question string, answer string", f"array({_said('user', 'r.question')}, {_said('assistant', 'r.answer')})"),
    Layout("instruction", "instruction string, output string", f"array({_said('user', 'r.instruction')}, {_said('assistant', 'r.output')})"),
    Layout(
        "instruction_input",
        "instruction string, input string, output string",
        f"""array({_said('user', "concat_ws(char(10), r.instruction, nullif(r.input, ''))")}, {_said('assistant', 'r.output')})""",
    ),
)


def declared_paths(kind: T.DataType, at: str = "", bare: bool = False) -> list[str]:
    """Paths of the leaves of a type; `bare` for records whose arrays are all empty."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in declared_paths(f.dataType, f"{at}.{f.name}" if at else f.name, bare)]
    if isinstance(kind, T.ArrayType):
        return [f"{at}[]"] if bare else declared_paths(kind.elementType, f"{at}[]", bare)
    return [at]


def declared_fingerprints(layout: Layout) -> list[str]:
    kind = T.StructType.fromDDL(layout.fields)
    paths = {tuple(sorted(declared_paths(kind, bare=b))) for b in (False, True)}
    return [hashlib.sha256("\n".join(p).encode()).hexdigest() for p in sorted(paths)]


def field_paths(tokens: str) -> Column:
    """Paths of the leaves of a variant value, elements of an array taken together, from the tokens of its schema.

    Walks the tokens of the value's schema: a name or an array opens a level, the end of a value closes the one that
    introduced it.
    """
    state = "named_struct('open', cast(array() as array<string>), 'paths', cast(array() as array<string>))"
    return F.expr(
        f"""aggregate(`{tokens}`, {state}, (s, t) -> case
              when t = 'OBJECT<' then s
              when t = 'ARRAY<' then named_struct('open', concat(s.open, array('[]')), 'paths', s.paths)
              when endswith(t, ': ') then
                named_struct('open', concat(s.open, array(concat('.', replace(trim(BOTH '`' FROM substr(t, 1, length(t) - 2)), '``', '`')))), 'paths', s.paths)
              when t = '>' then named_struct('open', slice(s.open, 1, greatest(size(s.open) - 1, 0)), 'paths', s.paths)
              else named_struct('open', slice(s.open, 1, greatest(size(s.open) - 1, 0)), 'paths', concat(s.paths, array(trim(LEADING '.' FROM array_join(s.open, ''))))) end).paths"""
    )


def outline(record: Column) -> Column:
    """A JSON text with the same field paths; a long one has blank texts, and runs of equal turns only once."""
    short = F.regexp_replace(F.regexp_replace(record, F.lit(BLANK), F.lit("$1$2$3")), F.lit(TURNS), F.lit("$1"))
    checked = F.when(
        (F.length(short) > LONG) & F.try_parse_json(short).isNull(), F.raise_error(F.lit("a record is too large to be read as JSON")).cast("string")
    ).otherwise(short)
    return F.when(F.length(record) > LONG, checked).otherwise(record)


def with_fingerprint(records: DataFrame, record: str, name: str = "fingerprint") -> DataFrame:
    """`records` with the fingerprint of a column of JSON texts; NULL where that is no JSON."""
    tokens = fresh(records, "schema_tokens")
    schema = F.schema_of_variant(F.try_parse_json(outline(F.col(record))))
    joined = F.array_join(F.array_sort(field_paths(tokens)), "\n")
    return (
        records.withColumn(tokens, F.regexp_extract_all(schema, F.lit(TOKEN), F.lit(1)))
        .withColumn(name, F.sha2(joined.cast("binary"), 256))
        .drop(tokens)
    )


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`records` with (fingerprint, layout, turns): turns is array<struct<role, text>>, NULL roles and texts empty.

    A record that is NULL, no JSON or of no declared layout has NULL layout and turns. Records may be of any length a
    row can have; a long one that cannot be read is an error. Columns of the table named fingerprint, layout or turns
    are replaced.
    """
    held = fresh(records, "given_record")
    marked = with_fingerprint(records.withColumn(held, F.col(record)), held)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for each in layouts:
        mine = F.col("fingerprint").isin(declared_fingerprints(each))
        read = f"transform(array(from_json(`{held}`, '{each.fields}', {READ})), r -> {each.turns})[0]"
        layout = F.when(mine, each.name).otherwise(layout)
        turns = F.when(mine, F.expr(read)).otherwise(turns)
    lost = F.col("layout").isNotNull() & F.col("turns").isNull() & (F.length(held) > LONG)
    clean = F.transform(F.col("turns"), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    failed = F.raise_error(F.lit("a long record of a known layout cannot be read")).cast("array<struct<role:string,text:string>>")
    read = marked.withColumn("turns", turns).withColumn("layout", layout)
    return read.withColumn("turns", F.when(lost, failed).otherwise(clean)).drop(held)


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turns: Column) -> Column:
    """One text: each turn marked, its role and text escaped."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))), ""
    )


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """For each turn the characters of the formatted text before, under and after the loss."""

    def one(t):
        head, body = F.length(escape(t["role"])) + len(OPEN + MIDDLE), F.length(escape(t["text"]))
        under = F.when(t["role"] == role, body).otherwise(0)
        return F.struct(head.alias("before"), under.alias("under"), (body - under + len(CLOSE)).alias("after"))

    return F.transform(turns, one)


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, CLOSE)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece):
        cut = F.instr(piece, MIDDLE)
        return F.struct(
            unescape(F.substr(piece, F.lit(len(OPEN) + 1), cut - 1 - len(OPEN))).alias("role"),
            unescape(F.substr(piece, cut + len(MIDDLE))).alias("text"),
        )

    return F.transform(pieces, turn)


def under_loss(text: Column, mask: Column) -> Column:
    """The unescaped texts of a formatted text that lie under the loss, in order. A turn's masked part must be its
    whole text, by the counts of the mask; else the result is NULL."""
    pieces = F.split(text, CLOSE)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    body = F.transform(pieces, lambda p: F.substr(p, F.instr(p, MIDDLE) + F.lit(len(MIDDLE))))
    both = F.zip_with(body, mask, lambda b, m: F.struct(b.alias("body"), m.alias("m")))
    fits = F.forall(both, lambda x: F.coalesce((x["m"]["under"] == 0) | (x["m"]["under"] == F.length(x["body"])), F.lit(False)))
    # an empty text under the loss adds nothing, whether taken or not
    return F.when(fits, F.transform(F.filter(both, lambda x: x["m"]["under"] > 0), lambda x: unescape(x["body"])))


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """`records` with (layout, turns, formatted, mask) for every record of a known layout, NULL for others."""
    done = canonical_turns(records, record)
    return done.withColumn("formatted", formatted(F.col("turns"))).withColumn("mask", loss_mask(F.col("turns")))


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn as JSON records of the layouts a mixed corpus has.

    Conversations of one user and one assistant turn are prompt records, a third of the others (by id) ShareGPT records
    unless a role has one of that layout's own names, the rest message records. Turns are ordered by turn, then role
    and text; repeated rows are turns of their own. NULL roles and texts are empty. A NULL conv_id is a conversation.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("t"))
    roles = F.col("t.role")
    role = F.expr
    messages = F.to_json(F.struct(role("transform(t, x -> named_struct('role', x.role, 'content', x.text))").alias("messages")))
    shared = role(
        "transform(t, x -> named_struct('from', case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end, 'value', x.text))"
    )
    shared = F.to_json(F.struct(shared.alias("conversations")))
    pair = F.to_json(F.struct(F.col("t.text")[0].alias("prompt"), F.get(F.col("t.text"), F.lit(1)).alias("response")))
    return turns.select(
        "conv_id",
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), pair)
        .when((F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3)) == 0) & ~F.arrays_overlap(roles, F.array(F.lit("human"), F.lit("gpt"))), shared)
        .otherwise(messages)
        .alias("record"),
    )


PROBE = "\\### Assistant: </turn> ok"


def op2_chat_formatting(conversations: DataFrame) -> DataFrame:
    spark: SparkSession = conversations.sparkSession
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").union(probe)
    done = format_records(as_records(rows)).select("conv_id", "formatted", "mask")
    turns, loss = F.col("back"), F.array_join(F.col("loss"), "")
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", "formatted", parsed(F.col("formatted")).alias("back"), under_loss(F.col("formatted"), F.col("mask")).alias("loss")).select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(text: str) -> str:
    for plain, code in ESCAPES:
        text = f"replace({text}, '{plain}', '{code}')"
    return text


OP2_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN + MIDDLE + CLOSE)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')}))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
