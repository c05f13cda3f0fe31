"""Repairs beside a search through all edits."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from enrichspark.llm import repair

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = "\x20\t\n\x0b\f\r"


def faults(rows):
    """Plain reading of (turn, role, text) rows."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows, wrong):
    """(cost, edits, repaired) by trying every edit of every row and up to two inserts in every gap."""
    whole, begun = re.compile("(s?(ua)+)?"), re.compile("(s?(ua)*u?)?")
    paths = [(0, "", ())]
    for k in range(len(rows) + 1):
        after = []
        for cost, edits, out in paths:
            for n in range(3):
                for added in itertools.product(("user", "assistant"), repeat=n):
                    c, e, o = cost + 3 * n, edits + "I" * n, out + tuple((r, "") for r in added)
                    if k == len(rows):
                        after.append((c, e, o))
                        continue
                    _, role, text = rows[k]
                    after.append((c + 4, e + "D", o))
                    if wrong[k] not in ("blank", "duplicate"):
                        more = 3 * (wrong[k] == "truncated")
                        after.append((c + more, e + "K", o + ((role, text),)))
                        after += [(c + 3 + more, e + "R", o + ((r, text),)) for r in ("user", "assistant")]
        paths = [p for p in after if begun.fullmatch("".join(r[:1] or "-" for r, _ in p[2]))]
        least = min(p[0] for p in paths)
        paths = [p for p in paths if p[0] <= least + 14]  # no state is more than that from another
    done = [p for p in paths if whole.fullmatch("".join(r[:1] or "-" for r, _ in p[2]))]
    return min(done, key=lambda p: (p[0], p[1]))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    wrong = faults(rows)
    cost, edits, out = all_repairs(rows, wrong)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, *(wrong.count(w) for w in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())


def walked(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    out = []
    talk = repair.Conversation(1, lambda key, n, role, text, edit: out.append((role, text)))
    for (turn, role, text), wrong in zip(rows, faults(rows)):
        talk.add(turn, role, text, {"blank": 1, "truncated": 2}.get(wrong, 0), wrong == "duplicate")
    return talk.summary()


TEXTS = ["Yes.", "No!", "cut off", "", " \n", "Why? ", "Same."]


def test_every_edit_tried():
    rng = random.Random(2)
    for k in range(1500):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["system", "tool", "user", " ", ""], ["user"], ["system"]])
        texts = rng.choice([TEXTS, ["Fine."] + [f"t{i}." for i in range(9)], ["", "Same."]])
        rows = [(rng.choice([i, i, i, None]) if k % 7 == 0 else i, rng.choice(roles), rng.choice(texts)) for i in range(rng.randrange(6))]
        assert walked(rows) == expected(rows), rows


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        held = out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        held += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def test_query_equals_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect() if r.conv_id % 3]
    rng = random.Random(8)
    sizes = {c: sum(r[0] == c for r in rows) for c in {r[0] for r in rows}}
    rows = [r for r in rows if sizes[r[0]] <= 9]
    for conv in range(1000, 1200):
        for i in range(rng.randrange(1, 7)):
            rows.append((conv, rng.choice([i, i, i + 3, None]), rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice([*TEXTS, None])))
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (None, None, None, None)]
    want = {c: expected(r) for c, r in damage(rows).items()}
    given = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as fault", "'x' as gone", "3 as `a.b`").repartition(5)
    got = repair.op13_conversation_repair(given)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert found == want and len(found) > 200
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert any(v == empty for v in found.values())
    assert repair.op13_conversation_repair(given.limit(0)).count() == 0


def test_turns_hash_to_the_summary(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    broken = repair.damaged(rows)
    turns, digests = {}, {r.conv: r for r in repair.repairs(broken, gone=broken["gone"]).collect()}
    for r in sorted(repair.repaired_turns(broken, gone=broken["gone"]).collect(), key=lambda r: (r.conv, r.turn)):
        turns.setdefault(r.conv, []).append(r)
    for conv, r in digests.items():
        mine = turns.get(conv, [])
        assert [t.turn for t in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in mine).encode()).hexdigest() == r.repaired_sha256
        assert "".join(t.edit for t in mine) == r.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in mine))


@pytest.mark.parametrize("kind", ["good", "noise"])
def test_memory_follows_what_is_unresolved(kind):
    """Of a long conversation only a few rows are held at any time."""
    rng, most, given = random.Random(1), 0, 0

    def emit(*_):
        nonlocal given
        given += 1

    walk = repair.Walk(emit)
    for i in range(20000):
        role = {"good": ("user", "assistant")[i % 2], "noise": rng.choice(["user", "assistant", "system"])}[kind]
        walk.step(role, "text", kind == "noise" and rng.random() < 0.3, kind == "noise" and rng.random() < 0.3)
        most = max(most, len(walk.rows))
    assert most < 60 and given > 19000
    walk.finish()
    assert not walk.rows


def test_very_long_texts_and_hot_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)] + [(1, 3000, "user", "x" * 3_000_000 + ".")]
    rows += [(1, i, "user", "Again and again.") for i in range(4000, 5000)]
    got = repair.repairs(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(got) == 1 and got[0].duplicate == 999 and got[0].gaps == 999
    # of two users in a row one becomes the assistant
    assert got[0].cost == 4 * 999 + 3 and got[0].audit.startswith("K" * 3001 + "R")


def test_two_ways_tied_to_the_end():
    """One speaker alone: which rows change role depends on how many there are, so all stay unresolved."""
    for n in (30_000, 30_001):
        talk = repair.Conversation(1)
        for i in range(n):
            talk.add(i, "user", f"t{i}.", 0, False)
        audit = talk.summary()[-2]
        assert audit.count("K") + audit.count("R") == n
    for n in range(1, 7):
        rows = [(i, "user", f"t{i}.") for i in range(n)]
        assert walked(rows) == expected(rows)
