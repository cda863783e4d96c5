import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfline.llm import conversation_repair as C
from shelfline.llm.queries import op12_wagner_fischer_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """Least (cost, audit) by walking all edits, kept by the last initial; no tables of targets."""

    def with_inserts(best):
        grown = True
        while grown:
            grown = False
            for last, (cost, audit) in list(best.items()):
                letter = "a" if last == "u" else "u"
                one = (cost + 3, audit + "I")
                if letter not in best or one < best[letter]:
                    best[letter], grown = one, True
        return best

    best = with_inserts({"": (0, "")})
    for row in rows:
        after = defaultdict(lambda: (10**9, ""))
        for last, (cost, audit) in best.items():
            after[last] = min(after[last], (cost + 4, audit + "D"))
            if row != "-":
                more = 3 if row.isupper() else 0
                for letter in AFTER[last]:
                    if letter == row.lower():
                        after[letter] = min(after[letter], (cost + more, audit + "K"))
                    elif letter != "s":
                        after[letter] = min(after[letter], (cost + more + 3, audit + "R"))
        best = with_inserts(dict(after))
    return min(best[last] for last in ("", "a") if last in best)


def expected(rows):
    """The query's row of one conversation, from its damaged rows in order."""
    seen, letters, counts = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        shown = text.rstrip(SPACE)
        fault = 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        first = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters.append("-" if fault in (1, 2) else first.upper() if fault == 3 else first)
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(letters)
    out, left, last = [], list(rows), ""
    for edit in audit:
        _, role, text = left.pop(0) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if last == "u" else "user"
        out.append(f"{role}:{text}")
        last = role[:1]
    assert not left
    return (gaps, *counts[1:], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return by_conv


def ordered(by_conv):
    """By turn; the tests have one text for each turn and role."""
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for k, v in by_conv.items()}


@pytest.mark.parametrize("chunk", [3, 64])
def test_least_cost_and_audit(monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    draw = random.Random(chunk)
    for _ in range(1500):
        rows = "".join(draw.choices("suaouauauaSUAO-", k=draw.randint(0, 14)))
        one = C.Aligner()
        for at in range(0, len(rows), 4):
            one.feed(rows[at : at + 4])
        assert one.finish() == cheapest(rows), rows


def test_band_holds_every_cheapest_path():
    """A bound on the cost changes nothing unless it is under the cost itself."""
    draw = random.Random(9)
    for _ in range(500):
        rows = "".join(draw.choices("suaoSU-", k=draw.randint(0, 8)))
        target = draw.choice(["", "ua", "sua", "uaua", "suaua", "uauaua"])
        free = C.align_to(rows, target, 10_000)
        assert C.align_to(rows, target, free[0]) == free if free else True
        if free:
            assert C.align_to(rows, target, free[0] - 1) is None


def test_long_conversation_in_linear_time():
    draw = random.Random(1)
    rows = "".join(draw.choices("uauauauauauaU-s", k=4000))
    one = C.Aligner()
    one.feed(rows)
    assert max(len(rest) for _, _, rest in one.best.values()) < 8  # what is carried beside the trail
    assert one.finish() == cheapest(rows)


def test_query_on_sample(spark, sample_dir):
    table = spark.read.parquet(f"{sample_dir}/conversations.parquet")
    want = {k: expected(v) for k, v in ordered(damage([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])).items()}
    got = op12_wagner_fischer_repair(spark, sample_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_odd_rows(spark, tmp_path):
    """Nulls, unknown and empty roles, white space only, ties, a long conversation, one damaged away, clashing names."""
    tied = next(i for i in range(100, 10_000) if zlib.crc32(f"{i}:1".encode()) % 20 > 4)
    dropped = next(i for i in range(100, 10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [
        (1, None, "user", "First."), (1, 0, None, "x."), (1, 1, "assistant", None), (1, 2, "tool", "Used."), (1, 3, "", "What?"),
        (2, 5, "system", "Be kind."), (2, 6, "system", "Be kind."), (2, 9, "user", "Hi!  \n"), (2, 12, "assistant", "Hi. "),
        (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (None, None, None, None),
        (tied, 1, "assistant", "a."), (tied, 1, "user", "b."), (tied, 1, "user", "b."), (tied, 2, "assistant", "c"),
        (4, None, None, None), (dropped, 0, "user", "Gone."),
    ]
    rows += [(5, t, "user" if t % 3 else "assistant", f"{t} " * (t % 50) + ".") for t in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("h", "code", "kind", "audit", "first", "step"):
        frame = frame.withColumn(name, F.lit(name))
    frame.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in op12_wagner_fischer_repair(spark, str(tmp_path)).collect()}
    want = {k: expected(v) for k, v in ordered(damage(rows)).items()}
    assert got == want
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_are_the_repaired_turns(spark):
    rows = [(1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "assistant", "c"), (1, 4, "assistant", "")]
    found, made = C.repair(spark.createDataFrame(rows, SCHEMA))
    plan = found.first()
    assert (plan.cost, plan.audit) == cheapest("uuA-")
    kept = [tuple(r) for r in made.where("edit <> 'D'").select("role", "text").collect()]
    assert [r[0] for r in kept] == ["user", "assistant"] * (len(kept) // 2)


def test_no_rows(spark):
    found, made = C.repair(spark.createDataFrame([], SCHEMA))
    assert found.count() == made.count() == C.digests(made).count() == 0
