import random
import re

import pytest

from shelfline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_rounds(sizes):
    """Targets as worded: share, stop at twice the source, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def make(spark, seed, n=200, sources=7):
    rng = random.Random(seed)
    names = ["é", "b", "a", "B", "", "日", None][:sources]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 3, 40, 300])
        rows.append((i, rng.choice(["", " ", "\n"]) + " \t".join(f"w{i}.{k}" for k in range(size)), names[min(int(rng.expovariate(0.7)), len(names) - 1)]))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize(("seed", "block"), [(1, 64), (2, 1000), (3, 7)])
def test_targets_and_words_taken(spark, seed, block):
    rows, docs = make(spark, seed)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text))
    want = by_rounds(sizes)
    got = mixing.mix_words(docs, block_words=block).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r["doc_id"]][1])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix_words(docs.repartition(5), block_words=block).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}


def test_the_mix_has_the_words_taken(spark):
    rows, docs = make(spark, 5)
    texts = {i: t for i, t, _ in rows}
    counted = {r["doc_id"]: r["taken"] for r in mixing.mix_words(docs, block_words=50).collect()}
    mixed = mixing.mix(docs, block_words=50)
    assert mixed.columns == ["doc_id", "text", "source", "slot"]
    words = {}
    for r in mixed.collect():
        assert r["text"] in texts[r["doc_id"]]
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert words == {d: n for d, n in counted.items() if n}


def test_schedule_spreads_every_source_evenly(spark):
    goals = spark.createDataFrame([("a", 600_000, 500_000.0), ("b", 400_000, 300_000.0), ("c", 900_000, 200_000.0)], "source string, source_size long, target double")
    slots = mixing.schedule(goals, block_words=100).collect()
    assert len(slots) == 10_000 and len({r["slot"] for r in slots}) == 10_000
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        own = sorted((r["slot"], r["rank"], r["words"]) for r in slots if r["source"] == source)
        assert [r for _, r, _ in own] == list(range(len(own))) and sum(w for _, _, w in own) == share * 1_000_000
        # at every place of the mix a source is within a few blocks of its share
        given = [slot for slot, _, _ in own if slot < 10_000]
        assert max(abs((k + 1) - share * (slot + 1)) for k, slot in enumerate(given)) < 8 and len(own) - len(given) < 8


def test_golden_points_are_exact(spark):
    from pyspark.sql import functions as F

    ids = [0, 1, 2, 12345, (1 << 31) - 1, 1 << 31, (1 << 40) + 77]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", mixing._golden("id").alias("u")).collect()
    assert {r["id"]: r["u"] for r in got} == {i: i * mixing.GOLDEN % (1 << 62) for i in ids}
    assert F is not None


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    got = mixing.mix_words(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix_words(no_docs).collect() == []
    mixed = mixing.mix(odd_docs)
    assert set(mixed.columns) == {*odd_docs.columns, "slot"}
    assert all(WORD.search(r["text"]) and r["n_chars"] == len(r["text"]) for r in mixed.collect())
    assert mixing.mix(no_docs).collect() == []
