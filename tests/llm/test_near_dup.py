import random
import re

import pytest

from shelfline.llm import near_dup
from shelfline.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(rows, width, percent):
    """Components by comparing all pairs."""
    sets = [(d, sets_of(t, width)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}
    changed = True
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def edited(words, rng, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_against_all_pairs(spark, width):
    rng = random.Random(width)
    rows, doc = [], 0
    for _ in range(25):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([5, 12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((doc, " ".join(edited(base, rng, rng.randrange(1 + len(base) // 25 + 1)))))
            doc += rng.randrange(1, 4)
    shared = [f"s{i}" for i in range(60)]  # a passage in otherwise different texts
    for _ in range(30):
        rows.append((doc, " ".join(shared + [f"x{rng.randrange(10**6)}" for _ in range(30)])))
        doc += 1
    chain = [f"c{i}" for i in range(100)]
    for k in range(0, 40, 4):  # neighbours alike, ends not
        rows.append((doc, " ".join(chain[k : k + 60])))
        doc += 1
    rng.shuffle(rows)
    want = brute(rows, width, 80)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(sets_of(t, width)) for d, t in rows}


def test_odd_rows(spark, odd_docs):
    got = near_dup.near_duplicates(odd_docs, width=4).collect()
    assert len(got) == odd_docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by_id[1]] == [1, 1] and all(r["kept"] for r in by_id[1])
    assert all(r["component_id"] is None and r["kept"] for r in by_id[None])
    assert by_id[3][0]["n_shingles"] == by_id[4][0]["n_shingles"] == 0 and by_id[4][0]["kept"]
    assert by_id[5][0]["n_shingles"] == 5


def test_empty_table(spark, no_docs):
    assert near_dup.near_duplicates(no_docs).collect() == []
    assert near_dup.without_duplicates(no_docs).collect() == []


def test_one_of_each_group_stays(spark, odd_docs):
    kept = near_dup.without_duplicates(odd_docs, width=4)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None", "None"]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 260)}, 7: 7, 3: 3}
