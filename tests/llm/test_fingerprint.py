import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import fingerprint as fp
from shelfline.llm.common import blocks


def entropy(window):
    counts = np.bincount(window)
    terms = sum(int(fp._TERMS[c]) for c in counts)
    return int((fp._TOP - terms) * (fp.LEVELS / fp._TOP))


def plain_features(data, ranks):
    """Features of one text by the definition, window by window."""
    if not data:
        return []
    array = np.frombuffer(data, np.uint8)
    n = len(array) - fp.WINDOW + 1
    rank = [ranks[entropy(array[i : i + fp.WINDOW])] for i in range(max(n, 0))] + [fp.LEVELS + 2] * min(fp.WINDOW - 1, len(array))
    wins = {}
    for i in range(max(n, 0)):
        best = min(range(i, i + fp.WINDOW), key=lambda k: (rank[k], k))
        wins[best] = wins.get(best, 0) + 1
    chosen = sorted(k for k, times in wins.items() if times >= fp.POPULAR and rank[k] <= fp.LEVELS)
    long = [data[k : k + fp.WINDOW] for k in chosen]
    short = plain_short(data) if len(data) < fp.SHORT_TEXT or not long else []
    return long + short or [data]


def plain_short(data):
    """Features of 16 bytes: windows that are the most varied of at least six neighbourhoods of 16."""
    n = len(data) - fp.SHORT + 1
    rank = [round(sum(np.log2(w.count(c)) for c in w) * 16) for w in (data[i : i + fp.SHORT] for i in range(max(n, 0)))]
    wins = {}
    for i in range(n - fp.SHORT + 1):
        best = min(range(i, i + fp.SHORT), key=lambda k: (rank[k], k))
        wins[best] = wins.get(best, 0) + 1
    return [data[k : k + fp.SHORT] for k in sorted(wins) if wins[k] >= fp.SHORT_POPULAR]


def texts(seed, n=12):
    rng = random.Random(seed)
    out = ["", "x", "short text", "a" * 300, "ab" * 100]
    for _ in range(n):
        out.append(" ".join("".join(rng.choices("abcdefghié", k=rng.randint(1, 9))) for _ in range(rng.choice([5, 30, 200]))))
    return out


def test_features_against_the_definition():
    values = texts(1)
    (block,) = blocks(pa.array(values, pa.string()))
    levels = fp._own_windows(block)
    ranks = fp.rarity(np.bincount(levels, minlength=fp.LEVELS + 1))
    hashes, at = fp.features(block, ranks)
    for i, value in enumerate(values):
        want = plain_features(value.encode(), ranks)
        assert at[i + 1] - at[i] == len(want)
        own = blocks(pa.array(want, pa.binary())) if want else []
        found = [h for b in own for h in fp.hash_spans(b.data, b.offsets[:-1], b.offsets[1:])]
        assert hashes[at[i] : at[i + 1]].tolist() == [int(h) for h in found]


def test_rarer_entropies_rank_first_and_dull_ones_never():
    counts = np.zeros(fp.LEVELS + 1, np.int64)
    counts[[50, 500, 700]] = [1, 10, 5]
    ranks = fp.rarity(counts)
    assert ranks[700] < ranks[500] and ranks[50] == fp.LEVELS + 1


def test_likeness():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    other = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    (a,), (b,) = fp.digests(hashes, np.array([0, 300])), fp.digests(other, np.array([0, 300]))
    (half,) = fp.digests(np.concatenate((hashes[:150], other[:150])), np.array([0, 300]))
    (none,) = fp.digests(hashes[:0], np.array([0, 0]))
    assert len(a) == 3 and fp.likeness(a, a) == 1
    assert fp.likeness(a, b) < 0.1 < fp.likeness(a, half) < 0.9
    assert fp.likeness(none, none) == 1 and fp.likeness(a, none) == 0


def brute(rows, ranks):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        chains = []
        for t in (text, edited, after):
            column = pa.array([t], pa.string())
            chains.append(next(iter(fp.digests(*fp.features(b, ranks))[0] for b in blocks(column))))
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(chains[0]), fp.as_text(chains[1]),
                  fp.likeness(chains[0], chains[1]), fp.likeness(chains[0], chains[2]))
    return out


@pytest.mark.parametrize("n", [1, 2, 60])
def test_compared_with_next(spark, n):
    rng = random.Random(n)
    values = (texts(n, 60) + [None])[:n] if n > 2 else texts(n)[-n:]
    rows = [(i * 7 - 20, t) for i, t in enumerate(values)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranks = fp.rarity(fp.entropy_counts(docs))
    got = {r["doc_id"]: tuple(r)[1:] for r in fp.compare_with_next(docs).collect()}
    assert got == brute(rows, ranks)


def test_equal_texts_have_equal_fingerprints(spark, odd_docs, no_docs):
    ranks = fp.rarity(fp.entropy_counts(odd_docs))
    marked = fp.fingerprint(odd_docs, ranks)
    rows = marked.collect()
    assert set(marked.columns) == {*odd_docs.columns, "fingerprint"} and len(rows) == odd_docs.count()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1
    assert {r["fingerprint"] for r in rows if not r["text"]} == {"0:"}
    compared = fp.compare_with_next(odd_docs).collect()
    assert len(compared) == odd_docs.count() and all(0 <= r["near_next"] <= 1 for r in compared)
    assert sorted(str(r["doc_id"]) for r in compared) == sorted(str(r["doc_id"]) for r in rows)
    assert fp.compare_with_next(no_docs).collect() == []


def test_short_texts_are_alike_as_far_as_they_agree():
    """A quarter replaced leaves a likeness, another text next to none, from a hundred bytes up."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(4000)]
    ranks = np.arange(fp.LEVELS + 1, dtype=np.int32)

    def chain(text):
        (block,) = blocks(pa.array([text]))
        return fp.digests(*fp.features(block, ranks))[0]

    for size in (100, 160, 250, 400, 700, 1000, 1100):
        edited, other = [], []
        for _ in range(20):
            a, b = (" ".join(rng.choices(words, k=300))[:size] for _ in "ab")
            edited.append(fp.likeness(chain(a), chain(a[: size - size // 4] + b[: size // 4])))
            other.append(fp.likeness(chain(a), chain(b)))
        assert min(edited) > 0.2 and np.mean(edited) > 0.45 and np.mean(other) < 0.1, (size, min(edited), np.mean(edited), np.mean(other))
