import math

import numpy as np
import pytest

from shelfline.llm import embedding_dup as E

SCHEMA = "vec_id long, embedding array<double>, c string, key string, ball string, n string"


def near(rng, base, cosine):
    """A unit vector at exactly about this cosine from ``base``."""
    other = rng.standard_normal(len(base))
    other -= (other @ base) * base
    other /= np.linalg.norm(other)
    return cosine * base + math.sqrt(1 - cosine * cosine) * other


def unit(rng, dim=32):
    x = rng.standard_normal(dim)
    return x / np.linalg.norm(x)


def brute_force(vectors, cosine):
    """Links and components of {id: vector}, by comparing all."""
    ids = sorted(vectors)
    links = {i: [j for j in ids if j != i and _cosine(vectors[i], vectors[j]) >= cosine] for i in ids}
    component = {i: i for i in ids}
    for start in ids:
        todo = [start]
        while todo:
            i = todo.pop()
            for j in links[i]:
                if component[j] > component[start]:
                    component[j] = component[start]
                    todo.append(j)
    return {i: (len(links[i]), component[i], component[i] == i) for i in ids}


def _cosine(x, y):
    x, y = np.array(x, float), np.array(y, float)
    return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))


def frame(spark, vectors):
    rows = [(i, [float(x) for x in v], "x", "y", "z", "w") for i, v in vectors.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("crowd,crowded,held", [(256, 512, 512), (4, 4, 8)])
def test_equals_brute_force(spark, monkeypatch, crowd, crowded, held):
    """Copies, scaled copies, chains, a dense group and pairs on both sides of the threshold."""
    monkeypatch.setattr(E, "CROWD", crowd)
    monkeypatch.setattr(E, "CROWDED", crowded)
    monkeypatch.setattr(E, "HELD", held)
    rng = np.random.default_rng(5)
    rows = [unit(rng) for _ in range(150)]
    rows += [rows[0], rows[0], rows[1] * 1000, rows[2] * 1e-12]
    rows += [near(rng, rows[3], c) for c in (0.905, 0.93, 0.96, 0.895, 0.88, 0.99)]
    rows += [near(rng, rows[4], 0.99) for _ in range(60)]  # one ball
    rows += [near(rng, rows[5], 0.955) for _ in range(60)]  # around the threshold among themselves
    for _ in range(8):  # a chain
        rows.append(near(rng, rows[-1], 0.93))
    vectors = dict(zip(rng.permutation(len(rows) * 2)[: len(rows)].tolist(), rows, strict=True))
    want, got = brute_force(vectors, 0.9), result(E.near_duplicates(frame(spark, vectors)))
    assert got.keys() == want.keys()
    assert sum(n for n, _, _ in want.values()) > 5000
    assert got == want


def test_recall_at_the_threshold_and_none_below(spark, monkeypatch):
    monkeypatch.setattr(E, "CROWD", 16)
    rng = np.random.default_rng(11)
    vectors, linked = {}, 0
    for k in range(600):
        base, cosine = unit(rng, 24), rng.choice([0.9005, 0.8995])
        vectors[2 * k], vectors[2 * k + 1] = base, near(rng, base, cosine)
        linked += cosine > 0.9
    got = result(E.near_duplicates(frame(spark, vectors)))
    found = sum(got[2 * k + 1][1] == 2 * k for k in range(600))
    assert linked * 0.99 <= found <= linked


def test_family_keeps_its_miss_rate_at_any_size():
    for n in (10, 10_000, 10_000_000, 10**10):
        f = E.family(n, 0.9)
        missed = (1 - E.meets(math.sqrt(0.2), f.width) ** f.rows) ** f.tables
        assert missed <= E.MISS
        assert n * E.meets(math.sqrt(2), f.width) ** f.rows <= E.CROWD


def test_chance_to_meet():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal(200_000), rng.random(200_000)
    for distance in (0.2, 0.5, 1.4):
        met = (np.floor(b) == np.floor(a * distance / 1.7 + b)).mean()
        assert abs(met - E.meets(distance, 1.7)) < 0.005


def test_unusable_vectors_are_linked_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v), (1, v), (2, v), (3, None), (4, None), (5, []), (6, []), (7, [0.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0]),
        (9, [1.0, None, 3.0]), (10, [1.0, None, 3.0]), (11, [1.0, float("nan"), 3.0]), (12, [1.0, float("inf"), 3.0]),
        (None, v), (None, None), (13, [1.0, 2.0, 3.0, 0.0]), (14, [1e200, 2e200, 3e200]), (15, [1e-200, 2e-200, 3e-200]),
        (16, [-1.0, -2.0, -3.0]), (17, [0.0, -0.0, 5.0]), (18, [-0.0, 0.0, 5.0]),
    ]
    df = spark.createDataFrame([(i, e) for i, e in rows], "vec_id long, embedding array<double>")
    out = E.near_duplicates(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str)
    single = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 16)]
    group = [(i, 3, 1, i == 1) for i in (1, 1, 2, 14, 15)]
    want = [*single, *group, (17, 1, 17, True), (18, 1, 17, False), (None, 0, None, True), (None, 0, None, True)]
    assert rows == sorted(want, key=str)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_all_alike(spark):
    vectors = {i: [1.0, 1.0] for i in range(3000)}
    out = E.near_duplicates(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>"))
    assert {(r.n_links, r.component_id) for r in out.collect()} == {(2999, 0)}
