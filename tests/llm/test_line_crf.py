import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from shelfline.llm import line_crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the definitions."""
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


def test_counts_against_the_definitions(spark):
    rng = random.Random(8)
    pieces = ["a", "b", "é", "B", "#x", "|", "<p>", "\n", "\n\n", " ", "\t", "\r\n", "日本", "%%"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.choice([0, 1, 5, 40, 150])))) for i in range(150)]
    rows.append((999, None))
    got = line_crf.measure_quality(spark.createDataFrame(rows, "doc_id long, text string"), line_crf.Field.neutral()).collect()
    for r in got:
        want = plain(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["text"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])  # the neutral field holds all lines for content


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    width = len(line_crf.FEATURES)
    field = line_crf.Field(rng.normal(size=(width + 1, 2)), rng.normal(size=(2, 2)) * 2)
    sizes = [1, 7, 3, 1, 5]
    rows = rng.random((sum(sizes), width)) < 0.4
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    got = field.viterbi(rows, bounds)
    score = rows @ field.emission[:-1] + field.emission[-1]
    for a, b in zip(bounds[:-1], bounds[1:]):
        def total(labels):
            return sum(score[a + t, y] for t, y in enumerate(labels)) + sum(field.transition[x, y] for x, y in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=b - a), key=total)
        assert tuple(got[a:b]) == best


def test_fit_tells_the_labels_apart():
    rng = np.random.default_rng(2)
    width = len(line_crf.FEATURES)
    data = [(np.hstack([np.full((n, 1), y, bool), rng.random((n, width - 1)) < 0.3]), y) for y in (0, 1) for n in (1, 2, 4, 6) * 5]
    field = line_crf.fit(data)
    rows = np.concatenate([x for x, _ in data])
    bounds = np.concatenate(([0], np.cumsum([len(x) for x, _ in data])))
    want = np.concatenate([np.full(len(x), y) for x, y in data])
    assert (field.viterbi(rows, bounds) == want).all()
    assert (field.transition[[0, 1], [0, 1]] > field.transition[[0, 1], [1, 0]]).all()


def documents(spark):
    rng = random.Random(3)

    def prose():
        return "\n".join(" ".join(rng.choices("the cat sat on a mat and it was warm there".split(), k=12)).capitalize() + f" {rng.random()}." for _ in range(9))

    def junk():
        return "\n".join(" | ".join(str(rng.random()) for _ in range(12)) for _ in range(9))

    rows = [(i, junk() if i % 3 == 0 else prose()) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(80)], "doc_id long, quality int")


def test_learned_field_keeps_prose_and_drops_junk(spark):
    docs, labels = documents(spark)
    got = line_crf.measure_quality(docs, line_crf.train(docs, labels)).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 != 0) for r in got if not r["base_failed"])
    assert sum(r["kept"] for r in got) > 60


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    docs, labels = documents(spark)
    field = line_crf.train(docs, labels)
    got = line_crf.measure_quality(odd_docs, field)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= set(got.columns)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] != 5)
    assert [r["n_words"] for r in rows if r["doc_id"] == 5] == [100_000]
    assert line_crf.measure_quality(no_docs, field).collect() == []
    assert line_crf.train(no_docs, labels).emission.tolist() == line_crf.Field.neutral().emission.tolist()


def test_mixed_texts_are_labelled_line_by_line(spark):
    """Good and bad texts joined at a line's end, never seen like that in training."""
    docs, labels = documents(spark)
    field = line_crf.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.where("doc_id >= 80").collect()}
    junk, prose = ([t for i, t in sorted(texts.items()) if (i % 3 == 0) == bad] for bad in (True, False))
    rows = [(k, "\n".join(pieces)) for k, pieces in enumerate([(j, p), (p, j), (p, j, q)][k % 3] for k, (j, p, q) in enumerate(zip(junk, prose, prose[1:])))]
    got = line_crf.measure_quality(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()
    for r in got:
        want = sum(len(WORD.findall(line)) for line in r.text.split("\n") if "|" not in line)
        assert r.content_words == want and 0 < want < r.n_words


def test_long_training_texts_are_cut_not_left_out(spark):
    docs, labels = documents(spark)
    whole = docs.groupBy().agg(F.array_join(F.collect_list(F.when(F.col("doc_id") % 3 == 0, F.col("text"))), "\n").alias("junk"),
                               F.array_join(F.collect_list(F.when(F.col("doc_id") % 3 != 0, F.col("text"))), "\n").alias("prose"))
    two = whole.select(F.explode(F.array(F.struct(F.lit(0).alias("doc_id"), F.col("junk").alias("text")), F.struct(F.lit(1).alias("doc_id"), F.col("prose").alias("text")))).alias("d")).select("d.*")
    field = line_crf.train(two, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in line_crf.measure_quality(docs, field).collect() if not r.base_failed}
    assert kept and all(keep == (i % 3 != 0) for i, keep in kept.items())


def test_joined_sequences_change_in_both_directions():
    pieces = [(np.full((n, 2), y), y) for y, sizes in ((0, (1, 2)), (1, (3, 1, 4, 1, 5))) for n in sizes]
    found = line_crf.joined(pieces)
    assert len(found) == 7 + 2 * 5
    for x, y in found:
        assert (x[:, 0] == y).all()
    changes = {tuple(y[[0, -1]]) for _, y in found[7:]}
    assert changes == {(0, 1), (1, 0)}
