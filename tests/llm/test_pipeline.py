import pytest
from compare import compare, connect

import __spark_entry__ as contract
import corpus_pipeline
from shelfline.llm import line_crf, mixing, near_dup, queries
from shelfline.llm.common import table


def test_registered():
    registered = contract.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "minhash near-dedup", "mixing", "packing"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sample_dir, name):
    rows, different, sample = compare(spark, connect(sample_dir), sample_dir, queries.QUERIES[name], queries.SQL[name])
    assert rows and not different, sample


def test_stages_take_effect(spark, sample_dir):
    docs = table(spark, sample_dir, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.saved(stage(spark, before, sample_dir), "stage")
        if name != "packing":
            assert after.columns == columns and after.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        if name == "quality rules":
            field = line_crf.train(docs, table(spark, sample_dir, "labels"))
            assert after.count() == line_crf.measure_quality(before, field).where("kept").count() < before.count()
        if name == "minhash near-dedup":
            found = near_dup.near_duplicates(after).collect()
            assert all(r["kept"] for r in found) and len(found) == len({r["doc_id"] for r in found})
            assert {r["doc_id"] for r in found} == {r["component_id"] for r in near_dup.near_duplicates(before).collect()}
        if name == "mixing":
            assert {r[0] for r in after.select("doc_id").distinct().collect()} <= {r[0] for r in before.select("doc_id").collect()}
        if name == "packing":
            assert {r[0] for r in after.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").distinct().collect()}
        before = after


def test_stages_stand_empty_and_odd_tables(spark, sample_dir, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sample_dir).collect() == []
        out = stage(spark, odd_docs, sample_dir)
        out.collect()
        if stage is not corpus_pipeline.pack_sequences:
            assert out.columns == odd_docs.columns


def test_sequences_follow_the_mix(spark, sample_dir):
    # ids follow sources; b and c are taken more than once
    rows = [(i, f"{s}{i} " + "word " * 199, "en", s, 0) for s, lo, hi in (("a", 0, 400), ("b", 400, 480), ("c", 480, 500)) for i in range(lo, hi)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    slots = {(r["doc_id"], r["slot"]) for r in mixing.mix(docs).select("doc_id", "slot").collect()}
    mixed = corpus_pipeline.saved(corpus_pipeline.mix_sources(spark, docs, sample_dir), "mixed")
    pieces = corpus_pipeline.pack_sequences(spark, mixed, sample_dir).where("start = 0").orderBy("sequence_id", "offset").collect()
    order = [p["doc_id"] for p in pieces]
    assert order == [d for d, _ in sorted(slots, key=lambda x: (x[1], x[0]))]
    source = ["a" if d < 400 else "b" if d < 480 else "c" for d in order]
    turns = sum(x != y for x, y in zip(source, source[1:]))
    assert turns > 20  # by doc_id there would be two
    last, twice = {}, 0
    for k, d in enumerate(order):
        assert d not in last or k - last[d] > 20
        twice += d in last
        last[d] = k
    assert twice > 50
