"""A training corpus from raw documents: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes every
stage's result and reads it back as the next one's documents.  Models are trained
on the labelled rows of the input folder, everything else on what the stage gets.

Rows with nulls, empty or repeated texts go through each stage as the operator's
docstring says; in the end a document without words is in no sequence, for it
fails the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import line_crf, mixing, near_dup, packing, toxicity
from shelfline.llm.common import reachable, saved, table
from shelfline.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two language models do not hold for toxic."""
    scorer = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, scorer).where("not toxic").select(docs.columns)


def keep_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and consist mostly of content lines."""
    field = line_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return line_crf.measure_quality(docs, field).where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80%)."""
    reachable(spark)
    return near_dup.without_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each time, in the mix's order."""
    reachable(spark)
    return mixing.mix(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 token ids, documents in the order the mix was written in."""
    reachable(spark)
    return packing.pack(packing.as_written(docs, "_place"), tokenizer=tokenizer_path(), end_id=1, order="_place")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_content),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, Viterbi decoding and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
