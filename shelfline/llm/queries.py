"""Registered queries: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import conversation_repair, embedding_dup, fingerprint, language, licence, line_crf, merkle, mixing, near_dup, packing, rans, toxicity, wrapper
from shelfline.llm.common import table
from shelfline.sources.scratch import fresh_path


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op2_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op4_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan(table(spark, sf_dir, "documents"), licence.known_licences(spark))


def op5_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, scorer).select(
        "doc_id",
        (toxicity.remainder(F.col("doc_id")) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("toxic").cast("int").alias("predicted"),
    )


def op7_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    rans.write_tokens(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), end_id=2, path=path)
    return rans.read_tokens(*rans.open_tokens(spark, path)).drop("ids")


def op8_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), end_id=1).drop("ids")


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.measure_quality(docs, field).drop("text")


def op10_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_words(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_p_stable_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op12_wagner_fischer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found, made = conversation_repair.repair(conversation_repair.damaged(conversation_repair.as_turns(conversations)))
    out = conversations.select(F.col("conv_id").alias("_id")).distinct()
    for part in (found, conversation_repair.digests(made)):
        out = out.join(part, F.col("_id").eqNullSafe(part["conv_id"]), "left").drop(part["conv_id"])
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_path_copying_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.without_line_ends())


QUERIES = {
    f.__name__: f
    for f in (
        op1_improbable_features,
        op2_wrapper_text,
        op3_minhash_near_dup,
        op4_licence_digests,
        op5_language_evidence,
        op6_kneser_ney_toxicity,
        op7_rans_token_files,
        op8_concatenate_and_cut,
        op9_line_crf_quality,
        op10_golden_ratio_mix,
        op11_p_stable_embedding_dup,
        op12_wagner_fischer_repair,
        op13_path_copying_manifest,
    )
}
SQL: dict[str, str] = {
    "op3_minhash_near_dup": near_dup.near_duplicates_sql(width=4, percent=80),
    "op4_licence_digests": licence.scan_sql(),
    "op11_p_stable_embedding_dup": embedding_dup.near_duplicates_sql(0.9),
    "op12_wagner_fischer_repair": conversation_repair.repair_sql(),
    "op13_path_copying_manifest": merkle.manifest_sql(),
}
