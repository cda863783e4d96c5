"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Each source's documents, shuffled, form a circle of words that is cut into blocks
of equal size.  Golden-ratio points, mapped through the cumulative weights, say
which source each slot of the mix takes from; the slots of a source, ranked, take
its blocks one after the other, around the circle again if need be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import blocks, n_parts, part_bounds, part_of, saved, widened
from shelfline.llm.words import spans

WEIGHTS = (5, 2, 1)
PERCENT, MOST = 150, 2
#: Words of a block.
BLOCK_WORDS = 2048
#: Fraction of the golden ratio, in units of 2**-62.
GOLDEN = 2850178704830799621


def sized(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with ``size``, the words of each text."""
    docs = docs.drop("size")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                part = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(spans(block).bounds))], [*part.schema.names, "size"])

    return docs.mapInArrow(count, widened(docs, size="long"))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` of every source in ``sizes(source, size)``.

    Sources in code point order, null last, have the ``weights`` in turn and share
    ``percent`` of all words; no target exceeds ``most`` times its source, and what
    is cut off is shared by weight among the others, until none is above.  The
    driver sees two sums a round; each round but the last caps a source or more.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    held = saved(by_source.withColumn("weight", weight), "sources")  # one row a source
    total = percent * (held.agg(F.sum("source_size")).first()[0] or 0) / 100
    share = 0.0
    while True:
        over = F.col("weight") * share > most * F.col("source_size")
        row = held.agg(
            F.sum(F.when(over, most * F.col("source_size"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("w")
        ).first()
        after = (total - (row["capped"] or 0)) / row["w"] if row["w"] else share
        if after <= share:
            break
        share = after
    target = F.least(F.col("weight") * F.lit(share), (most * F.col("source_size")).cast("double"))
    return held.select("source", "source_size", target.alias("target"))


def circles(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source, size)`` with ``at``: words of its source before each document, shuffled.

    The order is that of a hash of the id.  Sums take two passes: within parts of
    the hash, many for a hot source, and over the parts of each source.
    """
    parts = n_parts(docs.sparkSession)
    shuffle = F.xxhash64("doc_id", F.lit(17))
    placed = docs.withColumn("h", shuffle).withColumn("part", F.floor((F.col("h") / 2.0**64 + 0.5) * parts).cast("int"))
    order = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # equal rows have equal sizes; which of them is first does not matter
    within = placed.withColumn("n", F.lit(0)).withColumn("within", F.sum("size").over(order) - F.col("size"))
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.sum("words").over(before) - F.col("words")).alias("base"))
    return within.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select(
        *docs.columns, (F.col("base") + F.col("within")).alias("at")
    )


def schedule(goals: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(source, slot, rank, lap, block, words)``: which block each slot of the mix takes.

    Slot i lies at the fraction of i golden ratios; the source whose stretch of the
    cumulative weights holds it gets the slot.  The slots of a source are ranked;
    rank r takes block r of its circle, modulo its blocks.  A source has as many
    slots as its target has blocks (the last is cut to the target); those the
    points have not given when they end follow in order of source.

    ``goals(source, source_size, target)``; one row a source, one a slot.
    """
    spark = goals.sparkSession
    goal = F.round("target").cast("long")
    need = goals.where("source_size > 0").withColumn("goal", goal).where("goal > 0")
    # full circles, then a rest; a circle's last block is short
    per = F.ceil(F.col("source_size") / block_words)
    laps, rest = F.floor(F.col("goal") / F.col("source_size")), F.col("goal") % F.col("source_size")
    need = need.select("source", "source_size", "goal", per.alias("per"), (laps * per + F.ceil(rest / block_words)).alias("slots"))
    by = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    need = saved(need.withColumn("upto", F.sum("slots").over(by)), "stretches")  # one row a source
    total = need.agg(F.max("upto")).first()[0] or 0
    # the golden-ratio point of slot i as an integer below 2**62, then as a place among the slots
    points = spark.range(total).select(F.col("id").alias("slot"), _golden("id").alias("u"))
    points = points.withColumn("place", F.least(F.floor(F.col("u") / 2.0**62 * total), F.lit(total - 1)).cast("long"))
    stretches = need.select("source", (F.col("upto") - F.col("slots")).alias("lo"), F.col("upto").alias("hi"))
    given = _within(points, stretches, total)
    counts = given.groupBy("source").agg(F.count("*").alias("given"))
    ranked = _ranked(given, total)
    kept = need.select(F.col("source").alias("s"), "source_size", "goal", "per", "slots", "upto")
    on = F.col("source").eqNullSafe(F.col("s"))
    drawn = ranked.join(kept, on).where("rank < slots").drop("s")
    short = need.join(counts.withColumnRenamed("source", "s"), on, "left").withColumn("given", F.least(F.coalesce("given", F.lit(0)), "slots"))
    rest_rows = short.where("given < slots").select(
        "source", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"), "source_size", "goal", "per", "slots", "upto"
    )
    rest_rows = rest_rows.withColumn("slot", total + F.col("upto") - F.col("slots") + F.col("rank"))
    columns = ["source", "slot", "rank", "source_size", "goal", "per"]
    both = drawn.select(columns).union(rest_rows.select(columns))
    block = F.col("rank") % F.col("per")
    start = F.floor(F.col("rank") / F.col("per")) * F.col("source_size") + block * block_words
    full = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    lap = F.floor(F.col("rank") / F.col("per"))
    return both.select("source", "slot", "rank", lap.alias("lap"), block.alias("block"), F.least(full, F.col("goal") - start).alias("words"))


def _golden(i: str) -> Column:
    """i * GOLDEN modulo 2**62, by halves that fit a long."""
    low, high = F.col(i) % (1 << 31), F.floor(F.col(i) / (1 << 31))
    g_low, g_high = GOLDEN % (1 << 31), GOLDEN >> 31
    middle = (low * g_high + high * g_low) % (1 << 31)
    carry = low * F.lit(g_low)
    return (carry + middle * (1 << 31)) % (1 << 62)


def _within(points: DataFrame, stretches: DataFrame, total: int) -> DataFrame:
    """The source whose stretch of places holds each point: an equi-join on coarse places.

    A stretch longer than a coarse step is listed once for each step it touches,
    so both sides are dealt evenly however large a source is.
    """
    step = max(1, total // 4096)
    listed = stretches.withColumn("coarse", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))))
    met = points.withColumn("coarse", F.floor(F.col("place") / step)).join(listed, "coarse")
    return met.where("place >= lo and place < hi").select("source", "slot")


def _ranked(given: DataFrame, total: int) -> DataFrame:
    """Rank of each slot within its source, by prefix sums over runs of slots."""
    run = max(1, total // n_parts(given.sparkSession))
    given = given.withColumn("run", F.floor(F.col("slot") / run))
    within = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = given.groupBy("source", "run").agg(F.count("*").alias("n"))
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), (F.sum("n").over(before) - F.col("n")).alias("base"))
    return (
        given.withColumn("within", within)
        .join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
        .select("source", "slot", (F.col("base") + F.col("within")).alias("rank"))
    )


def pieces(placed: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``placed(source, at, size, ...)`` cut at block borders: adds ``block``, ``lo`` and ``hi``.

    ``lo`` and ``hi`` are words of the block; ``skip`` words of the document lie before the piece.
    """
    touched = F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))
    cut = placed.where("size > 0").withColumn("block", F.explode(touched))
    first = F.col("block") * block_words
    lo, hi = F.greatest("at", first), F.least(F.col("at") + F.col("size"), first + block_words)
    return cut.select(*cut.columns, (lo - first).alias("lo"), (hi - first).alias("hi"), (lo - F.col("at")).alias("skip"))


def takes(sizes: DataFrame, goals: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame]:
    """``sizes(row, doc_id, source, size)`` in their circles, and what the slots take of each.

    The second: ``row, lap, slot`` (the first), and the words ``first`` to ``last`` of the
    document, which are consecutive within a lap of its circle.
    """
    placed = saved(circles(sizes), "placed")
    slots = schedule(goals, block_words=block_words).withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    cut = pieces(placed, block_words=block_words)
    hit = cut.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).where("lo < words")
    end = F.col("skip") + F.least("hi", "words") - F.col("lo")
    return placed, hit.groupBy("row", "lap").agg(F.min("slot").alias("slot"), F.min("skip").alias("first"), F.max(end).alias("last"))


def mix_words(docs: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source)``.

    ``taken``: words of the document that the mix's slots take, repeats counted.
    Taken words of a source are its target, rounded, for any block size; a document
    is taken whole at least once before any of its source is repeated.

    Null and wordless texts have size 0 and are taken 0 times.  A null source is a
    source.  Rows of one id are taken one after the other.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    sizes = saved(sized(docs).drop("text").withColumn("row", F.monotonically_increasing_id()), "sizes")
    goals = targets(sizes)
    placed, used = takes(sizes, goals, block_words)
    taken = used.groupBy(F.col("row").alias("r")).agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    named = goals.select(F.col("source").alias("s"), "source_size", "target")
    return (
        placed.join(taken, F.col("row") == F.col("r"), "left")
        .join(named, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: columns of ``docs(doc_id, text, source, ...)`` and ``slot``, the place in the mix.

    Rows lie in order of slot, within partitions and from one to the next, so that
    files written of them do too; rows of a slot (a block) are in order of doc_id.
    A document is not cut at blocks: it lies whole in the first slot that takes of it.

    A row for each document and lap in which slots take words of it; its text is
    what they take, the whole text or the words from one to another with the white
    space between them, and a column ``n_chars`` follows it.  Documents without
    words are in no mix.  Names beginning with ``_mix_`` are the operator's own, an
    input column ``slot`` is replaced.  Otherwise as ``mix_words``.
    """
    columns = [c for c in docs.columns if c != "slot"]
    numbered = saved(docs.select(columns).withColumn("_mix_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col("_mix_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    sizes = saved(sized(rows).drop("text"), "sizes")
    used = saved(takes(sizes, targets(sizes), block_words)[1], "used")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = part_bounds(used, "slot", parts)  # one number a part
    used = used.select(F.col("row").alias("_mix_row"), "slot", F.col("first").alias("_mix_first"), F.col("last").alias("_mix_last"))
    drawn = numbered.join(used, "_mix_row").drop("_mix_row")

    def slice_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = batch.column("_mix_first").to_numpy(), batch.column("_mix_last").to_numpy()
            texts = []
            for block in blocks(batch.column("text")):
                words, raw = spans(block), block.data.tobytes()
                for i in range(len(block)):
                    a, b = first[block.first + i], last[block.first + i]
                    lo, hi = words.bounds[i], words.bounds[i + 1]
                    start = block.offsets[i] if a == 0 else words.starts[lo + a]
                    end = block.offsets[i + 1] if b == hi - lo else words.ends[lo + b - 1]
                    texts.append(raw[start:end].decode())
            out = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string())}
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t) for t in texts], out["n_chars"].type)
            out["_mix_part"] = pa.array(part_of(out["slot"], bounds))
            kept = [*columns, "slot", "_mix_part"]
            yield pa.RecordBatch.from_arrays([out[c] for c in kept], kept)

    sliced = drawn.mapInArrow(slice_texts, widened(drawn.select(*columns, "slot"), _mix_part="int"))
    return sliced.repartitionById(parts, "_mix_part").sortWithinPartitions("slot", "doc_id", "text").drop("_mix_part")
