"""Last observation carried forward, for series of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.sources import scratch


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = "last_") -> DataFrame:
    """Adds ``last_<value>``: the row's value or, where it is NULL, the last one before it in its series.

    Two passes.  Rows are cut into ranges of ``keys`` and ``order``, so a long series
    lies in several parts, and filled within their part.  Then the last value of each
    series in each part, a row where a part and a series meet, is carried to the
    parts that follow.  Rows of one place in the order see each other's values by the greatest.
    """
    path = scratch.fresh_path(df.sparkSession, "ranges")
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged.write.option("compression", "zstd").parquet(path)
    parts = df.sparkSession.read.schema(ranged.schema).parquet(path)

    place = F.struct(*order)
    known = {v: F.struct(place.alias("at"), F.col(v).alias("value")) for v in values}
    seen = Window.partitionBy("_part", *keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = parts.withColumns({f"_in_{v}": F.max(F.when(F.col(v).isNotNull(), known[v])).over(seen)["value"] for v in values})

    ends = parts.groupBy("_part", *keys).agg(*[F.max(F.when(F.col(v).isNotNull(), known[v]))["value"].alias(f"_end_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", *keys, *[F.last(f"_end_{v}", ignorenulls=True).over(earlier).alias(f"_from_{v}") for v in values])
    carried = carried.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_from_{v}" for v in values])
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    return within.join(carried, same, "left").select(
        *df.columns, *[F.coalesce(f"_in_{v}", f"_from_{v}").alias(f"{prefix}{v}") for v in values]
    )
