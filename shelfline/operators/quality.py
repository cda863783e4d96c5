"""Checks a file reader does not make: bad values, NOT NULL, lengths, keys."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.sources import records, schemas

REASON = "reject_reason"
REPEATED_KEY = "repeated key"


def coerce(raw: DataFrame, table: str) -> DataFrame:
    """Text columns to contract types, naming the first column that does not parse.

    ``reject_reason`` is NULL for good rows; of ``records`` that are broken it says how.
    Their file and line stay.  Nothing is dropped: split with ``accepted`` and ``rejected``.
    """
    typed: dict[str, Column] = {}
    broken: list[Column] = []
    for name, kind in schemas.CONTRACTS[table]:
        text = F.col(name)
        value = text if kind == "string" or kind.startswith("varchar") else text.try_cast(kind)
        typed[name] = value
        bad = text.isNotNull() & value.isNull()
        if name == "out_of_stock_flg":
            bad = bad | ~value.isin(0, 1)
        if name in schemas.REQUIRED_COLUMNS.get(table, ()):
            bad = bad | text.isNull()
        if value is not text or name in schemas.REQUIRED_COLUMNS.get(table, ()):
            broken.append(F.when(bad, F.lit(name)))
    if records.BROKEN in raw.columns:
        broken.insert(0, F.col(records.BROKEN))
    return raw.select(
        *[value.alias(name) for name, value in typed.items()],
        (F.coalesce(*broken) if broken else F.lit(None).cast("string")).alias(REASON),
        *[c for c in (records.FILE, records.LINE) if c in raw.columns],
    )


def mark_repeated(coerced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of good rows that share a key, rejects all but the first in text order of their lines.

    For dimensions: a key that came twice would multiply every fact that joins it.
    Rows with a NULL in the key join nothing and stay.
    """
    first = Window.partitionBy(*keys, REASON).orderBy(records.LINE, records.FILE)
    known = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
    again = F.col(REASON).isNull() & known & (F.row_number().over(first) > 1)
    return coerced.withColumn(REASON, F.when(again, REPEATED_KEY).otherwise(F.col(REASON)))


def require_unique(df: DataFrame, table: str) -> None:
    """Raises an error that names some of the keys a dimension has more than once."""
    keys = schemas.KEYS[table]
    found = repeated_keys(df.dropna(subset=list(keys)), keys).orderBy(*keys).limit(5).collect()
    if found:
        shown = "; ".join(", ".join(f"{k}={row[k]}" for k in keys) + f" ({row.n_rows} rows)" for row in found)
        raise ValueError(f"{table} has keys more than once: {shown}")


def accepted(coerced: DataFrame) -> DataFrame:
    return coerced.filter(F.col(REASON).isNull()).drop(REASON, records.FILE, records.LINE)


def rejected(coerced: DataFrame) -> DataFrame:
    return coerced.filter(F.col(REASON).isNotNull())


def contract_breaches(df: DataFrame, table: str) -> DataFrame:
    """Row counts per rule, in one pass: NULLs where barred, text over its length."""
    rules: list[tuple[str, str, Column]] = [
        (name, "not null", F.col(name).isNull())
        for name in schemas.REQUIRED_COLUMNS.get(table, ())
    ] + [
        (name, f"at most {limit} characters", F.length(name) > limit)
        for name, limit in schemas.varchar_limits(table).items()
    ]
    counted = df.agg(*[F.count_if(test).alias(f"r{i}") for i, (_, _, test) in enumerate(rules)])
    cases = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(rule).alias("rule"),
            F.col(f"r{i}").alias("n_rows"),
        )
        for i, (name, rule, _) in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*cases)))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with how many."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )
