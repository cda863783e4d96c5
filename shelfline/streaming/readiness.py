"""Continuous readiness: a day's manifest goes out once, when its set of tables is complete.

Landed names stream in, in any order, repeated, under either naming convention.  For
each day the stream keeps which required tables are there (with the name last in text
order) and which others are; it emits

* ``ready`` with the manifest, once, as soon as every required table and no other is there,
* ``late`` with what is missing, once, when the deadline has passed before that.

A late day can still become ready.  Time is event time: the landing times of the
names, held back by the watermark's delay.  State and checkpoint are Spark's, so a
restart goes on where it was; a day's state is one row, kept so that nothing is sent twice.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfline.functions import names as N
from shelfline.operators import landing

OUT = "run_date date, status string, payload string, missing string, n_unexpected long"
STATE = "names string, unexpected string, ready boolean, late boolean"
DAY_MS = 24 * 3600 * 1000


def landed_names(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """``(name, landed_at)`` of the files that arrive below a folder, as an unbounded frame; contents stay unread."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    listed = spark.readStream.schema(kinds).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
    return listed.select(N.landed_name(F.col("path")).alias("name"), F.col("modificationTime").alias("landed_at"))


def _judge(
    key: tuple[dt.date], rows: Iterator[pd.DataFrame], state: GroupState, base: str, required: tuple[str, ...], deadline_ms: int
) -> Iterator[pd.DataFrame]:
    names, unexpected, ready, late = state.get if state.exists else ("{}", "[]", False, False)
    names, unexpected = json.loads(names), set(json.loads(unexpected))
    due = (key[0] - dt.date(1970, 1, 1)).days * DAY_MS + deadline_ms
    for some in rows:
        for table, name in zip(some["table_name"], some["name"], strict=True):
            if table in required:
                names[table] = max(name, names.get(table, ""))
            else:
                unexpected.add(table)
    missing = sorted(set(required) - set(names))
    out = []
    if not ready and not missing and not unexpected:
        ready = True
        conf = {t: f"{base}/{names[t]}" for t in sorted(required)}
        out.append((key[0], "ready", json.dumps({"conf": conf}, separators=(",", ":")), None, 0))
    if not ready and not late and (state.hasTimedOut or state.getCurrentWatermarkMs() >= due):
        late = True
        out.append((key[0], "late", None, ",".join(missing), len(unexpected)))
    state.update((json.dumps(names), json.dumps(sorted(unexpected)), ready, late))
    if not ready and not late:
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["run_date", "status", "payload", "missing", "n_unexpected"])


def readiness(
    arrivals: DataFrame, base: str, *, required: Sequence[str] = landing.REQUIRED, deadline: dt.timedelta = dt.timedelta(hours=30), delay: str = "1 hour"
) -> DataFrame:
    """``(run_date, status, payload, missing, n_unexpected)`` of an unbounded ``arrivals(name, landed_at)``.

    ``deadline`` counts from the beginning of the day the files are for.  Names that do
    not follow the pattern belong to no day.  A table named again sends nothing new;
    one that should not be there keeps a day from being ready unless it is ready already.
    """
    # the test names landed_at, or Spark would move it below the watermark and names of no day would not count as time
    of_a_day = F.when(F.col("landed_at").isNotNull(), F.col("run_date").isNotNull())
    parsed = landing.parse(arrivals.withWatermark("landed_at", delay)).where(of_a_day)
    judge = partial(_judge, base=base.rstrip("/"), required=tuple(required), deadline_ms=int(deadline.total_seconds() * 1000))
    return (
        parsed.select("run_date", "table_name", "name", "landed_at")
        .groupBy("run_date")
        .applyInPandasWithState(judge, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def run_once(reports: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """One pass over what has arrived, reports appended below ``target``; wait for it with ``awaitTermination``."""
    return (
        reports.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
