"""Parquet tables and CSV unloads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfline.functions import names as N
from shelfline.operators.replay import as_of as cut
from shelfline.sources import schemas
from shelfline.sources.files import Location
from shelfline.sources.scratch import fresh_path


def table_path(base: str, table: str, run_date: dt.date) -> str:
    """``run_date=`` in the path makes every run a prunable partition."""
    return f"{base.rstrip('/')}/{table}/run_date={N.date_label(run_date)}"


def save_table(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    spread_by: Sequence[str] = (),
    compression: str = "zstd",
    mode: str = "overwrite",
    replace_partitions: bool = False,
) -> None:
    """Write parquet.

    ``partition_by`` makes folders; ``cluster_by`` only brings rows of near keys into
    the same files.  Rows are rebalanced on those columns: adaptive execution alone
    decides the number of files, splits a large partition over several tasks and
    merges small ones.  Sorting comes after the shuffle, so files really are sorted.
    It splits no finer than the tasks that sent the rows, so of few and very large
    partitions these can be too much for a task to sort; ``spread_by`` deals their rows
    by more columns, at the price of a file for every partition a task has rows of.
    With ``mode`` "overwrite" the whole folder is replaced, or with
    ``replace_partitions`` only the partitions that the rows belong to.
    """
    by = [*partition_by, *cluster_by]
    df = df.hint("rebalance", *by, *spread_by)
    order = list(dict.fromkeys([*by, *sort_by]))
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode(mode).option("compression", compression)
    if partition_by:
        overwrite = "dynamic" if replace_partitions else "static"
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", overwrite)
    writer.parquet(path)


def unload_csv(
    df: DataFrame,
    path: str,
    *,
    compression: str = "gzip",
    max_records: int = 0,
    mode: str = "overwrite",
    contract: str | None = None,
) -> None:
    """Write headered CSV part files below ``path``.

    Rows are rebalanced first, so one long input partition is not one writer; those
    for the ``contract`` of a table take its types after that, as wide decimals are no longs.
    ``max_records`` limits the rows of a part (0: no limit); more parts mean more
    readers later, as gzip files do not split.
    """
    df = df.hint("rebalance")
    (
        (schemas.to_contract(df, contract) if contract else df)
        .write.mode(mode)
        .option("header", "true")
        .option("dateFormat", "yyyy-MM-dd")
        .option("compression", compression)
        .option("maxRecordsPerFile", max_records)
        .options(**WHOLE_VALUES)
        .csv(path)
    )


def as_delivered(df: DataFrame, table: str, as_of: dt.date) -> DataFrame:
    """A fact up to a date, a dimension whole."""
    date_column = schemas.FACT_DATES.get(table)
    return cut(df, date_column, as_of) if date_column else df


def export_snapshot(
    tables: dict[str, DataFrame],
    location: Location,
    as_of: dt.date,
    *,
    compression: str = "gzip",
    dashed: bool = False,
    label: dt.date | None = None,
    max_bytes: int = 0,
) -> DataFrame:
    """Unload every table as of a date; returns ``(table_name, rows_written)``.

    Facts are cut at ``as_of``, dimensions go whole, and one date drives both the
    cut and the file label.  ``max_bytes`` caps each part's size before compression.  Rows are counted by the tasks that send them to the
    writers, not by a second scan; a stage is counted once, so a task that is run
    again after a loss is not counted twice.
    """
    written: list[tuple[str, int]] = []
    for table, df in tables.items():
        rows = as_delivered(df.select(*[c for c in schemas.columns(table) if c in df.columns]), table, as_of)
        seen = Observation()
        if max_bytes:
            rows, unload = schemas.to_contract(rows, table), partial(unload_capped, max_bytes=max_bytes)
        else:
            unload = partial(unload_csv, contract=table)
        unload(
            rows.observe(seen, F.count(F.lit(1)).alias("rows_written")),
            location.path(table, label or as_of, dashed),
            compression=compression,
        )
        written.append((table, int(seen.get["rows_written"])))
    session = next(iter(tables.values())).sparkSession
    return session.createDataFrame(written, "table_name string, rows_written bigint")


# Fixed value: by default Spark cuts white space off values that it writes.
WHOLE_VALUES = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

#: Fixed value: bytes an unloaded file may have.
FILE_CAP = 107_772_160

# Bytes and files a task writes where files are capped lower than that; file
# names count a task's files in three digits.
TASK_BYTES, TASK_FILES = 1 << 24, 1_000

# Fixed value: bytes of a file's lines that are stored, moved and sorted as one record.  A scan
# holds thousands of records at once, so it stays far below a file's size.
RUN_BYTES = 1 << 12


def unload_capped(
    df: DataFrame,
    path: str,
    *,
    max_bytes: int = FILE_CAP,
    order_by: Sequence[str] = (),
    compression: str = "none",
    mode: str = "overwrite",
    at_once: bool = True,
) -> int:
    """Write headered CSV part files of at most ``max_bytes`` each before compression, header included.

    Rows are encoded once and cut into files where they lie: in ranges of ``order_by``
    or, without it, in the frame's own partitions.  A task sums its rows' encoded
    lengths and begins a file where the next row would overrun; the driver adds up how
    many files each part has, a number a part.  Rows then move to the task that
    writes their file, in runs of ``RUN_BYTES`` and not one by one.  A row longer than
    the cap is alone in its file.  Returns the number of files; their names are in order
    of part and row.

    A task writes ``TASK_BYTES``, so the number of tasks follows from the bytes and not
    from the cap: of files much smaller than that it writes many, each put together as
    one record, and holds one at a time.

    With ``at_once`` the session's committer places the files, by default the driver alone when
    the last is written.  Without it each task moves its own, so that a run that dies leaves
    some of them; for folders that nobody reads before a marker says so.
    """
    header = ",".join(df.columns)
    room = max_bytes - len(header.encode()) - 1
    files_a_task = min(max(TASK_BYTES // max(max_bytes, 1), 1), TASK_FILES)
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    line = F.to_csv(F.struct(*df.columns), {"dateFormat": "yyyy-MM-dd", **WHOLE_VALUES})
    lines = df.select(line.alias("line")).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, used, row = -1, 0, 0
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column("line")), 1).to_numpy().astype(np.int64)
            total, files_, at = np.cumsum(sizes), np.empty(len(sizes), np.int64), 0
            while at < len(sizes):
                before = total[at - 1] if at else 0
                # rows that still fit; the first row of a file always does
                end = int(np.searchsorted(total, before + room - used, "right")) if file >= 0 else at
                if end <= at:
                    file, used = file + 1, 0
                    end = max(int(np.searchsorted(total, before + room, "right")), at + 1)
                files_[at:end] = file
                used += int(total[end - 1] - before)
                at = end
            if len(sizes):
                runs = _starts(files_, total // RUN_BYTES)
                texts = pc.binary_join(pa.ListArray.from_arrays(np.append(runs, len(sizes)), batch.column("line")), "\n")
                columns = [batch.column("part").take(runs), pa.array(files_[runs]), pa.array(row + runs.astype(np.int64)), texts]
                yield pa.RecordBatch.from_arrays(columns, ["part", "file", "row", "line"])
            row += len(sizes)

    own = fresh_path(df.sparkSession, "capped")
    lines.mapInArrow(cut, "part int, file long, row long, line string").write.option("compression", "zstd").parquet(own)
    encoded = df.sparkSession.read.parquet(own)
    counts = encoded.groupBy("part").agg((F.max("file") + 1).alias("n")).orderBy("part").collect()
    first, n_files = {}, 0
    for r in counts:
        first[r["part"]], n_files = n_files, n_files + r["n"]
    starts = df.sparkSession.createDataFrame(pa.table({"part": pa.array(list(first), pa.int32()), "first": pa.array(list(first.values()), pa.int64())}))
    placed = encoded.join(F.broadcast(starts), "part").select((F.col("first") + F.col("file")).cast("int").alias("id"), "row", "line")
    task = F.floor(F.col("id") / files_a_task).cast("int")
    placed = placed.repartitionById(max(-(-n_files // files_a_task), 1), task).sortWithinPartitions("id", "row")
    whole = files_a_task > 1
    text = placed.mapInArrow(partial(_whole_files if whole else _headed, header=header), "value string")
    if not n_files:
        text = df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1)
    early = {} if at_once else {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    text.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", int(whole)).options(**early).text(path)
    return n_files


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins; there is a row at least."""
    differs = np.logical_or.reduce([np.diff(k) != 0 for k in keys])
    return np.append(0, np.flatnonzero(differs) + 1).astype(np.int32)


def _headed(batches: Iterator[pa.RecordBatch], header: str) -> Iterator[pa.RecordBatch]:
    """A file's lines behind its header."""
    written = False
    for batch in batches:
        if len(batch):
            head = [] if written else [header]
            written = True
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(head, pa.string()), batch.column("line")])], ["value"])


def _whole_files(batches: Iterator[pa.RecordBatch], header: str) -> Iterator[pa.RecordBatch]:
    """Each file's lines behind its header, as one record a file."""
    at, held = None, []
    for batch in batches:
        ids, lines, done = batch.column("id").to_numpy(), batch.column("line"), []
        starts = _starts(ids) if len(ids) else []
        for begin, end in zip(starts, [*starts[1:], len(ids)]):
            if ids[begin] != at:
                if held:
                    done.append("\n".join(held))
                at, held = ids[begin], [header]
            held += lines.slice(begin, end - begin).to_pylist()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["value"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(held)], pa.string())], ["value"])
