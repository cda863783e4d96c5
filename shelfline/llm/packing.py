"""Concatenate and cut: token streams packed into windows of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.tokens import encoder, token_blocks

WINDOW = 2048
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def as_written(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a column ``name``: each row's place in the Parquet table Spark wrote, files by number.

    A frame that is not read from files has no such order: its places are null.
    """
    file = F.col("_metadata.file_name")
    number = lambda mark: F.coalesce(F.regexp_extract(file, mark, 1).try_cast("long"), F.lit(0))
    # task, the task's how many-th file, row: 21, 10 and 32 bits
    place = number(r"^part-(\d+)") * (1 << 42) + number(r"-c(\d+)\.") * (1 << 32) + F.col("_metadata.row_index")
    try:
        return docs.withColumn(name, place)
    except AnalysisException:
        return docs.withColumn(name, F.lit(None).cast("long"))


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, window: int = WINDOW, order: str | None = None) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: one row for each document and window it touches.

    All documents' ids, each with ``end_id`` after it, form one stream in
    ascending doc_id order, or that of the integer column ``order`` (then of doc_id),
    cut every ``window`` ids; only the last window can be short.  Prefix sums take two passes: tokens within a part are summed while the
    part is written, and the parts' totals (one number each) give global offsets.
    A piece is the boundary record: where it starts in its document and in its
    window.  ``ids`` holds its token ids.

    A null or empty text is its end id alone.  Rows with one id, or with none
    (which go first), are documents of their own.  Other columns are ignored.
    """
    found, offsets = token_blocks(docs, tokenizer, end_id, order)
    dtype = encoder(tokenizer).dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], dtype).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                first = offsets[row["part"]] + row["start"]
                ends = first + np.cumsum(counts)
                starts = ends - counts
                n = (ends - 1) // window - starts // window + 1
                doc = np.repeat(np.arange(len(counts)), n)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                sequence = starts[doc] // window + nth
                lo = np.maximum(starts[doc], sequence * window)
                hi = np.minimum(ends[doc], (sequence + 1) * window)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(lo - first, hi - first, strict=True)]
                doc_ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
                pieces = pa.ListArray.from_arrays(
                    pa.array(np.append(lo - first, hi[-1] - first).astype(np.int32)), pa.array(ids.astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, *map(pa.array, (lo - starts[doc], hi - lo, np.array(crc, np.int64), counts[doc], sequence, lo - sequence * window)), pieces],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return found.mapInArrow(cut, PIECES)
