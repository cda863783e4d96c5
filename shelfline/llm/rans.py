"""Token files: static range asymmetric numeral coding in independent blocks.

One frequency table, counted over the whole corpus, serves every block and lies in
a file beside them, so a folder is decoded from itself.  A block interleaves ``LANES`` coder states; every ``STRIDE`` symbols of a lane it records
their values and the position in its words (a checkpoint), from which decoding
can start.  Both directions work on all blocks, and decoding on all checkpoints,
of a batch at once as array arithmetic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import reachable
from shelfline.llm.tokens import encoder, token_blocks
from shelfline.sources.scratch import fresh_path

LANES = 16
STRIDE = 512
SCALE_BITS = 20
U = np.uint64
LOW = 1 << 31  # states stay in [2**31, 2**63) and move 32 bits at a time
MAGIC = b"SRNS"
VERSION = 2
HEAD = struct.Struct("<4sBBHIIIQIII")  # magic, version, scale bits, lanes, stride, documents, tokens, first token, words, crc32 of ids, of the table
TABLE = "version int, scale_bits int, vocabulary int, crc32 long, frequencies binary"


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies summing to 2**bits, at least 1 for every symbol that occurs."""
    total, room = int(counts.sum()), 1 << bits
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    seen = counts > 0
    if int(seen.sum()) > room:
        raise ValueError("more symbols than slots: raise the scale bits")
    out[seen] = np.maximum(1, counts[seen].astype(object) * room // total).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    excess = int(out.sum()) - room
    if excess < 0:
        out[order[0]] -= excess
    for symbol in order:  # ones given to rare symbols come out of the most frequent
        if excess <= 0:
            break
        cut = min(excess, int(out[symbol]) // 2)
        out[symbol] -= cut
        excess -= cut
    return out


class Coder:
    def __init__(self, frequencies: np.ndarray, bits: int = SCALE_BITS) -> None:
        self.bits = bits
        self.freq = frequencies.astype(U)
        self.start = (np.cumsum(frequencies) - frequencies).astype(U)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of symbols: checkpoint states, word positions, words."""
        n = np.array([len(t) for t in texts])
        steps = -(-n // LANES)
        top = -(-int(steps.max(initial=0)) // STRIDE) * STRIDE
        width = len(texts) * LANES
        symbols = np.zeros((len(texts), top * LANES), np.uint32)
        for i, t in enumerate(texts):
            symbols[i, : len(t)] = t
        symbols = np.ascontiguousarray(symbols.reshape(len(texts), top, LANES).swapaxes(0, 1)).reshape(top, width)
        left = n[:, None] - np.arange(LANES)[None, :]  # a lane has a symbol at step s if left > s * LANES
        left = left.ravel()
        states = np.full(width, LOW, U)
        words, moved = np.zeros((top, width), np.uint32), np.zeros((top, width), bool)
        marks = np.zeros((top // STRIDE, width), U)
        shift, bits = U(63 - self.bits), U(self.bits)
        for s in range(top - 1, -1, -1):
            live = left > s * LANES
            f = self.freq[symbols[s]]
            out = (states >= (f << shift)) & live
            words[s], moved[s] = states.astype(np.uint32), out
            x = np.where(out, states >> U(32), states)
            f[~live] = 1
            q = x // f
            states = np.where(live, (q << bits) + (x - q * f) + self.start[symbols[s]], x)
            if not s % STRIDE:
                marks[s // STRIDE] = states
        found = []
        for i in range(len(texts)):
            lanes = slice(i * LANES, (i + 1) * LANES)
            m = moved[:, lanes]
            before = np.concatenate(([0], np.cumsum(m.sum(axis=1))))[:-1][::STRIDE]
            k = -(-int(steps[i]) // STRIDE)
            found.append((marks[:k, lanes], before[:k].astype(np.uint32), words[:, lanes][m]))
        return found

    def decode(self, coded: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Symbols of blocks given as (symbol count, checkpoint states, positions, words)."""
        if not coded:
            return []
        words = np.concatenate([c[3] for c in coded] + [np.zeros(1, np.uint32)])
        base = np.concatenate(([0], np.cumsum([len(c[3]) for c in coded])))
        states = np.concatenate([c[1].reshape(-1, LANES) for c in coded])
        at = np.concatenate([b + c[2].astype(np.int64) for b, c in zip(base[:-1], coded, strict=True)])
        first = np.concatenate([np.arange(len(c[1])) * STRIDE * LANES for c in coded])
        total = np.concatenate([np.full(len(c[1]), c[0]) for c in coded])
        left = (total - first)[:, None] - np.arange(LANES)[None, :]
        out = np.zeros((len(states), STRIDE, LANES), np.uint32)
        mask, bits = U((1 << self.bits) - 1), U(self.bits)
        for s in range(min(STRIDE, -(-int(left.max(initial=0)) // LANES))):
            live = left > s * LANES
            slot = states & mask
            symbol = self.symbol[slot]
            out[:, s] = symbol
            x = self.freq[symbol] * (states >> bits) + slot - self.start[symbol]
            need = (x < U(LOW)) & live
            rank = np.cumsum(need, axis=1)
            word = words[np.where(need, at[:, None] + rank - 1, len(words) - 1)]
            states = np.where(live, np.where(need, (x << U(32)) | word, x), states)
            at += rank[:, -1]
        flat, k, texts = out.reshape(len(states), STRIDE * LANES), 0, []
        for c in coded:
            texts.append(flat[k : k + len(c[1])].ravel()[: c[0]])
            k += len(c[1])
        return texts


#: Symbols, with those that pad blocks to one length, that are coded side by side.
SIDE_BY_SIDE = 1 << 22


def together(sizes: list[int]) -> Iterator[slice]:
    """Runs of blocks to code side by side: a block much longer than others is coded by itself."""
    first = longest = 0
    for i, size in enumerate(sizes):
        if i > first and (i + 1 - first) * max(longest, size) > SIDE_BY_SIDE:
            yield slice(first, i)
            first, longest = i, 0
        longest = max(longest, size)
    if sizes:
        yield slice(first, len(sizes))


def table_crc(table: np.ndarray) -> int:
    return zlib.crc32(table.astype("<u4").tobytes())


def block_bytes(first: int, doc_ids: list, counts: list[int], crc: int, coded: tuple, of_table: int = 0) -> bytes:
    """A block as it lies in a file: header, documents, checkpoints, words, crc32 of all that."""
    marks, before, words = coded
    head = HEAD.pack(MAGIC, VERSION, SCALE_BITS, LANES, STRIDE, len(counts), sum(counts), first, len(words), crc, of_table)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    parts = (known, ids, np.array(counts, "<u4"), before.astype("<u4"), marks.astype("<u8"), words.astype("<u4"))
    body = head + b"".join(p.tobytes() for p in parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes) -> tuple[int, list, np.ndarray, int, tuple]:
    """(first token, doc ids, counts, crc32 of ids, what ``Coder.decode`` takes); checks the block's checksum."""
    if len(data) < HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged block: checksum differs")
    magic, version, bits, lanes, stride, n_docs, n_tokens, first, n_words, crc, _ = HEAD.unpack_from(data)
    if (magic, version, bits, lanes, stride) != (MAGIC, VERSION, SCALE_BITS, LANES, STRIDE):
        raise ValueError("not a block of this format")
    at = HEAD.size

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, dtype, n, at)
        at += found.nbytes
        return found

    k = -(-n_tokens // (LANES * STRIDE))
    known, ids, counts, before = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs), take("<u4", k)
    marks = take("<u8", k * LANES).reshape(k, LANES)
    words = take("<u4", n_words)
    return first, [int(d) if ok else None for ok, d in zip(known, ids, strict=True)], counts, crc, (n_tokens, marks, before, words)


def table_of_block(data: bytes) -> int:
    """crc32 of the frequency table the block was coded with."""
    return HEAD.unpack_from(data)[-1]


def frequency_table(blocks: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """How often each id occurs in all blocks; the driver gets one number for an id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_tokens(docs: DataFrame, *, tokenizer: str, end_id: int = 2, path: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Encodes all of ``docs(doc_id, text)`` into the folder ``path``; returns what ``open_tokens`` finds there.

    Ids of ascending doc_id, ``end_id`` after each document.  ``blocks`` in it has a
    folder for each part (a range of doc_id), rows there are ``block, payload``: the
    coded block as defined by ``block_bytes``.  ``table`` has the frequencies that
    all of them need and is written last: without it the folder is unfinished.
    Spark commits the files, so a lost executor or a second attempt leaves none in
    part.  A folder that has files already is an error.  Without a path the
    folder is a fresh one of the job's own.

    A null or empty text is its end id alone.  Rows with one id, or with none
    (which go first), are documents of their own.  Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path.rstrip("/") if path else fresh_path(spark, "token-files")
    blocks, offsets = token_blocks(docs, tokenizer, end_id)
    found = encoder(tokenizer)
    dtype = found.dtype
    size = max(found.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    table = scaled(frequency_table(blocks, dtype, size))
    crc = table_crc(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                rows = batch.slice(at, 32).to_pylist()
                ids = [np.frombuffer(r["ids"], dtype) for r in rows]
                done = [c for part in together([len(x) for x in ids]) for c in coder.encode(ids[part])]
                payload = [
                    block_bytes(offsets[r["part"]] + r["start"], r["doc_ids"], r["counts"], zlib.crc32(x.astype("<u4").tobytes()), c, crc)
                    for r, x, c in zip(rows, ids, done, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.int32()), pa.array(payload, pa.binary())],
                    ["part", "block", "payload"],
                )

    coded = blocks.mapInArrow(encode, "part int, block int, payload binary")
    coded.write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/blocks")
    row = (VERSION, SCALE_BITS, size, crc, bytearray(table.astype("<u4").tobytes()))
    spark.createDataFrame([row], TABLE).coalesce(1).write.option("compression", "zstd").parquet(f"{path}/table")
    return open_tokens(spark, path)


def open_tokens(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks and the checked frequency table of a folder ``write_tokens`` has finished, as ``read_tokens`` takes them."""
    path = path.rstrip("/")
    rows = reachable(spark).read.schema(TABLE).parquet(f"{path}/table").take(2)
    if len(rows) != 1:
        raise ValueError(f"{path}: one frequency table expected")
    row = rows[0]
    if (row["version"], row["scale_bits"]) != (VERSION, SCALE_BITS):
        raise ValueError(f"{path}: not token files of this format")
    table = np.frombuffer(row["frequencies"], "<u4").astype(np.int64)
    if len(table) != row["vocabulary"] or table_crc(table) != row["crc32"] or int(table.sum()) not in (0, 1 << SCALE_BITS):
        raise ValueError(f"{path}: damaged frequency table")
    return spark.read.schema("block int, payload binary, part int").parquet(f"{path}/blocks"), table


def read_tokens(files: DataFrame, table: np.ndarray) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of every document in the files.

    Checks every block: its own checksum and that of its table before decoding, that
    of its ids after.  By path: ``read_tokens(*open_tokens(spark, path))``.
    """
    of_table = table_crc(table)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                payloads = batch.column("payload").slice(at, 32).to_pylist()
                rows = [read_block(p) for p in payloads]
                if any(table_of_block(p) != of_table for p in payloads):
                    raise ValueError("a block was coded with another frequency table")
                for (first, doc_ids, counts, crc, _), ids in zip(rows, coder.decode([r[4] for r in rows]), strict=True):
                    ids = ids.astype("<u4")
                    if zlib.crc32(ids.tobytes()) != crc:
                        raise ValueError("damaged block: its ids differ")
                    ends = np.cumsum(counts, dtype=np.int64)
                    starts = ends - counts
                    own = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(first + starts), pa.array(counts.astype(np.int64)), pa.array(own, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32)))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return files.select("payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
