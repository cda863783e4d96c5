"""Document fingerprints from statistically improbable features.

Every 64-byte window of a text has an entropy.  Windows whose entropy is rare in
the corpus rank first; one that ranks first among its neighbours for long enough
is a feature.  Features go, in order of place, into a chain of Bloom filters of
2048 bits, and two fingerprints are as alike as their filters' bits overlap beyond
chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import Block, blocks, n_parts, part_bounds, part_of, widened
from shelfline.llm.words import U, hash_spans, mix

WINDOW = 64
LEVELS = 1000
#: A feature ranks first in so many of the ``WINDOW`` neighbourhoods that hold it.
POPULAR = 16
BITS, BYTES, PROBES = 2048, 256, 5
#: Short texts, in bytes, have features of short windows besides, as has a text without any other.
SHORT_TEXT, SHORT, SHORT_POPULAR = 1024, 16, 6
#: Features of one filter; the next goes into a new one.
FULL = 128
#: Entropies below carry no information: runs of a few characters.
DULL = 100

# c * log2(c) in fixed point, so that sums along a text are exact; and by how much one more of c adds
_TERMS = np.array([0] + [round(c * np.log2(c) * (1 << 20)) for c in range(1, WINDOW + 1)], np.int32)
_ONE_MORE = np.append(np.diff(_TERMS), 0).astype(np.int32)
_TOP = 6 * WINDOW << 20  # 64 different bytes


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of every window, 0 to ``LEVELS``, by sliding: one byte leaves, one enters."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):  # equal bytes among the 63 after, and the 63 before
        same = (data[:-d] == data[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    sums = np.empty(n, np.int32)
    sums[0] = _TERMS[np.bincount(data[:WINDOW], minlength=256)].sum()
    # counted within the 63 bytes that both windows share
    np.subtract(_ONE_MORE[behind[WINDOW:]], _ONE_MORE[ahead[: n - 1]], out=sums[1:])
    sums = np.cumsum(sums, dtype=np.int32)
    return ((_TOP - sums) * (LEVELS / _TOP)).astype(np.int32)


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all ``docs(text)`` have each entropy: ``LEVELS + 1`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                total += np.bincount(_own_windows(block), minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(total)], ["level", "n"])

    rows = docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LEVELS + 1, np.int64)
    for row in rows:
        out[row["level"]] = row["n"]
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, the rarest that occurs first; dull ones have none (the last rank)."""
    out = np.full(LEVELS + 1, LEVELS + 1, np.int32)
    ranked = np.argsort(counts, kind="stable")
    ranked = ranked[ranked >= DULL]
    out[ranked] = np.arange(len(ranked))
    return out


def _whole(block: Block) -> np.ndarray:
    """True where ``WINDOW`` bytes from here on lie in one text."""
    out = np.ones(len(block.data), bool)
    for start, end in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        out[max(start, end - WINDOW + 1) : end] = False
    return out


def _own_windows(block: Block) -> np.ndarray:
    """Entropies of the windows that lie in one text."""
    levels = entropies(block.data)
    return levels[_whole(block)[: len(levels)]]


def _leftmost_least(ranks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Position of the least (leftmost of equals) in every run of ``window`` ranks (a power of two), by doubling."""
    room = max(1, int(len(ranks) - 1).bit_length())
    kind = np.int32 if room + int(LEVELS + 2).bit_length() < 32 else np.int64
    best = (ranks.astype(kind) << room) | np.arange(len(ranks), dtype=kind)
    span = 1
    while span < window:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    return best & kind((1 << room) - 1)


def short_places(data: np.ndarray) -> np.ndarray:
    """Where a text's short features begin.

    Short windows have too few entropies for a table of them to tell much: those of
    the most different bytes rank first.
    """
    found = []
    for at in range(0, len(data) - SHORT + 1, 1 << 14):  # in stretches that overlap by a neighbourhood
        part = data[at : at + (1 << 14) + 2 * SHORT]
        windows = np.lib.stride_tricks.sliding_window_view(part, SHORT)
        times = (windows[:, :, None] == windows[:, None, :]).sum(axis=2)
        rank = np.rint(np.log2(times).sum(axis=1) * 16).astype(np.int32)
        if len(rank) < SHORT:
            continue
        wins = _leftmost_least(rank, SHORT)
        place, times = np.unique(wins, return_counts=True)
        found.append(at + place[times >= SHORT_POPULAR])
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def features(block: Block, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of a block's texts in order of place, and their bounds.

    Texts under ``SHORT_TEXT`` bytes, and others without a popular window, have
    features of ``SHORT`` bytes behind the others, so that likeness grows with what
    is shared; without any of these either, a text is its own feature.  An empty text has none.
    """
    chosen = np.zeros(0, np.int64)
    levels = entropies(block.data)
    if len(levels) >= WINDOW:
        whole = _whole(block)
        rank = np.full(len(block.data), LEVELS + 2, np.int32)
        rank[: len(levels)] = np.where(whole[: len(levels)], ranks[levels], LEVELS + 2)
        wins = _leftmost_least(rank)
        wins = wins[whole[: len(wins)]]  # neighbourhoods that lie in one text; in order, so winners come in runs
        first = np.flatnonzero(np.concatenate(([True], wins[1:] != wins[:-1]))) if len(wins) else wins
        times = np.diff(np.append(first, len(wins)))
        place = wins[first]
        chosen = place[(times >= POPULAR) & (rank[place] <= LEVELS)].astype(np.int64)
    at = np.searchsorted(chosen, block.offsets)
    size = np.diff(block.offsets)
    starts, ends, where = [chosen], [chosen + WINDOW], [np.arange(len(chosen))]
    extra = np.zeros(len(block), np.int64)
    for i in np.flatnonzero((size > 0) & ((size < SHORT_TEXT) | (np.diff(at) == 0))).tolist():
        first, last = int(block.offsets[i]), int(block.offsets[i + 1])
        more = first + short_places(block.data[first:last])
        if not len(more) and at[i] == at[i + 1]:
            starts.append(np.array([first]))
            ends.append(np.array([last]))
        else:
            starts.append(more)
            ends.append(more + SHORT)
        extra[i] = len(starts[-1])
        where.append(np.full(len(starts[-1]), at[i + 1] - 0.5))  # behind the text's others
    order = np.argsort(np.concatenate(where), kind="stable")
    hashes = hash_spans(block.data, np.concatenate(starts)[order], np.concatenate(ends)[order])
    return hashes, at + np.concatenate(([0], np.cumsum(extra)))


def digests(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters: uint8 of shape (filters, ``BYTES``)."""
    n = np.diff(at)
    filters = -(-n // FULL)
    base = np.concatenate(([0], np.cumsum(filters)))
    text = np.repeat(np.arange(len(n)), n)
    own = base[text] + (np.arange(len(hashes)) - at[text]) // FULL
    bits = np.zeros((base[-1], BITS), np.uint8)
    step = mix(hashes) | U(1)
    for k in range(PROBES):
        bits[own, ((hashes + U(k) * step) >> U(64 - 11)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best overlap in the other, beyond chance, on average.

    Overlap is bits in common, less those expected of unrelated filters, over the
    most there can be.  Two empty chains are alike, an empty and another are not.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = _ONES[a].sum(axis=1, dtype=np.int64), _ONES[b].sum(axis=1, dtype=np.int64)
    total = 0.0
    for i in range(len(a)):
        common = _ONES[a[i] & b].sum(axis=1, dtype=np.int64)
        most = np.minimum(na[i], nb)
        chance = na[i] * nb / BITS
        spread = np.sqrt(chance * (1 - na[i] / BITS) * (1 - nb / BITS)) * 2
        floor = np.minimum(chance + spread, most - 1)
        total += float(np.clip((common - floor) / (most - floor), 0, 1).max())
    return total / len(a)


def as_text(chain: np.ndarray) -> str:
    """Count of filters and their bits; the empty text's is ``0:``."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def fingerprint(docs: DataFrame, ranks: np.ndarray, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``fingerprint``, by the rarity table of a corpus."""
    docs = docs.drop("fingerprint")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                part = batch.slice(block.first, len(block))
                found = [as_text(c) for c in digests(*features(block, ranks))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, "fingerprint"])

    return docs.mapInArrow(mark, widened(docs, fingerprint="string"))


def ordered_neighbours(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` dealt into ranges of doc_id, sorted in them, as ``part, own, doc_id, text``.

    The first document of each range is also sent to the range before (``own``
    false), so that every document meets its successor; the first of all is sent to
    the last range.  One text in a range travels twice, the others once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = n_parts(spark)
    bounds = part_bounds(docs, "doc_id", parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(part_of(batch.column("doc_id"), bounds))], ["doc_id", "part"])

    # ids alone are read for the ranges' first documents: one row a range reaches the driver
    ids = docs.select("doc_id").mapInArrow(place, "doc_id long, part int")
    firsts = {r["part"]: r["d"] for r in ids.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("d")).collect()}
    present = sorted(firsts)
    before = {(firsts[p][1]): present[i - 1] for i, p in enumerate(present)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            part = part_of(keys, bounds)
            own = pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.ones(len(part), bool)), keys, batch.column("text")], ["part", "own", "doc_id", "text"])
            yield own
            again = [i for i, k in enumerate(keys.to_pylist()) if k in before]
            if again:
                copy = own.take(pa.array(again))
                part = pa.array([before[k] for k in copy.column("doc_id").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([part, pa.array(np.zeros(len(again), bool)), copy.column("doc_id"), copy.column("text")], own.schema.names)

    dealt = docs.mapInArrow(deal, "part int, own boolean, doc_id long, text string")
    return dealt.repartitionById(parts, "part").sortWithinPartitions("part", F.desc("own"), "doc_id", F.xxhash64("text"), "text")


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has its last quarter of code points (rounded down) replaced by
    as many of the first of the next document in ascending doc_id (or all it has);
    after the last comes the first.  The rarity table covers all of ``docs``.

    Null counts as empty.  Rows of one id follow each other in order of a hash of
    their text; rows without id come first.  A table of one row is its own next.
    Other columns are ignored.
    """
    ranks = rarity(entropy_counts(docs))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, str]] = []
        size = 0
        waiting = None  # a range's halo begins: only its first row is the successor

        def flush(successor: str | None) -> pa.RecordBatch | None:
            """Rows held, the last only if its successor is known."""
            nonlocal held, size
            rows = held if successor is not None else held[:-1]
            nexts = [t for _, _, t in held[1:]] + ([successor] if successor is not None else [])
            held, size = [] if successor is not None else held[-1:], 0
            return _compared(rows, nexts, ranks) if rows else None

        for batch in batches:
            for part, own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "doc_id", "text")), strict=True):
                if own:
                    if size > 1 << 19 and held and held[-1][0] == part:
                        out = flush(None)
                        if out is not None:
                            yield out
                    held.append((part, doc_id, text))
                    size += len(text)
                    waiting = part
                elif waiting == part:
                    out = flush(text)
                    waiting = None
                    if out is not None:
                        yield out

    return ordered_neighbours(docs).mapInArrow(compare, COMPARED)


def _compared(rows: list, nexts: list[str], ranks: np.ndarray) -> pa.RecordBatch:
    texts = [t for _, _, t in rows]
    edited = []
    for text, after in zip(texts, nexts, strict=True):
        cut = len(text) // 4
        edited.append(text[: len(text) - cut] + after[:cut])
    encoded = [t.encode() for t in edited]
    column = pa.array([*(t.encode() for t in texts), nexts[-1].encode(), *encoded], pa.large_binary())
    chains = [c for block in blocks(column) for c in digests(*features(block, ranks))]
    own, successor, changed = chains[: len(rows)], chains[1 : len(rows) + 1], chains[len(rows) + 1 :]
    return pa.RecordBatch.from_arrays(
        [pa.array([d for _, d, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(t).hexdigest() for t in encoded]), pa.array([as_text(c) for c in own]), pa.array([as_text(c) for c in changed]),
         pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)]), pa.array([likeness(a, b) for a, b in zip(own, successor, strict=True)])],
        [f.split()[0] for f in COMPARED.split(", ")],
    )
