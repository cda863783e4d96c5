"""Quality by line labelling: a linear-chain conditional random field on lines.

Every line of a text is content or boilerplate; Viterbi decoding finds the best
sequence, and the share of words in content lines decides whether a text stays.
The field is trained on documents labelled good or bad, whose lines take the
document's label, and on such documents joined at a line's end, a good one before or
behind a bad one, which is how it learns where a text changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import Block, blocks, widened
from shelfline.llm.words import U, Words, hash_spans, is_word, mix, seeds, spans

#: Bound of the training sample: documents of each label; longer ones are cut into pieces of so many lines.
SAMPLE_DOCS, SAMPLE_LINES = 500, 64
CONTENT_SHARE = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

FEATURES = (
    "symbols over 2%", "symbols over 8%", "capitals over 30%", "capitals over 80%", "exclamations over 20% of words",
    "bars over 10% of words", "a word like the one before, over 20%", "a word like the one before, over 60%",
    "same line earlier", "under 3 words", "under 8 words", "ends a sentence", "digits over 20%", "long words", "short words",
)


class Lines(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # lines of text i: bounds[i] to bounds[i + 1]
    words: np.ndarray  # words in each line
    repeats: np.ndarray  # bool: the line has a word and equals an earlier line of its text


def _one_of(data: np.ndarray, characters: bytes) -> np.ndarray:
    found = np.zeros(len(data), bool)
    for c in characters:
        found |= data == c
    return found


def _within(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks lie in each span."""
    sums = np.concatenate((np.zeros(1, np.int32), np.cumsum(marks, dtype=np.int32)))
    return (sums[ends] - sums[starts]).astype(np.int64)


def _by_text(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The same hash in another text is another key."""
    text = np.repeat(np.arange(1, len(bounds), dtype=U), np.diff(bounds))
    return mix(hashes + text * seeds(1, 41)[0])


def lines(block: Block, words: Words) -> Lines:
    """The ``\\n``-separated lines of a block's texts."""
    breaks = np.flatnonzero(block.data == 0x0A)
    starts = np.sort(np.concatenate((block.offsets[:-1], breaks + 1)), kind="stable")
    # a text starts a line at its offset; a break at its very end starts an empty line before the next text
    ends = np.sort(np.concatenate((block.offsets[1:], breaks)), kind="stable")
    n = 1 + _within(block.data == 0x0A, block.offsets[:-1], block.offsets[1:])
    bounds = np.concatenate(([0], np.cumsum(n)))
    n_words = np.searchsorted(words.starts, ends) - np.searchsorted(words.starts, starts)
    keys = _by_text(hash_spans(block.data, starts, ends), bounds)
    has = np.flatnonzero(n_words > 0)
    repeats = n_words > 0
    repeats[has[np.unique(keys[has], return_index=True)[1]]] = False
    return Lines(starts, ends, bounds, n_words, repeats)


def features(block: Block, words: Words, hashes: np.ndarray, found: Lines) -> np.ndarray:
    """A row of 0 and 1 for each line, as named in ``FEATURES``."""
    data, count = block.data, lambda marks: _within(marks, found.starts, found.ends)
    inside = is_word(data)
    chars = np.maximum(1, count(inside & ((data & 0xC0) != 0x80)))
    symbols = count(_one_of(data, SYMBOLS))
    # of UTF-8 letters beyond ASCII, those after 0xC3 tell case: 0x80 to 0x9E are capitals
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    capital = (data - np.uint8(65) < 26) | (after & (data < 0x9F))
    letter = capital | (data - np.uint8(97) < 26) | (after & (data >= 0x9F))
    capitals, letters = count(capital), np.maximum(1, count(letter))
    same = np.zeros(len(data) + 1, bool)
    same[words.starts[1:][hashes[1:] == hashes[:-1]]] = True
    alike = count(same[:-1])
    n = np.maximum(1, found.words)
    last = np.searchsorted(words.ends, found.ends, "right") - 1
    closing = np.where(found.words > 0, data[words.ends[last] - 1] if len(words.ends) else 0, 0)
    return np.stack(
        [symbols > 0.02 * chars, symbols > 0.08 * chars, capitals > 0.3 * letters, capitals > 0.8 * letters,
         count(data == 0x21) > 0.2 * n, count(data == 0x7C) > 0.1 * n, alike > 0.2 * n, alike > 0.6 * n, found.repeats,
         found.words < 3, found.words < 8, np.isin(closing, list(b".!?:\"'")), count(data - np.uint8(48) < 10) > 0.2 * chars,
         chars > 12 * n, chars < 2.5 * n],
        axis=1,
    )


class Field(NamedTuple):
    """Log-weights of the chain; label 1 is content."""

    emission: np.ndarray  # (features + 1, 2), last row the bias
    transition: np.ndarray  # (2, 2), from and to

    @staticmethod
    def neutral() -> Field:
        """Everything is content."""
        emission = np.zeros((len(FEATURES) + 1, 2))
        emission[-1, 1] = 1
        return Field(emission, np.zeros((2, 2)))

    def viterbi(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of every line; texts are decoded side by side, line by line."""
        score = rows @ self.emission[:-1] + self.emission[-1]
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")  # texts with a line t come first
        sizes, first = n[order], bounds[:-1][order]
        back = np.zeros((len(rows), 2), np.int8)
        best = score[np.minimum(first, len(rows) - 1)] if len(rows) else np.zeros((0, 2))
        live = len(n)
        for t in range(1, int(n.max(initial=0))):
            live = int(np.searchsorted(-sizes, -t, "left"))  # sizes over t
            step = best[:live, :, None] + self.transition[None]
            back[first[:live] + t] = step.argmax(axis=1)
            best[:live] = step.max(axis=1) + score[first[:live] + t]
        labels = np.zeros(len(rows), np.int8)
        state = best.argmax(axis=1).astype(np.int8)
        for t in range(int(n.max(initial=0)) - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, "left"))
            at = first[:live] + t
            labels[at] = state[:live]
            state[:live] = back[at, state[:live]]
        return labels


def joined(pieces: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pieces of one label as sequences, and good and bad ones end to end, in both orders.

    Each label's pieces take part once in each order, the scarcer one's several times.
    """
    by_label = [[x for x, y in pieces if y == label] for label in (0, 1)]
    found = [(x, np.full(len(x), y)) for x, y in pieces]
    for i in range(max(map(len, by_label))):
        for first in (0, 1):
            # another partner in the other order
            x, y = (by_label[k][(i + (k != first) * (i // len(by_label[k]) + 1)) % len(by_label[k])] for k in (first, 1 - first))
            found.append((np.concatenate((x, y)), np.repeat((first, 1 - first), (len(x), len(y)))))
    return found


def fit(pieces: list[tuple[np.ndarray, int]], rounds: int = 80, rate: float = 0.3, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by gradient steps (Adam) with exact forward-backward sums.

    ``pieces``: a feature matrix and a label for each piece of a training document.
    With one label only, the neutral field.  Both labels and the joined sequences count alike.
    """
    if len({y for _, y in pieces}) < 2:
        return Field.neutral()
    sequences = joined(pieces)
    n, top, width = len(sequences), max(len(x) for x, _ in sequences), len(FEATURES) + 1
    x, mask, y = np.zeros((n, top, width)), np.zeros((n, top), bool), np.zeros((n, top), np.int64)
    for i, (rows, labels) in enumerate(sequences):
        x[i, : len(rows), :-1], x[i, : len(rows), -1], mask[i, : len(rows)], y[i, : len(rows)] = rows, 1, True, labels
    kind = np.array([label for _, label in pieces] + [2] * (n - len(pieces)))
    weight = 1 / (3 * np.bincount(kind)[kind])
    w, tr = np.zeros((width, 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    gold = np.stack([mask & (y == 0), mask & (y == 1)], axis=2).astype(float)
    gold_tr = np.zeros((2, 2))
    np.add.at(gold_tr, (y[:, :-1], y[:, 1:]), mask[:, 1:] * weight[:, None])

    def logsum(a: np.ndarray, axis: int) -> np.ndarray:
        m = a.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for k in range(1, rounds + 1):
        score = x @ w
        fwd, bwd = np.zeros((n, top, 2)), np.zeros((n, top, 2))
        fwd[:, 0] = score[:, 0]
        for t in range(1, top):
            new = logsum(fwd[:, t - 1, :, None] + tr, 1) + score[:, t]
            fwd[:, t] = np.where(mask[:, t, None], new, fwd[:, t - 1])
        for t in range(top - 2, -1, -1):
            new = logsum(tr + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = logsum(fwd[:, -1], 1)
        belief = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        both = fwd[:, :-1, :, None] + tr + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
        both = np.where(mask[:, 1:, None, None], np.exp(np.minimum(both, 0)), 0)
        grads = (
            np.einsum("ntf,ntk->fk", x, (gold - belief) * weight[:, None, None]) - penalty * w,
            gold_tr - np.einsum("ntij,n->ij", both, weight) - penalty * tr,
        )
        for p, g, m, v in ((w, grads[0], *state[:2]), (tr, grads[1], *state[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(w, tr)


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """A field from a bounded sample of ``labels(doc_id, quality)``.

    The sample has at most ``sample_docs`` documents of each label, those of least
    crc32(doc_id), in pieces of ``sample_lines`` lines; only their line features, two
    bytes a line, reach the driver.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = [marked.where(F.col("quality") == q).orderBy(key, "doc_id").limit(sample_docs) for q in (0, 1)]
    rows = docs.select("doc_id", "text").join(chosen[0].union(chosen[1]), "doc_id").select("quality", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = spans(block)
                hashes = hash_spans(block.data, words.starts, words.ends)
                found = lines(block, words)
                x = np.packbits(features(block, words, hashes, found), axis=1)
                quality = batch.column("quality").slice(block.first, len(block)).to_pylist()
                out = [
                    (q, x[at : min(at + sample_lines, b)].tobytes())
                    for q, a, b in zip(quality, found.bounds[:-1], found.bounds[1:], strict=True)
                    for at in range(a, b, sample_lines)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["quality", "x"])

    width = -(-len(FEATURES) // 8)
    got = sorted((r["quality"], bytes(r["x"])) for r in rows.mapInArrow(measure, "quality int, x binary").collect())
    unpack = lambda b: np.unpackbits(np.frombuffer(b, np.uint8).reshape(-1, width), axis=1)[:, : len(FEATURES)]
    return fit([(unpack(x), q) for q, x in got])


def measure_quality(docs: DataFrame, field: Field, *, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The columns of ``docs(doc_id, text, ...)`` with word and line counts and the verdict.

    Added: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, content_words, kept``; input columns of these names are replaced.
    A text is kept if it passes the base rules (50 words, at most half of them in
    repeated 3-word windows) and ``content_share`` of its words lie in lines that
    Viterbi decoding marks as content.  Null and empty texts have no words and
    fail.  Every row is judged by itself, so repeated rows are judged alike.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "kept")
    docs = docs.drop(*added)
    schema = widened(docs, **{name: "boolean" if name in ("base_failed", "kept") else "long" for name in added})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = spans(block)
                hashes = hash_spans(block.data, words.starts, words.ends)
                found = lines(block, words)
                at, n = block.offsets, np.diff(words.bounds)
                chars = _within(is_word(block.data) & ((block.data & 0xC0) != 0x80), at[:-1], at[1:])
                symbols = _within(_one_of(block.data, SYMBOLS), at[:-1], at[1:])
                dup = _within(found.repeats, found.bounds[:-1], found.bounds[1:])
                repeated = repeated_words(hashes, words.bounds)
                content = field.viterbi(features(block, words, hashes, found), found.bounds) == 1
                share = np.concatenate(([0], np.cumsum(found.words * content)))
                in_content = share[found.bounds[1:]] - share[found.bounds[:-1]]
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
                kept = ~failed & (in_content >= content_share * n)
                own = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *map(pa.array, (n, chars, symbols, dup, repeated, failed, in_content, kept))],
                    [*own.schema.names, *added],
                )

    return docs.mapInArrow(judge, schema)


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, window: int = 3) -> np.ndarray:
    """For each text, its words that lie in a window of words found twice or more in it."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(len(bounds) - 1, np.int64)
    sums = np.zeros(n, U)
    for i, odd in enumerate(seeds(window, 43)):
        sums += hashes[i : i + n] * odd
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = np.flatnonzero(text[:n] == text[window - 1 :])  # windows within one text
    keys = mix(sums[own] + (text[own].astype(U) + U(1)) * seeds(1, 41)[0])
    _, nth, times = np.unique(keys, return_inverse=True, return_counts=True)
    marked = np.zeros(len(hashes), bool)
    twice = own[times[nth] > 1]
    for i in range(window):
        marked[twice + i] = True
    return _within(marked, bounds[:-1], bounds[1:])
