"""Toxicity by two Kneser-Ney language models, one for each label.

The models spell words: each letter is predicted from up to five before it in the
word, so that inflected and newly coined forms of an insult are known by their
parts.  A word's gain is log p(word | toxic) - log p(word | ordinary).  Class counts
back off, order by order, to shared continuation counts gathered from every document,
so a rare spelling is judged by how rare it is at all.

Expressions of two words have models of their own: where a word is known behind the
one before it, its gain is scaled by p(word | word before) / p(word) of either class,
counts of both backing off to those of all documents.  So words that are harmless one
by one tell when they make up an expression, and an insult counts once.  A text's
evidence is the mean gain of its words.  A logistic curve fitted on cross-scored
training texts turns evidence into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import Block, blocks, saved, widened
from shelfline.llm.words import LOWERED, U, Words, hash_spans, mix, seeds, spans

#: Bound of the training sample: so many documents of each label.
SAMPLE_DOCS = 5000
#: Letters of an n-gram; the class models hold these orders, the shared one the next lower.
ORDER, LEAST = 6, 4
DISCOUNT = 0.75
REJECT = 0.7
#: Share of labels that the curve takes to be wrong.
MISLABELLED = 0.005
#: Texts of the training sample that an expression must be found in to be modelled.
EXPRESSION_TEXTS = 3


def remainder(doc_id):
    """crc32 of the id's decimal text, modulo 3; learning never sees 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def runs(block: Block) -> Words:
    """Runs of letters, digits and apostrophes."""
    data = block.data
    low = data | np.uint8(0x20)
    return spans(block, (low - np.uint8(97) < 26) | (data - np.uint8(48) < 10) | (data == 0x27) | (data >= 0x80))


def different_words(block: Block, words: Words, by_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each different word (of the block, or of each text), and every word's place among them."""
    keys = hash_spans(block.data, words.starts, words.ends, LOWERED)
    if by_text:
        keys += np.repeat(np.arange(len(block), dtype=U), np.diff(words.bounds)) * U(0x9E3779B97F4A7C15)
    _, at, nth = np.unique(keys, return_index=True, return_inverse=True)
    return at, nth


def spelling(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ORDER``-gram of each byte of the words and of the space after each, and the words' bounds.

    A gram is its bytes as one number, the last byte lowest; before a word there
    are spaces only.
    """
    data = block.data + np.uint8(32) * (block.data - np.uint8(65) < 26)
    data = np.append(data, np.uint8(0x20))
    n = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(n)))
    nth = np.arange(at[-1]) - np.repeat(at[:-1], n)  # place in the word
    where = np.repeat(starts, n) + nth
    letters = data[where]
    letters[at[1:] - 1] = 0x20
    grams = letters.astype(U)
    for k in range(1, ORDER):
        before = np.full(len(grams), 0x20, U)
        before[k:] = letters[:-k] if k < len(letters) else 0
        grams |= np.where(nth >= k, before, U(0x20)) << U(8 * k)
    return grams, at


def suffix(grams: np.ndarray, order: int) -> np.ndarray:
    return grams & U((1 << 8 * order) - 1)


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float = 0.0) -> np.ndarray:
    """Values of sorted ``keys``; ``default`` for others."""
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


class Level(NamedTuple):
    """One order of a model: discounted shares of grams, back-off weights of their contexts."""

    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def level(grams: np.ndarray, counts: np.ndarray) -> Level:
    """Absolute discounting of sorted ``grams`` with ``counts``."""
    contexts, first = np.unique(grams >> U(8), return_index=True)
    total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
    kinds = np.diff(np.append(first, len(grams)))
    each = np.repeat(np.arange(len(contexts)), kinds)
    return Level(grams, (counts - DISCOUNT) / total[each], contexts, DISCOUNT * kinds / total)


def shorter(grams: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Continuation counts: how many different ``grams`` end in each gram of a lower order."""
    return np.unique(suffix(grams, order), return_counts=True)


class Model(NamedTuple):
    """Gains of known grams, and what is needed for the others."""

    toxic: list[Level]  # from ORDER down to LEAST
    ordinary: list[Level]
    shared: Level
    expressions: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U), np.zeros(0))  # sorted keys and what each adds

    def gains(self, grams: np.ndarray) -> np.ndarray:
        """log p(letter | before, toxic) - log p(letter | before, ordinary)."""
        known = suffix(grams, LEAST - 1)
        lowest = np.maximum(lookup(self.shared.grams, self.shared.shares, known) + lookup(self.shared.contexts, self.shared.weights, known >> U(8), 1.0) / 256, 1e-9)
        logs = []
        for levels in (self.toxic, self.ordinary):
            p = lowest
            for order, held in zip(range(LEAST, ORDER + 1), levels[::-1], strict=True):
                own = suffix(grams, order)
                p = lookup(held.grams, held.shares, own) + lookup(held.contexts, held.weights, own >> U(8), 1.0) * p
            logs.append(np.log(p))
        return logs[0] - logs[1]

    def evidence(self, block: Block) -> np.ndarray:
        """Mean gain a word of each text, that of expressions included; 0 for texts without words."""
        words = runs(block)
        if not len(words.starts):
            return np.zeros(len(block))
        at, nth = different_words(block, words)
        grams, bounds = spelling(block, words.starts[at], words.ends[at])
        kinds, place = np.unique(grams, return_inverse=True)
        letters = np.concatenate(([0], np.cumsum(self.gains(kinds)[place])))
        gains = (letters[bounds[1:]] - letters[bounds[:-1]])[nth]
        if len(self.expressions[0]):
            gains = gains + lookup(*self.expressions, pairs(block, words)[0])
        sums = np.concatenate(([0], np.cumsum(gains)))
        return (sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / np.maximum(1, np.diff(words.bounds))


def model(
    toxic: tuple[np.ndarray, np.ndarray], ordinary: tuple[np.ndarray, np.ndarray], shared: tuple[np.ndarray, np.ndarray],
    expressions: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U), np.zeros(0)),
) -> Model:
    """From sorted grams and counts of each label, shared continuation counts, and expressions."""

    def levels(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
        return [level(grams, counts.astype(float)), *(level(*shorter(grams, k)) for k in range(ORDER - 1, LEAST - 1, -1))]

    return Model(levels(*toxic), levels(*ordinary), level(shared[0], shared[1].astype(float)), expressions)


def pairs(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's key with the word before it, that word's key, and its own; a text's first word has no pair (all ones)."""
    own = hash_spans(block.data, words.starts, words.ends, LOWERED)
    before = np.concatenate((np.zeros(1, U), own[:-1]))
    odd = seeds(3, 47)
    both, context = mix(before * odd[0] + own * odd[1]), mix(before * odd[2])
    both[words.bounds[:-1][np.diff(words.bounds) > 0]] = ~U(0)
    return both, context, own


def _once_a_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the first of each key in each text."""
    return np.unique(mix(keys + text.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)[1]


def expression_counts(sample: DataFrame, docs: DataFrame) -> dict[str, np.ndarray]:
    """What the models of expressions are made of: a row for each pair of words in ``EXPRESSION_TEXTS`` texts or more.

    ``sample(toxic, fold, text)`` gives texts by label and fold (columns 0 to 3) of the
    pair, of all pairs behind its first word, and of its second word; all ``docs`` give
    how often each of them occurs.  The driver gets the sample's expressions, which
    the sample's bound limits, with their counts.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = runs(block)
                both, context, own = pairs(block, words)
                text = np.repeat(np.arange(len(block)), np.diff(words.bounds))
                group = (batch.column("toxic").to_numpy() * 2 + batch.column("fold").to_numpy())[block.first :]
                at = _once_a_text(both, text)
                at = at[both[at] != ~U(0)]
                single = _once_a_text(own, text)
                key, prev, word = (np.concatenate(x) for x in ((both[at], own[single]), (context[at], np.zeros(len(single), U)), (own[at], own[single])))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (key, prev, word)), pa.array(group[np.concatenate((text[at], text[single]))]),
                     pa.array(np.repeat((True, False), (len(at), len(single))))], ["key", "prev", "word", "g", "pair"],
                )

    rows = sample.mapInArrow(spell, "key long, prev long, word long, g long, pair boolean")
    by_group = [F.count_if(F.col("g") == g).alias(f"n{g}") for g in range(4)]
    grams = saved(rows.groupBy("pair", "key", "prev", "word").agg(*by_group, F.count("g").alias("n")), "expressions")
    sums = lambda prefix: [F.sum(f"n{g}").alias(f"{prefix}{g}") for g in range(4)]
    kinds = [F.count_if(F.col(f"n{g}") > 0).alias(f"kinds{g}") for g in range(4)]
    kinds += [F.count_if(F.col(f"n{2 * y}") + F.col(f"n{2 * y + 1}") > 0).alias(f"kinds_of{y}") for y in (0, 1)]
    context = grams.where("pair").groupBy("prev").agg(*sums("of_prev"), *kinds)
    single = grams.where("not pair").select("word", *[F.col(f"n{g}").alias(f"of_word{g}") for g in range(4)])
    kept = grams.where(f"pair and n >= {EXPRESSION_TEXTS}").join(context, "prev").join(single, "word").toArrow().sort_by("key")
    found = {c: kept[c].to_numpy() for c in kept.column_names if c != "pair"}
    totals = grams.where("not pair").agg(*sums("all"), *kinds).first()
    found |= {f"all_{c}": np.float64(n or 0) for c, n in totals.asDict().items()}

    wanted = np.unique(np.concatenate([found[c].astype(np.int64).view(U) for c in ("key", "prev", "word")]))
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)  # bounded by the training sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shipped.value
        total, words_seen = np.zeros(len(keys) + 1, np.int64), 0
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = runs(block)
                both, context, own = pairs(block, words)
                words_seen += len(own)
                known = both != ~U(0)
                for seen in (both[known], context[known], own):
                    at = np.minimum(np.searchsorted(keys, seen), max(len(keys) - 1, 0))
                    total += np.bincount(at[keys[at] == seen] if len(keys) else at[:0], minlength=len(keys) + 1)
        total[-1] = words_seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    corpus = np.zeros(len(wanted) + 1)
    counted = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    corpus[counted["at"].to_numpy()] = counted["n"].to_numpy()
    for c in ("key", "prev", "word"):
        found[f"corpus_{c}"] = corpus[np.searchsorted(wanted, found[c].astype(np.int64).view(U))]
    found["corpus_words"] = corpus[-1]
    return found


def expression_gains(found: dict[str, np.ndarray], folds: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of expressions and log [p(w | v, toxic) / p(w | v, ordinary)] - log [p(w | toxic) / p(w | ordinary)], from some folds."""
    keys = found["key"].astype(np.int64).view(U)
    if not len(keys):
        return keys, np.zeros(0)
    behind = np.maximum(found["corpus_key"], 1) / np.maximum(found["corpus_prev"], 1)
    alone = np.maximum(found["corpus_word"], 1) / max(found["corpus_words"], 1)

    def shares(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total_ = np.maximum(total, 1)
        return np.where(total > 0, np.maximum(n - DISCOUNT, 0) / total_ + DISCOUNT * np.minimum(kinds, total) / total_ * lower, lower)

    out = np.zeros(len(keys))
    for label, sign in ((1, 1.0), (0, -1.0)):
        summed = lambda name: sum(found[f"{name}{label * 2 + k}"] for k in folds).astype(float)  # noqa: B023, E731
        kinds = f"kinds{label * 2 + folds[0]}" if len(folds) == 1 else f"kinds_of{label}"
        out += sign * np.log(shares(summed("n"), summed("of_prev"), found[kinds], behind))
        out -= sign * np.log(shares(summed("of_word"), summed("all_all"), found[f"all_{kinds}"], alone))
    order = np.argsort(keys)
    return keys[order], out[order]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of greatest likelihood, with a slight pull to a gentle slope (Newton steps)."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    w, pull = np.zeros(2), np.diag([0.01, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + pull, z.T @ (weight * (y - p)) - pull @ w)
        w += np.clip(step, -2, 2)
    return float(w[0] / scale), float(w[1])


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The logistic curve of all rows, if a share ``MISLABELLED`` of the labels is wrong.

    Such rows would flatten it: each row weighs as much as its label is likely to be
    right under the curve, which is fitted again until that settles.
    """
    trust = np.ones(len(x))
    for _ in range(20):
        slope, intercept = logistic(x, y, weight * trust)
        p = 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
        right = np.where(y == 1, p, 1 - p) * (1 - MISLABELLED)
        trust = right / (right + np.where(y == 1, 1 - p, p) * MISLABELLED)
    return slope, intercept


def shared_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams one shorter than the class models' least, with the number of different ``ORDER``-grams of all ``docs`` they end.

    Every text is spelled out; each task sends its different grams, so what is
    gathered grows with the corpus.  The driver gets a count for each different
    sequence of ``LEAST - 1`` bytes.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block in blocks(batch.column("text"), 2 << 20):
                words = runs(block)
                if not len(words.starts):
                    continue
                at, _ = different_words(block, words)
                held.append(np.unique(spelling(block, words.starts[at], words.ends[at])[0]))
                size += len(held[-1])
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64))], ["gram"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64))], ["gram"])

    grams = docs.select("text").mapInArrow(spell, "gram long").distinct()
    ends = grams.groupBy(F.col("gram").bitwiseAND((1 << 8 * (LEAST - 1)) - 1).alias("gram")).agg(F.count("*").alias("n"))
    found = ends.toArrow().sort_by("gram")
    return found["gram"].to_numpy().astype(U), found["n"].to_numpy()


def class_counts(rows: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of the sample ``rows(toxic, fold, text)`` by label and fold; a word counts once a text."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                words = runs(block)
                if not len(words.starts):
                    continue
                at, _ = different_words(block, words, by_text=True)
                grams, bounds = spelling(block, words.starts[at], words.ends[at])
                text = np.searchsorted(words.bounds, at, "right") - 1
                label, fold = (batch.column(c).to_numpy()[block.first :][text] for c in ("toxic", "fold"))
                group = np.repeat(label * 2 + fold, np.diff(bounds))
                for g in range(4):
                    kinds, n = np.unique(grams[group == g], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(kinds), g, np.int32)), pa.array(kinds.view(np.int64)), pa.array(n)], ["g", "gram", "n"]
                    )

    found = rows.mapInArrow(spell, "g int, gram long, n long").groupBy("g", "gram").agg(F.sum("n").alias("n")).toArrow()
    g, grams, n = (found[c].to_numpy() for c in ("g", "gram", "n"))
    out = {}
    for k in range(4):
        own = np.flatnonzero(g == k)
        own = own[np.argsort(grams[own])]
        out[divmod(k, 2)] = grams[own].astype(U), n[own]
    return out


def together(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    grams, nth = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return grams, np.bincount(nth, weights=np.concatenate((a[1], b[1])), minlength=len(grams))


class Scorer(NamedTuple):
    model: Model | None
    slope: float
    intercept: float

    def score(self, block: Block) -> np.ndarray:
        evidence = self.model.evidence(block) if self.model else np.zeros(len(block))
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.intercept, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """Learns from ``labels(doc_id, toxic)`` and the texts of ``docs(doc_id, text)``.

    Rows whose crc32(doc_id) leaves 1 modulo 3 are never used.  Of the others, at
    most ``sample_docs`` of each label, those of least crc32, train the class models;
    shared counts cover all of ``docs``.  With texts of one label only, every score is
    0 or 1 accordingly; without any, 0.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(crc % 3 != 1)
    marked = marked.select("doc_id", F.col("toxic").cast("long").alias("toxic"), (F.floor(crc / 3) % 2).cast("long").alias("fold"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [marked.where(F.col("toxic") == y).orderBy(crc, "doc_id").limit(sample_docs) for y in (1, 0)]
    sample = saved(docs.select("doc_id", "text").join(chosen[0].union(chosen[1]), "doc_id").select("doc_id", "toxic", "fold", "text"), "sample")
    if len(sizes) < 2:
        return Scorer(None, 0.0, 30.0 if 1 in sizes else -30.0)
    counts, shared = class_counts(sample), shared_counts(docs)
    expressions = expression_counts(sample, docs)
    halves = [model(counts[1, 1 - k], counts[0, 1 - k], shared, expression_gains(expressions, (1 - k,))) for k in (0, 1)]
    shipped = docs.sparkSession.sparkContext.broadcast(halves)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                part = batch.slice(block.first, len(block))
                fold = part.column("fold").to_numpy()  # scored by the other half's model, as unseen texts will be
                values = np.where(fold == 0, shipped.value[0].evidence(block), shipped.value[1].evidence(block))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(values)], ["doc_id", "toxic", "x"])

    scored = sample.mapInArrow(cross, "doc_id long, toxic long, x double").toPandas().sort_values(["doc_id", "toxic", "x"])
    y, x = scored["toxic"].to_numpy(), scored["x"].to_numpy()
    if len(set(y.tolist())) < 2:
        return Scorer(None, 0.0, 30.0 if 1 in y else -30.0)
    natural = np.array([sizes[k] / max(1, (y == k).sum()) for k in (0, 1)])
    both = expression_gains(expressions, (0, 1))
    whole = model(together(counts[1, 0], counts[1, 1]), together(counts[0, 0], counts[0, 1]), shared, both)
    return Scorer(whole, *curve(x, y, natural[y] / natural.max()))


def score(docs: DataFrame, scorer: Scorer, *, reject: float = REJECT) -> DataFrame:
    """The columns of ``docs(doc_id, text, ...)`` with ``toxicity`` (0 to 1) and ``toxic`` (at ``reject`` or more).

    Only the text counts.  Null, empty and wordless texts have no evidence and get
    the curve's value at zero.  Repeated rows get equal scores; input columns of
    the two names are replaced.
    """
    docs = docs.drop("toxicity", "toxic")
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by the training sample

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shipped.value
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 20):
                values = found.score(block)
                part = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(values), pa.array(values >= reject)], [*part.schema.names, "toxicity", "toxic"]
                )

    return docs.mapInArrow(judge, widened(docs, toxicity="double", toxic="boolean"))
