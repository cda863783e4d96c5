"""Token ids of whole texts, and ordered blocks of them."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import Block, binaries, blocks, n_parts, part_bounds, part_of, saved
from shelfline.llm.words import hash_spans, spans

#: A worker remembers so many words' ids, and as many from before; older ones are looked up anew.  Bounds memory, not results.
REMEMBERED = 400_000
#: Texts are encoded in blocks of so many bytes: the larger, the fewer lookups a word.
ENCODED_BYTES = 2 << 20
#: A block of token ids ends with the document that fills it.
BLOCK_TOKENS = 1 << 16

# The steps of a tokenizer file that work on each white-space
# separated word by itself, so that words can be encoded once and remembered.
WORDWISE_NORMALIZER = ["NFC", "Replace", "Lowercase"]
WORDWISE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


#: The letters of Latin-1 beyond ASCII, as UTF-8.
LATIN_LETTERS = frozenset(chr(c).encode() for c in range(0xC0, 0x100) if chr(c).isalpha())
LATIN = re.compile(rb"(?:[a-z]|" + b"|".join(sorted(LATIN_LETTERS)) + rb")+").fullmatch


class Encoder:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` for many texts.

    If the file splits at white space before anything else, each different word is
    encoded once by the library and then remembered; otherwise whole texts are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.wordwise = self._wordwise(spec)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        if self.wordwise:  # letters of Latin-1 as the library's byte level spells them
            spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.spelled = {ord(c): spell(c.lower())[0][0] for c in map(chr, range(0xC0, 0x100)) if c.isalpha()}

    @staticmethod
    def _wordwise(spec: dict) -> bool:
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            [s["type"] for s in steps] == WORDWISE_NORMALIZER
            and steps[1]["pattern"] == {"Regex": "\\s+"}
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": WORDWISE_SPLIT}
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
            and spec["model"]["type"] == "BPE"
            and not spec.get("post_processor")
        )

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Remembers the ids of words in which A-Z are lowered.

        A tail of ASCII punctuation after a Latin-1 letter or a digit is always split
        off by the tokenizer, so stem and tail are looked up by themselves.  A stem
        of such letters is one piece, which the library's model encodes directly.
        """
        known, split, rest = self.known, [], set()
        for word in words:
            stem = word.rstrip(b".,;:!?%$&*#")
            if stem and len(stem) < len(word) and (stem[-1:].isalnum() or stem[-2:] in LATIN_LETTERS):
                split.append((word, stem, word[len(stem) :]))
                rest.update(split[-1][1:])
            else:
                rest.add(word)
        tokenize, spelled, code, other = self.tokenizer.model.tokenize, self.spelled, self.dtype.char, []
        for word in rest.difference(known):
            if word in self.before:
                known[word] = self.before[word]
                continue
            if word.isalpha():  # of bytes: ASCII letters only
                text = word.decode()
            elif LATIN(word):
                text = word.decode().translate(spelled)
            else:
                other.append(word)
                continue
            known[word] = array(code, [t.id for t in tokenize(text)]).tobytes()
        known.update(zip(other, self._whole([w.decode() for w in other]), strict=True))
        for word, stem, tail in split:
            known[word] = known[stem] + known[tail]

    def _by_words(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Each different word of the block is looked up once."""
        # A-Z to a-z and splitting at ASCII white space change nothing that follows
        data = block.data + np.uint8(32) * (block.data - np.uint8(65) < np.uint8(26))
        words = spans(Block(block.first, data, block.offsets))
        _, at, nth = np.unique(hash_spans(data, words.starts, words.ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        different = [raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        again = {w: self.before[w] for w in different if w not in self.known and w in self.before}
        self.known.update(again)
        self._learn([w for w in different if w not in self.known])
        found = [self.known[w] for w in different]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        pool, pool_at = np.frombuffer(b"".join(found), self.dtype), np.cumsum(sizes) - sizes
        n = sizes[nth]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat(pool_at[nth] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[words.bounds]

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts end to end, and where each text's begin."""
        raw = block.data.tobytes()
        if self.wordwise and not any(m in raw for m in self.marks):
            return self._by_words(block)
        texts = [raw[a:b].decode() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
        ids = [np.frombuffer(x, self.dtype) for x in self._whole(texts)]
        return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; workers outlive tasks, so its memory pays."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, order: str | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Written blocks of token ids in ascending doc_id order, and the tokens before each part.

    With ``order``, a column of integers, they are in order of that, then of doc_id.
    Rows: ``part, block, start`` (tokens of the part before the block), ``doc_ids``,
    ``counts`` (tokens by document, end id included), ``ids`` (packed).  A part is a
    range of the order and a task; parts are as many as the session's shuffle
    partitions ask for, and only their totals reach the driver.  Null ids go first;
    rows of one id are ordered by their ids' bytes.
    """
    spark = docs.sparkSession
    place = [F.col(order).cast("long").alias("place")] if order else []
    keys = [*["place"] * len(place), "doc_id"]
    docs = docs.select(*place, F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = n_parts(spark)
    bounds = part_bounds(docs, keys[0], parts)
    dtype = encoder(tokenizer).dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), ENCODED_BYTES):
                ids, at = encoder(tokenizer).encode(block)
                found = [batch.column(k).slice(block.first, len(block)) for k in keys]
                with_end = np.insert(ids, at[1:], np.array(end_id, dtype))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_of(found[0], bounds)), *found, binaries(with_end, np.diff(at) + 1)], ["part", *keys, "ids"]
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, held, size = None, 0, 0, [], 0

        def row() -> pa.RecordBatch:
            nonlocal block, start, held, size
            counts = [len(ids) // dtype.itemsize for _, ids in held]
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([b"".join(ids for _, ids in held)], pa.binary())],
                ["part", "block", "start", "doc_ids", "counts", "ids"],
            )
            block, start, held, size = block + 1, start + sum(counts), [], 0
            return out

        for batch in batches:
            for p, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if held and (p != part or size >= BLOCK_TOKENS * dtype.itemsize):
                    yield row()
                if p != part:
                    part, block, start = p, 0, 0
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield row()

    encoded = docs.mapInArrow(encode, ", ".join(["part int", *(f"{k} long" for k in keys), "ids binary"]))
    found = saved(
        encoded.repartitionById(parts, "part").sortWithinPartitions("part", *keys, "ids")
        .mapInArrow(gather, "part int, block int, start long, doc_ids array<long>, counts array<long>, ids binary"),
        "tokens",
    )
    totals = found.groupBy("part").agg(F.max(F.col("start") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, offsets = 0, {}
    for row in totals.orderBy("part").collect():  # one row a part
        offsets[row["part"]] = before
        before += row["n"]
    return found, offsets
