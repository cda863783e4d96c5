import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm.common import binaries, blocks, part_of, utf8
from shelfline.llm.words import LOWERED, hash_spans, shingles, sorted_sets, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.text(alphabet="aBé \t\n\x0b日.", max_size=20), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 30))
def test_words_of_blocks_are_those_of_the_pattern(values, size):
    found = []
    for block in blocks(pa.array(values, pa.string()), size):
        words = spans(block)
        raw = block.data.tobytes()
        all_words = [raw[a:b].decode() for a, b in zip(words.starts, words.ends)]
        found += [all_words[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:])]
    assert found == [WORD.findall(v) for v in values]


def test_hashes_depend_on_the_bytes_alone():
    values = ["one two", "Two one", "", "one"]
    (block,) = blocks(pa.array(values, pa.string()))
    words = spans(block)
    plain = hash_spans(block.data, words.starts, words.ends)
    lowered = hash_spans(block.data, words.starts, words.ends, LOWERED)
    assert plain[0] == plain[3] == plain[4] and plain[1] != plain[2]
    assert lowered[1] == lowered[2] and lowered[0] == plain[0]


def test_shingles_of_short_and_long_texts():
    random.seed(1)
    values = [" ".join(random.choices("a b c d".split(), k=k)) for k in (0, 1, 3, 4, 5, 40)]
    (block,) = blocks(pa.array(values, pa.string()))
    words = spans(block)
    found, at = shingles(hash_spans(block.data, words.starts, words.ends), words.bounds, 4)
    different, cuts = sorted_sets(found, at)
    for i, value in enumerate(values):
        w = value.split()
        want = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
        assert cuts[i + 1] - cuts[i] == len(want)
        assert list(different[cuts[i] : cuts[i + 1]]) == sorted(set(found[at[i] : at[i + 1]]))


def test_helpers():
    data, offsets = utf8(pa.array(["a", None, "é"], pa.string()).slice(1))
    assert data.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2]
    assert binaries(np.array([1, 2, 3], "<u2"), np.array([2, 0, 1])).to_pylist() == [b"\1\0\2\0", b"", b"\3\0"]
    assert part_of(pa.array([None, 5, 6, 100]), np.array([5, 50])).tolist() == [0, 0, 1, 2]
