import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import packing, rans
from shelfline.llm.common import blocks
from shelfline.llm.tokens import Encoder


def reference(tokenizer, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer).encode_batch(texts, add_special_tokens=False)]


TRICKY = [
    "", " ", "Hello, World!", "it's I'VE we'll 'quoted', ''s", "naïve ÉCOLE x éa Å", "a<|endoftext|>b", "<|STARTOFTEXT|> x", "50%%% e$$$ x1,y2.",
    "日本語 текст \x1c\x1f\x85 z y", "ß,ÿ.! Σίσυφος ΣΑΣ", "a\tb\r\nc\x0bd", "don't.can't,won't;''", "x×y÷z, ×, é÷.",
]


def encoded(tokenizer, texts):
    import pyarrow as pa

    encoder = Encoder(tokenizer)
    out = []
    for block in blocks(pa.array(texts, pa.string())):
        ids, at = encoder.encode(block)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


def test_words_remembered_give_the_library_s_ids(tokenizer):
    assert encoded(tokenizer, TRICKY) == reference(tokenizer, TRICKY)
    plain = [t for t in TRICKY if "<|" not in t]
    assert encoded(tokenizer, plain) == reference(tokenizer, plain)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBé'sÉ \n\t.,!?%日1́ßσΣ×<|", max_size=25), min_size=1, max_size=5))
def test_any_text(values):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoded(path, values) == reference(path, values)


def test_another_kind_of_file_is_encoded_whole(tokenizer):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for t in TRICKY if t]
    assert not Encoder(path).wordwise
    assert encoded(path, texts) == reference(path, texts)


@pytest.mark.parametrize("sizes", [[0], [1], [5, 0, 16, 17], [rans.LANES * rans.STRIDE], [20_000, 3, 9000]])
def test_coder_round_trip(sizes):
    rng = np.random.default_rng(sum(sizes))
    texts = [np.minimum(rng.zipf(1.3, n) - 1, 49_000).astype(np.uint32) for n in sizes]
    counts = np.bincount(np.concatenate([*texts, [0, 7]]).astype(np.int64), minlength=49_408)
    table = rans.scaled(counts)
    assert table.sum() == 1 << rans.SCALE_BITS and ((table > 0) == (counts > 0)).all()
    coder = rans.Coder(table)
    coded = coder.encode(texts)
    back = coder.decode([(len(t), *c) for t, c in zip(texts, coded)])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(texts, back))


def test_one_symbol_only():
    coder = rans.Coder(rans.scaled(np.array([0, 9])))
    (coded,) = coder.encode([np.ones(1000, np.uint32)])
    assert len(coded[2]) == 0 and (coder.decode([(1000, *coded)])[0] == 1).all()


def test_a_checkpoint_starts_decoding_alone():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 50, 3 * rans.LANES * rans.STRIDE + 77)
    coder = rans.Coder(rans.scaled(np.bincount(text)))
    ((marks, before, words),) = coder.encode([text.astype(np.uint32)])
    at = 2 * rans.LANES * rans.STRIDE
    (part,) = coder.decode([(len(text) - at, marks[2:], before[2:] - before[2], words[before[2] :])])
    assert (part == text[at:]).all()


def test_damage_is_noticed():
    coder = rans.Coder(rans.scaled(np.array([1, 2, 3])))
    ids = np.array([0, 1, 2, 2, 1], np.uint32)
    data = rans.block_bytes(10, [4, None], [2, 3], zlib.crc32(ids.tobytes()), coder.encode([ids])[0])
    first, docs, counts, _, coded = rans.read_block(data)
    assert (first, docs, counts.tolist()) == (10, [4, None], [2, 3])
    assert coder.decode([coded])[0].tolist() == ids.tolist()
    for at in (0, 9, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            rans.read_block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def expected(rows, tokenizer, end):
    order = sorted((r for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [np.array(x + [end], "<u4") for x in reference(tokenizer, [t or "" for _, t in order])]
    return [d for d, _ in order], ids


def test_files_and_packing_against_the_definition(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i * 3 - 5, " ".join(rng.choices(["lorem", "Ipsum,", "élan", "x."], k=rng.choice([0, 1, 50, 3000])))) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files, table = rans.write_tokens(docs, tokenizer=tokenizer)
    got = {r["doc_id"]: r for r in rans.read_tokens(files, table).collect()}
    ids_of, ids = expected(rows, tokenizer, 2)
    start = 0
    for d, x in zip(ids_of, ids):
        r = got[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(x), zlib.crc32(x.tobytes()), x.tolist())
        start += len(x)
    ids_of, ids = expected(rows, tokenizer, 1)
    pieces = packing.pack(docs, tokenizer=tokenizer, window=64).collect()
    stream = np.concatenate(ids)
    starts = dict(zip(ids_of, np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]))
    seen = np.zeros(len(stream), int)
    for p in pieces:
        at = starts[p["doc_id"]] + p["start"]
        assert at == p["sequence_id"] * 64 + p["offset"] and p["offset"] + p["length"] <= 64
        assert stream[at : at + p["length"]].tolist() == p["ids"]
        assert p["ids_crc32"] == zlib.crc32(stream[at : at + p["length"]].astype("<u4").tobytes())
        seen[at : at + p["length"]] += 1
    assert (seen == 1).all()


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tokenizer):
    files, table = rans.write_tokens(odd_docs, tokenizer=tokenizer)
    got = rans.read_tokens(files, table).drop("ids").collect()
    assert len(got) == odd_docs.count()
    assert sorted(r["n_tokens"] for r in got)[:4] == [1, 1, 1, 1]
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] is None for r in ordered][:2] == [True, True]
    pieces = packing.pack(odd_docs, tokenizer=tokenizer).drop("ids").collect()
    assert sum(p["length"] for p in pieces) == sum(r["n_tokens"] for r in got)
    files, table = rans.write_tokens(no_docs, tokenizer=tokenizer)
    assert rans.read_tokens(files, table).collect() == [] and packing.pack(no_docs, tokenizer=tokenizer).collect() == []


def test_a_folder_is_decoded_from_itself(spark, tokenizer, tmp_path):
    rows = [(i, "lorem ipsum " * i) for i in range(20)]
    first, other = str(tmp_path / "first"), str(tmp_path / "other")
    rans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=tokenizer, path=first)
    rans.write_tokens(spark.createDataFrame([(1, "dolor")], "doc_id long, text string"), tokenizer=tokenizer, path=other)
    fresh = spark.newSession()  # of what was written it has the path alone
    got = {r["doc_id"]: r["ids"] for r in rans.read_tokens(*rans.open_tokens(fresh, first)).collect()}
    ids_of, ids = expected(rows, tokenizer, 2)
    assert got == {d: x.tolist() for d, x in zip(ids_of, ids)}
    with pytest.raises(Exception, match="another frequency table"):
        rans.read_tokens(rans.open_tokens(fresh, first)[0], rans.open_tokens(fresh, other)[1]).collect()
    table = fresh.read.parquet(f"{other}/table").collect()
    damaged = [(*table[0][:4], bytearray(bytes(table[0][4])[:-1] + b"\x07"))]
    fresh.createDataFrame(damaged, rans.TABLE).write.mode("overwrite").parquet(f"{other}/table")
    with pytest.raises(ValueError, match="damaged frequency table"):
        rans.open_tokens(fresh, other)
    with pytest.raises(Exception, match="(?i)already.exists"):
        rans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=tokenizer, path=first)


def test_a_long_block_is_coded_by_itself():
    sizes = [60_000] * 20 + [10_000_000] + [60_000] * 11
    parts = list(rans.together(sizes))
    assert [i for p in parts for i in range(32)[p]] == list(range(32))
    assert slice(20, 21) in parts and len(parts) == 3
    assert all((p.stop - p.start) * max(sizes[p]) <= rans.SIDE_BY_SIDE for p in parts if p.stop - p.start > 1)
    assert list(rans.together([])) == [] and list(rans.together([0, 0, 5])) == [slice(0, 3)]
