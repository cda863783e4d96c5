import hashlib
import zlib

import pytest

from shelfline.llm import merkle as M
from shelfline.llm.queries import op13_path_copying_manifest

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))
    return sha("".join(values))


def root_of(nodes):
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0]


def siblings(nodes, i):
    found = []
    while len(nodes) > 1:
        first = i // 3 * 3
        found += [x for k, x in enumerate(nodes[first : first + 3], first) if k != i]
        nodes, i = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], i // 3
    return found


def expected(rows):
    """By rebuilding the whole manifest for every tampered row."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    docs = [(i, s, lang, n, text) for i, text, lang, s, n in rows]
    groups = {s: sorted((d for d in docs if d[1] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d))) for s in sources}
    leaves = {s: [leaf(*d) for d in groups[s]] for s in sources}
    subroots = [root_of(leaves[s]) for s in sources]
    root, out = root_of(subroots), []
    for k, s in enumerate(sources):
        for i, d in enumerate(groups[s]):
            folded = root
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None:
                changed = [*leaves[s][:i], leaf(*d[:4], d[4].replace("\n", "")), *leaves[s][i + 1 :]]
                folded = root_of([*subroots[:k], root_of(changed), *subroots[k + 1 :]])
            proof = sha("".join(siblings(leaves[s], i) + siblings(subroots, k)))
            out.append((d[0], leaves[s][i], subroots[k], root, proof, folded, folded == root))
    return sorted(out, key=str)


def result(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_equals_rebuilding(spark, monkeypatch, depth):
    """A hot source, many small ones, counts around powers of three, several rounds of blocks."""
    monkeypatch.setattr(M, "DEPTH", depth)
    monkeypatch.setattr(M, "BLOCK", M.FAN**depth)
    sizes = {"hot": 82, "ü": 27, "Z": 28, "a": 9, "b": 1, None: 3, "": 2, **{f"s{i}": 1 for i in range(12)}}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            k += 7919
            rows.append((k % 100_003, f"line {k}\nmore\n" if k % 3 else f"one line {k}", "en", source, k % 50))
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert result(M.manifest(df, tampered=M.without_line_ends())) == expected(rows)


def test_odd_documents(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert result(M.manifest(odd_docs, tampered=M.without_line_ends())) == expected(rows)


def test_query_on_sample(spark, sample_dir):
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert result(op13_path_copying_manifest(spark, sample_dir)) == expected(rows)


def test_untampered_table_is_verified(spark, odd_docs):
    assert {r.verified for r in M.manifest(odd_docs).collect()} == {True}


def test_version_copies_ancestors_only(spark):
    """A version's own nodes are its leaf and one node a level; they end in its root."""
    rows = [(i, "a\nb", "en", "x" if i < 30 else "y", 3) for i in range(40)]
    found = M.manifest(spark.createDataFrame(rows, SCHEMA), tampered=M.without_line_ends(), with_copies=True).collect()
    for r in found:
        if zlib.crc32(str(r.doc_id).encode()) % 2:
            assert r.copies == [] and r.verified
        else:
            assert len(r.copies) == 1 + M.levels(30 if r.doc_id < 30 else 10) + M.levels(2)
            assert r.copies[-1] == r.folded_root != r.root


def test_one_leaf_and_none(spark, no_docs):
    one = M.manifest(spark.createDataFrame([(5, "t", "en", "s", 1)], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf(5, "s", "en", 1, "t")
    assert one.proof_sha256 == sha("")
    assert M.manifest(no_docs).count() == 0
