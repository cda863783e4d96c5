"""Merkle manifest of a table: a persistent tree whose versions share untouched nodes.

Rows are leaves; every ``FAN`` consecutive nodes become one, per group of rows and then
over the groups' subroots.  Trees are built and walked a block of ``FAN ** DEPTH``
aligned nodes at a time: a block's root is a leaf of the next round.  A changed leaf
is a version of its own.  It copies the ancestors within its block, shares all else,
and goes on above the block along the path that all leaves of the block have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import saved

FAN, DEPTH = 3, 7
BLOCK = FAN**DEPTH

# The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(**changed: Column) -> Column:
    """Lower-case hex sha256 of a row's fields: ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels(n: int) -> int:
    """Levels over n leaves until one node remains."""
    found = 0
    while n > 1:
        n, found = -(-n // FAN), found + 1
    return found


def parent(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def grow(leaves: list[bytes], height: int) -> list[list[bytes]]:
    """All levels of a block, leaves first.  Digests are hex text."""
    found = [leaves]
    for _ in range(height):
        below = found[-1]
        found.append([parent(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return found


def steps(tree: list[list[bytes]], i: int) -> list[tuple[int, list[bytes]]]:
    """From leaf i of a block upwards: the node's place in its run, and the run's others."""
    found = []
    for level in tree[:-1]:
        run, place = divmod(i, FAN)
        nodes = level[run * FAN : run * FAN + FAN]
        found.append((place, nodes[:place] + nodes[place + 1 :]))
        i = run
    return found


def copied(digest: bytes, path: list[tuple[int, list[bytes]]]) -> list[bytes]:
    """The ancestors that a version with another digest there has of its own, upwards."""
    found = []
    for place, others in path:
        digest = parent([*others[:place], digest, *others[place:]])
        found.append(digest)
    return found


def packed(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes((place, len(others))) + bytes.fromhex(b"".join(others).decode()) for place, others in path)


def unpacked(raw: bytes) -> list[tuple[int, list[bytes]]]:
    found, at = [], 0
    while at < len(raw):
        place, n = raw[at], raw[at + 1]
        others = raw[at + 2 : at + 2 + 32 * n].hex().encode()
        found.append((place, [others[64 * k : 64 * k + 64] for k in range(n)]))
        at += 2 + 32 * n
    return found


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each ``(tree, block)``, which are neighbours."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ["tree", "block", *columns]), strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def _in_blocks(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def climb(nodes: DataFrame) -> DataFrame:
    """``(tree, pos, n, digest)`` of the blocks of nodes of that form, each a node of the next round."""
    schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (tree, block), held in _blocks(batches, ["n", "digest"]):
                n = held[0][0]
                top = grow([d.hex().encode() for _, d in held], min(DEPTH, levels(n)))[-1]
                yield tree, block, -(-n // BLOCK), bytes.fromhex(top[0].decode())

        yield from _batches(rows(), schema)

    return _in_blocks(_with_block(nodes).select("tree", "block", "pos", "n", "digest"), "pos").mapInArrow(
        roots, "tree long, pos long, n long, digest binary"
    )


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, up to the one where every tree is a single node; written tables."""
    found = [nodes]
    while (found[-1].agg(F.max("n")).first()[0] or 1) > 1:
        found.append(saved(climb(found[-1]), "nodes"))
    return found


def _under(nodes: DataFrame, above: DataFrame, *columns: str) -> DataFrame:
    """Each block's nodes behind a row with what lies above it: ``above(tree, pos, path, ends)``."""
    empty = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in columns]
    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), *empty, "path", "ends")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("path", "ends")]
    bodies = _with_block(nodes).select("tree", "block", "pos", "n", *columns, *nothing)
    return _in_blocks(heads.union(bodies), "pos")


def descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``(tree, pos, path, ends)`` of one round's nodes, given those of the round above."""
    schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("path", pa.binary()), ("ends", pa.binary())])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (tree, _), held in _blocks(batches, ["pos", "n", "digest", "path", "ends"]):
                (*_, onward, ends), *own = held
                built = grow([row[2].hex().encode() for row in own], min(DEPTH, levels(own[0][1])))
                for i, row in enumerate(own):
                    yield tree, row[0], packed(steps(built, i)) + onward, ends

        yield from _batches(rows(), schema)

    return _under(nodes, above, "digest").mapInArrow(paths, "tree long, pos long, path binary, ends binary")


def above_leaves(found: list[DataFrame], top: DataFrame) -> DataFrame:
    """What lies above the first round's blocks; ``top(tree, pos, path, ends)`` lies above the last round's nodes."""
    for nodes in reversed(found[1:]):
        top = saved(descend(nodes, top), "paths")
    return top


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows in order, cut into ranges, with ``part`` and their place ``nth`` among all ranges' rows; a written table."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ranged.withColumn("nth", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "ordered")


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves ``(tree, pos, n, doc_id, digest, altered)`` and their trees ``(tree, source, n)``.

    A leaf's place follows from counts by range and source: as many rows as there are
    ranges and sources, whatever the number of leaves.
    """
    ordered = _numbered(docs, "source", "doc_id", "digest")
    runs = saved(ordered.groupBy("source", "part").agg(F.min("nth").alias("from_"), F.count("nth").alias("rows")), "runs")
    sizes = runs.groupBy("source").agg(F.sum("rows").alias("n"))
    named = _numbered(sizes, "source")
    starts = named.groupBy("part").agg(F.min("nth").alias("from_"), F.count("nth").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", "from_", before.alias("before"))  # a row a range
    trees = saved(named.join(starts, "part").select("source", "n", (F.col("nth") - F.col("from_") + F.col("before")).alias("tree")), "trees")
    earlier = F.sum("rows").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    known = runs.join(trees.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("part").alias("_part"), "_s", "tree", "n", F.col("from_").alias("_from"), F.coalesce(earlier, F.lit(0)).alias("_before")
    )
    same = (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_s"))
    leaves = ordered.join(known, same).select(
        "tree", (F.col("nth") - F.col("_from") + F.col("_before")).alias("pos"), "n", "doc_id", "digest", "altered"
    )
    return saved(leaves, "leaves"), trees


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(leaves: DataFrame, above: DataFrame, with_copies: bool = False) -> DataFrame:
    """A row for each leaf: its proof's digest and the root that its version folds to.

    With ``with_copies`` also ``copies``: the ancestors its version does not share.
    """
    names = [part.split()[0] for part in PROOFS.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    schema = pa.schema([*zip(names, kinds, strict=True), *[("copies", pa.list_(pa.string()))] * with_copies])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, held in _blocks(batches, ["n", "doc_id", "digest", "altered", "path", "ends"]):
                (*_, onward, ends), *own = held
                subroot, root = ends[:32].hex(), ends[32:].hex()
                tree = grow([row[2].hex().encode() for row in own], min(DEPTH, levels(own[0][0])))
                upper = unpacked(onward)
                rest = b"".join(x for _, others in upper for x in others)
                original = [tree[-1][0], *copied(tree[-1][0], upper)]  # the first version, above the block
                for i, (_, doc_id, digest, altered, _, _) in enumerate(own):
                    path = steps(tree, i)
                    siblings = b"".join(x for _, others in path for x in others)
                    copies = []
                    if altered is not None:
                        copies = [altered.hex().encode(), *copied(altered.hex().encode(), path)]
                        copies += copied(copies[-1], upper)
                    folded = (copies or original)[-1].decode()
                    proof = hashlib.sha256(siblings + rest).hexdigest()
                    row = (doc_id, digest.hex(), subroot, root, proof, folded, folded == root)
                    yield (*row, [x.decode() for x in copies]) if with_copies else row

        yield from _batches(rows(), schema)

    kind = PROOFS + ", copies array<string>" * with_copies
    return _under(leaves, above, "doc_id", "digest", "altered").mapInArrow(fold, kind)


def without_line_ends() -> tuple[Column, Column]:
    """Which rows are tampered with (an even checksum of the decimal doc_id), and their leaf without line ends in the text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return even, leaf(text=F.replace("text", F.lit("\n"), F.lit("")))


def manifest(docs: DataFrame, *, tampered: tuple[Column, Column] | None = None, with_copies: bool = False) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    Leaves of one source ascend by doc_id (null first; rows of one id by digest);
    subroots by source, null first, bytewise.  ``proof_sha256`` is the digest of the
    leaf's siblings from its run up to the root, left to right; without siblings that
    of nothing.  ``tampered`` tells which rows have another leaf (null: not), and which; ``folded_root`` is the
    root of that leaf's version, else the root, and ``verified`` whether they are equal.

    Null fields have a mark of their own in the leaf, equal rows are leaves each, an
    empty table gives no rows; columns other than ``FIELDS`` are ignored.
    """
    which, other = tampered or (F.lit(False), F.lit(None).cast("string"))
    leaves = docs.select(
        "source", F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf()).alias("digest"), F.when(which, F.unhex(other)).alias("altered")
    )
    leaves, trees = _placed(leaves)
    own = rounds(leaves.select("tree", "pos", "n", "digest"))
    subroots = own[-1].select("tree", "digest")

    n = trees.count()
    tops = rounds(saved(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("n"), "digest"), "subroots"))
    root = tops[-1].select("tree", "pos", F.lit(b"").alias("path"), F.col("digest").alias("ends"))
    over = descend(tops[0], above_leaves(tops, root))
    # above a source's last node: its subroot's path
    named = over.select(F.col("pos").alias("tree"), "path", "ends").join(subroots, "tree")
    top = saved(named.select("tree", F.lit(0).cast("long").alias("pos"), "path", F.concat("digest", "ends").alias("ends")), "paths")
    return prove(leaves, above_leaves(own, top), with_copies)


def manifest_sql() -> str:
    """The tampered manifest over ``documents`` in DuckDB's SQL; for small tables."""

    def hashed(text: str) -> str:
        values = [f"cast({name} as varchar)" if name != "text" else text for name in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    return f"""
with recursive marked as (
  select doc_id, source, {hashed("text")} as leaf, {hashed("replace(text, chr(10), '')")} as other,
         list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(doc_id as varchar), ''),
             lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end) as inverted_crc
  from documents
),
leaves as (
  select row_number() over (order by source nulls first, doc_id nulls first, leaf) as row,
         row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos,
         count(*) over (partition by source) as n,
         dense_rank() over (order by source nulls first) - 1 as tree,
         doc_id, leaf, case when inverted_crc % 2 = 1 then other else leaf end as start
  from marked
),
nodes(tree, level, pos, n, digest) as (
  select tree, 0, pos, n, leaf from leaves
  union all
  select tree, level + 1, pos // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' order by pos))
  from nodes where n > 1 group by tree, level, pos // {FAN}
),
subroots as (select tree, digest, count(*) over () as n from nodes where n = 1),
tops(level, pos, n, digest) as (
  select 0, tree, n, digest from subroots
  union all
  select level + 1, pos // {FAN}, (max(n) + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' order by pos))
  from tops where n > 1 group by level, pos // {FAN}
),
every as (
  select tree, level, pos, n, digest from nodes union all select -1, level, pos, n, digest from tops
),
runs as (select tree, level, pos // {FAN} as run, list({{'pos': pos, 'digest': digest}} order by pos) as members
         from every where n > 1 group by all),
climbed(row, tree, top, level, pos, n, digest, proof) as (
  select row, tree, tree, 0, pos, n, start, '' from leaves
  union all
  select row, case when n = 1 then -1 else c.tree end, c.top, case when n = 1 then 0 else c.level + 1 end,
         case when n = 1 then c.top else c.pos // {FAN} end,
         case when n = 1 then (select count(*) from subroots) else (n + {FAN - 1}) // {FAN} end,
         case when n = 1 then digest else
           sha256(array_to_string(list_transform(members, lambda m: case when m.pos = c.pos then digest else m.digest end), '')) end,
         case when n = 1 then proof else
           proof || array_to_string(list_transform(list_filter(members, lambda m: m.pos <> c.pos), lambda m: m.digest), '') end
  from climbed c left join runs r on r.tree = c.tree and r.level = c.level and r.run = c.pos // {FAN}
  where not (c.tree = -1 and n = 1)
)
select l.doc_id, l.leaf, s.digest as subroot, root.digest as root, sha256(c.proof) as proof_sha256,
       c.digest as folded_root, c.digest = root.digest as verified
from leaves l join climbed c on c.row = l.row and c.tree = -1 and c.n = 1
join subroots s on s.tree = l.tree cross join (select digest from tops where n = 1) root"""
