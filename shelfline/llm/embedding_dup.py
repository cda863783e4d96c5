"""Near-duplicate embeddings: Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so that a cosine is a distance (``|x - y|**2 = 2 - 2 cos``).
A table's hash is ``k`` quantised random projections ``floor((a.x + b) / w)``; rows
meet if they agree on all of them in one of ``L`` tables.  ``k`` follows from the
number of different vectors (a bucket of unrelated ones holds about ``CROWD``) and
``L`` from ``k``: a pair exactly at the threshold misses every table with chance
``MISS``, whatever the size of the table; closer pairs are missed far less often.

Crowded buckets are settled by balls.  All vectors within half the threshold's angle
of one leader are linked with each other (angles add up), so they are counted
without being paired.  Only pairs across balls are compared, in tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import binaries, saved
from shelfline.llm.graph import components
from shelfline.llm.words import U, mix, seeds

#: Unrelated vectors that a bucket holds by design.
CROWD = 256
#: Chance that a pair exactly at the threshold meets in no table.
MISS = 1e-5
#: Quantisation width as a multiple of the threshold's distance.
WIDTH = 4.0
#: Members outside a bucket's largest ball that one task holds at a time.
HELD = 512
#: Buckets above so many members look for balls.
CROWDED = 2 * CROWD
#: Components and projections become integers by these factors, so that sums are exact in any order.
UNIT, STEP = 1 << 24, 1 << 12
TABLE_BITS = 12


class Tables(NamedTuple):
    """The hash family: ``tables`` tables of ``rows`` projections of width ``width``."""

    rows: int
    tables: int
    width: float


def meets(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection agrees for two points so far apart."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def family(n: int, cosine: float, miss: float = MISS) -> Tables:
    """Parameters for n vectors; only logarithms of n enter."""
    near = math.sqrt(2 - 2 * cosine)
    width = WIDTH * near
    close, apart = meets(near, width), meets(math.sqrt(2), width)
    rows = max(1, math.ceil(math.log(max(n, 1) / CROWD) / -math.log(apart)))
    tables = math.ceil(math.log(miss) / math.log1p(-(close**rows)))
    if tables >= 1 << TABLE_BITS:
        raise ValueError(f"{tables} tables for {n} vectors at cosine {cosine}: lower the recall or raise CROWD")
    return Tables(rows, tables, width)


_projections: dict[tuple[int, Tables], tuple[np.ndarray, np.ndarray]] = {}


def projections(dim: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Fixed Gaussian directions and offsets of a family, in whole steps."""
    if (dim, tables) not in _projections:
        draw = np.random.Generator(np.random.PCG64([dim, tables.rows, tables.tables]))
        n = tables.rows * tables.tables
        lines = np.rint(draw.standard_normal((dim, n)) * STEP)
        offsets = np.rint(draw.random(n) * tables.width * UNIT * STEP)
        _projections.clear()
        _projections[dim, tables] = lines, offsets
    return _projections[dim, tables]


def bucket_keys(units: np.ndarray, tables: Tables) -> np.ndarray:
    """A row of bucket keys for each unit vector; a key's last bits are its table."""
    dim = units.shape[1]
    lines, offsets = projections(dim, tables)
    cells = np.floor((np.rint(units * UNIT) @ lines + offsets) / (tables.width * UNIT * STEP)).astype(np.int64).view(U)
    cells = cells.reshape(len(units), tables.tables, tables.rows) * seeds(tables.rows, 41)
    table = np.arange(tables.tables, dtype=U)
    keys = mix(cells.sum(axis=2, dtype=U) + seeds(1, dim)[0] + mix(table + U(1)))
    return ((keys & ~U((1 << TABLE_BITS) - 1)) | table).view(np.int64)


def lengths(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles over their largest component, and their Euclidean lengths: neither over- nor underflows."""
    rows = rows.astype(np.float64)
    largest = np.abs(rows).max(axis=1, initial=0.0)
    rows = rows / np.where((largest > 0) & np.isfinite(largest), largest, 1.0)[:, None]
    return rows, np.sqrt(np.einsum("ij,ij->i", rows, rows))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y."""
    (x, nx), (y, ny) = lengths(x), lengths(y)
    return np.einsum("ij,ij->i", x, y) / (nx * ny)


def _units(rows: np.ndarray) -> np.ndarray:
    rows, n = lengths(rows)
    return rows / n[:, None]


def _digests(rows: np.ndarray) -> np.ndarray:
    """64 bits of each row's components (0.0 and -0.0 count as one)."""
    bits = (rows.astype("<f8") + 0.0).view(U)
    return mix((mix(bits + U(1)) * seeds(bits.shape[1], 43)).sum(axis=1, dtype=U)).view(np.int64)


def _by_length(column: pa.Array, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows that hold one vector length: their positions and their components; null rows are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    offsets = column.offsets.to_numpy()
    first, size = offsets[:-1][there].astype(np.int64), np.diff(offsets)[there]
    values = column.values.to_numpy(zero_copy_only=False)
    values = values.astype(kind) if values.dtype != kind else values  # a null component is NaN
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield there[at], values[first[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0), kind)


def _kind(df: DataFrame, column: str) -> np.dtype:
    return np.dtype("<f4" if df.schema[column].dataType.elementType.simpleString() == "float" else "<f8")


def sign(vectors: DataFrame, kind: np.dtype) -> DataFrame:
    """``(id, vec, dim, c)`` of ``vectors(id, embedding)``: components, their number, digest; null for unusable vectors."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, used = batch.column("id"), [np.zeros(0, np.int64)]
            for at, rows in _by_length(batch.column("embedding"), kind):
                good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
                at, rows = at[good], rows[good]
                used.append(at)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), binaries(rows.ravel(), np.full(len(at), rows.shape[1])),
                         pa.array(np.full(len(at), rows.shape[1]), pa.int32()), pa.array(_digests(rows))],
                        ["id", "vec", "dim", "c"],
                    )
            rest = np.setdiff1d(np.arange(len(batch)), np.concatenate(used))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rest)), pa.nulls(len(rest), pa.binary()), pa.nulls(len(rest), pa.int32()), pa.nulls(len(rest), pa.int64())],
                ["id", "vec", "dim", "c"],
            )

    return vectors.mapInArrow(digest, "id long, vec binary, dim int, c long")


def _matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Binary rows of one width as a matrix."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1)


def keyed(reps: DataFrame, tables: Tables, kind: np.dtype) -> DataFrame:
    """``(c, n, keys)`` of ``reps(c, n, dim, vec)``: a bucket key for each table."""

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, len(at) // 1024 + 1):
                    some = batch.take(pa.array(part))
                    keys = bucket_keys(_units(_matrix(some.column("vec"), kind)), tables)
                    bounds = pa.array(np.arange(len(part) + 1, dtype=np.int32) * tables.tables)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("c"), some.column("n"), pa.ListArray.from_arrays(bounds, pa.array(keys.ravel()))], ["c", "n", "keys"]
                    )

    return reps.mapInArrow(hash_rows, "c long, n long, keys array<long>")


def balls(met: DataFrame, buckets: DataFrame, reps: DataFrame, cosine: float, kind: np.dtype) -> DataFrame:
    """``(c, ball)``: vectors of crowded buckets and the leader within half the threshold's angle of them.

    A bucket's leader is the member that meets the most others over all its buckets;
    a vector takes the leader that meets the most.
    """
    scores = met.join(buckets, "key").groupBy("c").agg(F.sum("size").alias("score"))
    crowded = met.join(buckets.where(F.col("size") > CROWDED), "key").select("key", "c").join(scores, "c")
    leaders = crowded.groupBy("key").agg(F.max(F.struct("score", (-F.col("c")).alias("minus"))).alias("m"))
    led = crowded.join(leaders, "key").select("c", (-F.col("m.minus")).alias("leader"), F.col("m.score").alias("score")).distinct()
    led = led.join(reps.select("c", "dim", "vec"), "c")
    led = led.join(reps.select(F.col("c").alias("leader"), F.col("dim").alias("leader_dim"), F.col("vec").alias("leader_vec")), "leader")
    led = led.where("dim = leader_dim").select("c", "leader", "score", "dim", "vec", "leader_vec")
    least = math.cos(math.acos(cosine) / 2) + 1e-9

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                near = cosines(_matrix(some.column("vec"), kind), _matrix(some.column("leader_vec"), kind)) >= least
                yield some.select(["c", "leader", "score"]).filter(pa.array(near))

    near = led.mapInArrow(within, "c long, leader long, score long")
    best = near.groupBy("c").agg(F.max(F.struct("score", (-F.col("leader")).alias("minus"))).alias("m"))
    return best.select("c", (-F.col("m.minus")).alias("ball"))


def _tiles(met: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows ``key, chunk, role, c, n, ball, main, vec`` of ``met(key, c, ball)``: what has to be compared.

    Members outside a bucket's largest ball are dealt over chunks of ``HELD`` and held
    there (role 0); the largest ball and the other chunks' members stream by (role 1).
    """
    kinds = met.groupBy("key", "ball").agg(F.count("c").alias("size"))
    mixed = kinds.groupBy("key").agg(F.max(F.struct("size", "ball")).alias("m"), F.sum("size").alias("size"))
    outside = F.col("size") - F.col("m.size")
    mixed = mixed.where(outside > 0).select("key", F.col("m.ball").alias("main"), F.ceil(outside / HELD).cast("int").alias("chunks"))
    dealt = met.join(mixed, "key")
    own = F.when(F.col("ball") != F.col("main"), F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
    roles = dealt.withColumn("own", own).withColumn("chunk", F.explode(everywhere))
    roles = roles.select(
        "key", "chunk", F.when(F.col("chunk") == F.col("own"), 0).otherwise(1).alias("role"), "c", "ball", F.col("own").isNull().alias("main")
    )
    return roles.join(reps.select("c", "n", "vec"), "c")


def compare(tiles: DataFrame, cosine: float, tables: Tables, kind: np.dtype) -> DataFrame:
    """``(c, links, node, other)``: counts of linked vectors outside a vector's ball, and edges between balls.

    A pair is counted in the first table it shares only.  Pairs are told by a product
    of tiles and settled by ``cosines``.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        out: list[tuple[np.ndarray, ...]] = []

        def linked(x: dict, y: dict) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.nonzero(x["unit"] @ y["unit"].T >= cosine - 1e-9)
            apart = x["ball"][i] != y["ball"][j]
            i, j = i[apart], j[apart]
            for_sure = np.concatenate([np.zeros(0, bool), *(
                cosines(x["raw"][i[s : s + 65536]], y["raw"][j[s : s + 65536]]) >= cosine for s in range(0, len(i), 65536)
            )])
            return i[for_sure], j[for_sure]

        def first_here(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether the pairs share no earlier table."""
            table = group[0] & ((1 << TABLE_BITS) - 1)
            if not table or not len(i):
                return np.ones(len(i), bool)
            a, at_i = np.unique(i, return_inverse=True)
            b, at_j = np.unique(j, return_inverse=True)
            ka, kb = bucket_keys(x["unit"][a], tables)[:, :table], bucket_keys(y["unit"][b], tables)[:, :table]
            parts = [(ka[at_i[s : s + 65536]] == kb[at_j[s : s + 65536]]).any(axis=1) for s in range(0, len(i), 65536)]
            return ~np.concatenate(parts)

        def settle() -> None:
            """Pairs among those held."""
            held.update({k: np.concatenate(v) for k, v in held["pieces"].items()}, pieces=None)
            held["unit"] = _units(held["raw"])
            i, j = linked(held, held)
            fresh = first_here(held, held, i, j)
            held["links"] = np.bincount(i[fresh], held["n"][j[fresh]], len(held["c"])).astype(np.int64)
            held["joined"] = np.zeros((len(held["c"]), len(held["c"])), bool)
            held["joined"][i, j] = True

        def pass_by(y: dict) -> None:
            """Pairs of those held with some that stream by."""
            i, j = linked(held, y)
            if not len(i):
                return
            fresh = first_here(held, y, i, j)
            held["links"] += np.bincount(i[fresh], y["n"][j[fresh]], len(held["c"])).astype(np.int64)
            main = y["main"][j]  # members of other chunks are counted where they are held
            own = np.bincount(j[fresh & main], held["n"][i[fresh & main]], len(y["c"])).astype(np.int64)
            some, at = np.unique(j, return_index=True)
            out.append((y["c"][some], own[some], y["ball"][some], held["ball"][i[at]]))
            grid = np.zeros((len(y["c"]), len(held["c"])), np.float32)
            grid[j, i] = 1
            held["joined"] |= (grid.T @ grid) > 0

        def close() -> None:
            """Counts of those held, each with an edge to the first of its component here."""
            if held["pieces"]:
                settle()
            label = np.arange(len(held["c"]))
            while True:
                least = np.where(held["joined"], label[None, :], len(label)).min(axis=1, initial=len(label))
                after = np.minimum(label, least)
                if (after == label).all():
                    break
                label = after
            some = np.flatnonzero((held["links"] > 0) | (label != np.arange(len(label))))
            out.append((held["c"][some], held["links"][some], held["ball"][some], held["ball"][label[some]]))

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([np.zeros(0, np.int64), *(row[k] for row in out)]) for k in range(4)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["c", "links", "node", "other"])

        for batch in batches:
            column = {k: batch.column(k).to_numpy() for k in ("key", "chunk", "role", "c", "n", "ball")}
            column["main"] = batch.column("main").to_numpy(zero_copy_only=False).astype(bool)
            marks = np.stack([column["key"], column["chunk"].astype(np.int64), column["role"].astype(np.int64)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if a == b:
                    continue
                if group != (here := (int(column["key"][a]), int(column["chunk"][a]))):
                    if held:
                        close()
                    group, held = here, {"pieces": {k: [] for k in ("c", "n", "ball", "raw")}}
                piece = {k: column[k][a:b] for k in ("c", "n", "ball", "main")}
                piece["raw"] = _matrix(batch.column("vec").slice(a, b - a), kind)
                if column["role"][a] == 0:
                    for k in held["pieces"]:
                        held["pieces"][k].append(piece[k])
                    continue
                if held["pieces"]:
                    settle()
                piece["unit"] = _units(piece["raw"])
                pass_by(piece)
            yield flush()
        if held:
            close()
            yield flush()

    columns = ["key", "chunk", "role", "c", "n", "ball", "main", "vec"]
    return (
        tiles.select(columns).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "role", "c")
        .mapInArrow(check, "c long, links long, node long, other long")
    )


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, miss: float = MISS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Two vectors are linked if their cosine, in doubles, is ``cosine`` or more; one such
    pair in ``1 / miss`` is not found if it lies exactly there, fewer above.
    ``n_links`` counts the other vectors linked directly, equal ones included;
    ``component_id`` is the smallest id reachable over links and ``kept`` marks it.

    Vectors that are null, empty or all zero, or that hold a null or non-finite
    component, are linked with nothing, as are rows without id (their component is
    null, they are kept) and vectors of different lengths with each other.  Repeated
    rows are one vector and all get its result; different vectors of one id are
    counted as vectors of their own.  Other columns are ignored.
    """
    kind = _kind(vectors, vector_col)
    signed = saved(sign(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")), kind), "signed")
    usable = signed.where("id is not null and c is not null")
    classes = usable.select("c", "id").distinct().groupBy("c").agg(F.min("id").alias("id"), F.count("id").alias("n"))
    reps = saved(usable.join(classes, ["c", "id"]).dropDuplicates(["c"]), "classes")
    tables = family(reps.count(), cosine, miss)
    members = saved(keyed(reps, tables, kind), "keys").select("c", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("c").alias("size")).where("size > 1")
    met = saved(members.join(buckets.select("key"), "key"), "met")
    ball = saved(balls(met, buckets, reps, cosine, kind), "balls")
    placed = met.join(ball, "c", "left").withColumn("ball", F.coalesce("ball", "c"))
    found = saved(compare(_tiles(placed, reps), cosine, tables, kind), "found")

    inside = ball.join(reps.select("c", "n"), "c").groupBy("ball").agg(F.sum("n").alias("inside"))
    across = found.groupBy("c").agg(F.sum("links").alias("across"))
    # a leader may lie in another's ball; it is linked with all of its own
    edges = found.select(F.col("node").alias("a"), F.col("other").alias("b")).union(
        inside.select(F.col("ball").alias("c")).join(ball.withColumnRenamed("ball", "of"), "c").select(F.col("of").alias("a"), F.col("c").alias("b"))
    )
    labels = components(edges.where("a <> b").distinct())
    counted = (
        reps.select("c", "id", "n").join(ball, "c", "left").join(inside, "ball", "left").join(across, "c", "left")
        .withColumn("n_links", F.coalesce("inside", "n") - 1 + F.coalesce("across", F.lit(0)))
        .withColumn("node", F.coalesce("ball", "c"))
        .join(labels.withColumnRenamed("id", "node"), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    counted = saved(counted.select("c", "id", "n_links", "component"), "counted")
    least = counted.groupBy("component").agg(F.min("id").alias("least"))
    results = counted.join(least, "component").select("c", "n_links", "least")
    out = signed.select("id", F.when(F.col("id").isNotNull(), F.col("c")).alias("c")).join(results, "c", "left")
    own: Column = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )


def near_duplicates_sql(cosine: float) -> str:
    """The same over ``embeddings`` in DuckDB's SQL, by comparing all vectors; for small tables."""
    return f"""
with recursive vectors as (
  select vec_id, embedding::double[] as x from embeddings
  where vec_id is not null and len(embedding) > 0
    and list_bool_and(list_transform(embedding, lambda e: coalesce(isfinite(e), false)))
    and list_bool_or(list_transform(embedding, lambda e: e <> 0))
),
links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= {cosine}
),
reached(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, b from reached r join links on other = a
),
least as (select vec_id, min(other) as component_id from reached group by vec_id),
degrees as (select a as vec_id, count(*) as n_links from links group by a)
select e.vec_id, coalesce(n_links, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e left join least using (vec_id) left join degrees using (vec_id)"""
