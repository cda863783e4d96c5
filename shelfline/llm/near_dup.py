"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges.

A document's set holds the hashes of its distinct word shingles.  Equal sets are
one class from the start; classes meet in banded buckets of their signatures; in
a bucket only stars are drawn, and each drawn edge is confirmed on the two full
sets.  The parameters make a miss at the threshold a matter of 4e-8 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import blocks, saved
from shelfline.llm.graph import components
from shelfline.llm.words import LOWERED, U, hash_spans, mix, seeds, shingles, sorted_sets, spans

BANDS, ROWS = 56, 6
BINS = BANDS * ROWS
#: Bins of the finer signature by which likely pairs are told.
FINE = 1024
#: Members of a star confirmed in one group; a larger star is dealt over several.
STAR = 64
#: Members outside a bucket's largest component that are matched in one group.
OUTSIDERS = 512


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes of a batch's texts, block by block: sorted sets and their bounds."""
    for block in blocks(batch.column(column)):
        words = spans(block)
        hashes = hash_spans(block.data, words.starts, words.ends, LOWERED)
        yield sorted_sets(*shingles(hashes, words.bounds, width))


def _orders(bins: int) -> np.ndarray:
    """Row j: the order in which empty bin j looks at all bins, a fixed shuffle of its own."""
    return np.argsort(seeds(bins * bins, 23).reshape(bins, bins), axis=1).astype(np.int32)


ORDERS, FINE_ORDERS = _orders(BINS), _orders(FINE)
ROW_ODDS, BAND_SEEDS = seeds(ROWS, 31), seeds(BANDS, 37)


def minhashes(values: np.ndarray, bounds: np.ndarray, orders: np.ndarray = ORDERS) -> np.ndarray:
    """For each set, the least hash of each of ``len(orders)`` equal ranges of one permutation.

    An empty bin copies the first filled one of its own order of bins (optimal
    densification), so bins agree with the sets' Jaccard similarity even when
    there are fewer shingles than bins.  Rows of empty sets are zero.
    """
    n, size = len(bounds) - 1, len(orders)
    text = np.repeat(np.arange(n), np.diff(bounds))
    cell = text * size + (((values >> U(32)) * U(size)) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else cell
    out, filled = np.zeros((n, size), U), np.zeros((n, size), bool)
    out.flat[cell[first]] = values[first]
    filled.flat[cell[first]] = True
    rows, bins = np.nonzero(~filled & (np.diff(bounds) > 0)[:, None])
    for step in range(size):
        if not len(rows):
            break
        donor = orders[bins, step]
        found = filled[rows, donor]
        out[rows[found], bins[found]] = out[rows[found], donor[found]]
        rows, bins = rows[~found], bins[~found]
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` bucket keys for each row of minhashes; a key's last six bits are its band."""
    rows = found.reshape(-1, BANDS, ROWS) * ROW_ODDS
    keys = mix(rows.sum(axis=2, dtype=U) + BAND_SEEDS)
    return ((keys & ~U(63)) | np.arange(BANDS, dtype=U)).view(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each set, modulo 2**64."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(values, dtype=U)))
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``(id, n, h1, h2, bands)`` of each row of ``docs(id, text)``: set size, digest, bucket keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for values, bounds in shingle_sets(batch, "text", width):
                size = np.diff(bounds)
                least = minhashes(values, bounds)
                keys = band_keys(least)[size > 0]
                at = np.concatenate(([0], np.cumsum((size > 0) * BANDS))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, len(size)), pa.array(size, pa.int64()),
                     pa.array(_sums(values, bounds)), pa.array(_sums(mix(values), bounds)),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))],
                    ["id", "n", "h1", "h2", "bands"],
                )
                row += len(size)

    return docs.mapInArrow(sign, "id long, n long, h1 long, h2 long, bands array<long>")


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """``(id, sketch, keys)`` of ``texts(id, text)``: a byte of each fine minhash, four of each bucket key.

    Of the sketch's bytes, a little over J agree.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for values, bounds in shingle_sets(batch, "text", width):
                fine = mix(minhashes(values, bounds, FINE_ORDERS)).astype(np.uint8)
                keys = (band_keys(minhashes(values, bounds)).view(U) >> U(6)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, len(fine)), pa.array([x.tobytes() for x in fine], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())],
                    ["id", "sketch", "keys"],
                )
                row += len(fine)

    return texts.mapInArrow(sketch, "id long, sketch binary, keys binary")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those ``pairs(a, b)`` whose full sets overlap by ``percent`` of their union.

    Pairs are grouped around ``a``: its text travels once for every ``STAR``
    members, so a hub with millions of members is spread over many groups.
    """
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("b") / STAR).alias("groups")), "a")
    dealt = sized.select("a", "b", F.pmod(F.hash("b"), "groups").alias("salt"))
    roles = dealt.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("member")).union(
        dealt.select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("member")).distinct()
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets = None, []
        for batch in batches:
            a, salt, member, ids = (batch.column(c).to_pylist() for c in ("a", "salt", "member", "id"))
            linked_a, linked_b = [], []
            found_sets = (v[at[i] : at[i + 1]] for v, at in shingle_sets(batch, "text", width) for i in range(len(at) - 1))
            for i, found in enumerate(found_sets):
                if hub != (a[i], salt[i]):
                    hub, sets = (a[i], salt[i]), []
                if not member[i]:
                    sets.append(found)
                    continue
                for other in sets:
                    common = len(np.intersect1d(found, other, assume_unique=True))
                    if common and 100 * common >= percent * (len(found) + len(other) - common):
                        linked_a.append(a[i])
                        linked_b.append(ids[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(linked_a, pa.int64()), pa.array(linked_b, pa.int64())], ["a", "b"])

    return (
        texts.join(roles, "id")
        .select("a", "salt", "member", "id", "text")
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", "member")
        .mapInArrow(check, "a long, b long")
    )


def _sizes_allow(x: str, y: str, percent: int):
    """Sets of these sizes can reach the threshold at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _likely(percent: int) -> float:
    """Agreement of sketches that a pair at the threshold falls short of once in a million times."""
    share = percent / 100
    return FINE * share - 4.75 * (FINE * share * (1 - share)) ** 0.5


def leftover(met: DataFrame, labels: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that share a bucket of ``met(id, n, key)``, lie in different components and are likely.

    In each bucket the members outside its largest component are set against all
    members, by sketch.  A pair is given in the first band it shares only.  A bucket is dealt over as many groups as its outsiders need; members stream by.
    """
    apart = met.select("id", "n", "key").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    kinds = apart.groupBy("key", "component").agg(F.count("id").alias("size"))
    largest = kinds.groupBy("key").agg(F.max(F.struct("size", (-F.col("component")).alias("minus"))).alias("c"), F.sum("size").alias("size"))
    mixed = largest.where("c.size < size").select(
        "key", (-F.col("c.minus")).alias("main"), F.ceil((F.col("size") - F.col("c.size")) / OUTSIDERS).alias("groups")
    )
    apart = apart.join(mixed, "key")
    outside = apart.where("component <> main").withColumn("chunk", F.pmod(F.hash("id"), "groups")).withColumn("member", F.lit(0))
    everyone = apart.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).withColumn("member", F.lit(1))
    columns = ["key", "chunk", "member", "id", "component", "n"]
    rows = outside.select(columns).union(everyone.select(columns)).join(sketched, "id")
    floor = _likely(percent)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ours, table = None, [], None
        for batch in batches:
            keys, chunks, roles, ids, parts, sizes = (batch.column(c).to_pylist() for c in ("key", "chunk", "member", "id", "component", "n"))
            data, bands = (np.array([np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]) for c, kind in (("sketch", "u1"), ("keys", "<u4")))
            found_a, found_b, i = [], [], 0
            while i < len(ids):
                if group != (keys[i], chunks[i]):
                    group, ours, table = (keys[i], chunks[i]), [], None
                if not roles[i]:
                    ours.append((ids[i], parts[i], sizes[i], data[i], bands[i]))
                    i += 1
                    continue
                j = i
                while j < len(ids) and j < i + 32 and group == (keys[j], chunks[j]):
                    j += 1
                if table is None:
                    table = [np.array([o[k] for o in ours]) for k in range(5)]
                own_id, own_part, own_n, own, own_bands = table
                alike = (data[i:j, None, :] == own[None, :, :]).sum(axis=2)
                there, here = np.array(ids[i:j])[:, None], np.array(parts[i:j])[:, None]
                n = np.array(sizes[i:j])[:, None]
                likely = (alike >= floor) & (here != own_part) & (100 * np.minimum(n, own_n) >= percent * np.maximum(n, own_n))
                for m, o in zip(*np.nonzero(likely), strict=True):
                    if int((bands[i + m] == own_bands[o]).argmax()) == keys[i] & 63:
                        found_a.append(int(own_id[o]))
                        found_b.append(int(there[m, 0]))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    matched = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "member", "id").mapInArrow(match, "a long, b long")
    once = matched.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.struct("a", "b")).alias("p"))
    return once.select("p.a", "p.b")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered.  Rows are linked if their
    sets of ``width``-word shingles overlap by ``percent`` of the union or more;
    ``component_id`` is the smallest id reachable over links and ``kept`` marks it.

    Stars: an id first joins the centre it shares most buckets with, the centre
    of a bucket being the member that meets the most others over all its buckets
    (the original among its edited copies).  In buckets whose members are then still
    in different components, those outside the largest one are matched with all
    members by finer signatures, and every partner whose signature allows the
    threshold is confirmed.  There is no cap on candidates; edges within a component
    are not drawn, and a group of copies is settled by its star.

    Null, empty or wordless texts have an empty set and are linked with nothing.
    A row without id is linked with nothing and kept (its component is null).
    Rows of one id are one document.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = saved(signatures(docs, width), "signatures")
    named = signed.where("id is not null and n > 0")
    classes = saved(named.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = named.join(classes.withColumnRenamed("rep", "id"), ["id", "h1", "h2", "n"], "left_semi")
    labels = _labels(reps.select("id", "n", "bands"), docs, width, percent)
    settled = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "h1", "h2", "n", F.coalesce("component", "rep").alias("component")
    )
    out = signed.select("id", "n", "h1", "h2").join(settled, ["h1", "h2", "n"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )


def without_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that stay when one document of each group does.

    Of rows with one id the first by a hash of the text stays; a row without id stays.
    """
    found = near_duplicates(docs, width=width, percent=percent)
    found = saved(found, "groups")
    gone = found.where("not kept").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti")
    often = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if often.isEmpty():
        return rest
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    again = rest.join(often, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return rest.join(often, "doc_id", "left_anti").unionByName(again).select(docs.columns)


def _labels(reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(id, component)`` of the linked classes among ``reps(id, n, bands)``."""
    members = reps.select("id", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("id").alias("size")).where("size > 1")
    met = saved(members.join(shared, "key"), "met")
    scores = met.groupBy("id").agg(F.sum("size").alias("score")).join(reps.select("id", "n"), "id")
    met = saved(met.select("key", "id").join(scores, "id"), "scored")
    texts = saved(docs.join(scores.select("id"), "id", "left_semi"), "candidates")

    about = F.struct("score", (-F.col("id")).alias("minus"), "n")
    centre = met.groupBy("key").agg(F.max(about).alias("c")).select("key", "c.minus", F.col("c.score").alias("top"), F.col("c.n").alias("cn"))
    drawn = met.join(centre, "key").where((F.col("id") != -F.col("minus")) & _sizes_allow("n", "cn", percent))
    votes = drawn.groupBy("id", "minus", "top").agg(F.count("n").alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "top", "minus")).alias("c"))
    pairs = saved(best.select((-F.col("c.minus")).alias("a"), F.col("id").alias("b")), "pairs")
    links = saved(confirm(pairs, texts, width, percent), "links")
    labels = components(links)

    pairs = saved(leftover(met, labels, sketches(texts, width), percent), "pairs")
    more = saved(confirm(pairs, texts, width, percent), "links")
    return labels if more.isEmpty() else components(links.union(more))


def near_duplicates_sql(width: int, percent: int) -> str:
    """The same over ``documents`` in DuckDB's SQL, by comparing all sets; for small tables."""
    return f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') as w
  from documents
),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= {width}
      then list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words
),
sizes as (select doc_id, count(s) as n from words left join shingles using (doc_id) group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
),
links as (
  select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id
  where 100 * c >= {percent} * (x.n + y.n - c)
),
reached(doc_id, other) as (
  select doc_id, doc_id from sizes union select r.doc_id, b from reached r join links on other = a
)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept
from sizes join (select doc_id, min(other) as component_id from reached group by doc_id) using (doc_id)"""
