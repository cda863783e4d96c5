"""Language of pages by Bayesian fusion of text, markup, address and host.

The posterior of a language multiplies the text's likelihood (byte trigrams of
labelled documents), the likelihood of what the markup declares, and a prior of
the host that is smoothed towards its address suffix and this towards all pages.
Declarations and priors are learned from the pages themselves by grouped sums of
posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import Block, blocks, saved
from shelfline.llm.wrapper import host_of

#: Trigrams are hashed to so many buckets.
BUCKETS = 1 << 14
#: Trigrams overlap and repeat: a text counts as at most so many independent ones.
MOST_EVIDENCE = 60.0
#: Pages' worth of trust in the level above: host in suffix, suffix in all pages, declaration in none.
HOST_TRUST, SUFFIX_TRUST, DECLARED_TRUST = 5.0, 20.0, 1.0

_ASIDES = "script style nav footer aside head form template svg".split()
_ASIDE = re.compile(rf"<({'|'.join(_ASIDES)})\b", re.I)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _ASIDES}
_ENTITY = re.compile(r"&[#\w]+;?")
_TAG = re.compile(r"<(html|meta)\b([^>]*)", re.I)
_LANG = re.compile(r"\slang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
_META = re.compile(r"http-equiv\s*=\s*[\"']?content-language[\"']?|property\s*=\s*[\"']?og:locale[\"']?", re.I)
_CONTENT = re.compile(r"\scontent\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)


def buckets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every three bytes that hold a letter in the middle, and the text of each."""
    data = block.data
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data < 91), data + np.uint8(32), data)
    letter = (low - np.uint8(97) < 26) | (low >= 0x80)
    low = np.where(letter, low, np.uint8(0x20)).astype(np.uint32)
    codes = (low[:-2] * 0x9E3779B1 + low[1:-1] * 0x85EBCA77 + low[2:] * 0xC2B2AE3D).astype(np.uint32) >> np.uint32(18)
    text = np.repeat(np.arange(len(block)), np.diff(block.offsets))
    keep = letter[1:-1] & (text[:-2] == text[2:])
    return codes[keep].astype(np.int64), text[:-2][keep]


def language_counts(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of ``docs(text, lang)`` in code point order, and for each the count of every bucket.

    All documents are counted; the driver gets at most ``BUCKETS`` numbers a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for block in blocks(batch.column("text")):
                codes, text = buckets(block)
                own = langs[block.first : block.first + len(block)]
                names = sorted(set(own))
                number = np.array([names.index(x) for x in own])
                found = np.bincount(number[text] * BUCKETS + codes, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, found, strict=True):
                    totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            seen = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(row[seen])], ["lang", "bucket", "n"])

    rows = docs.where("lang is not null").select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    out = np.zeros((len(names), BUCKETS))
    place = pc.index_in(found["lang"], value_set=pa.array(names, pa.string())).to_numpy()
    out[place, found["bucket"].to_numpy()] = found["n"].to_numpy()
    return names, out


def visible(page: str) -> str:
    """Text outside tags, comments, scripts, menus, footers and the like.

    One scan: an end that is not found once is not looked for again, so a page takes
    time in proportion to its length however many elements it leaves open.
    """
    out, at, i, open_ended = [], 0, page.find("<"), set()
    while i >= 0:
        end = -1
        if page.startswith("<!--", i) and "--" not in open_ended:
            found = page.find("-->", i + 4)
            end = found + 3 if found >= 0 else -1
            if end < 0:
                open_ended.add("--")
        elif (m := _ASIDE.match(page, i)) and (tag := m.group(1).lower()) not in open_ended:
            found = _END[tag].search(page, m.end())
            end = found.end() if found else -1
            if end < 0:
                open_ended.add(tag)
        if end < 0:  # the tag alone
            end = page.find(">", i) + 1
            if not end:
                break
        out.append(page[at:i])
        at, i = end, page.find("<", end)
    out.append(page[at:])
    return _ENTITY.sub(" ", " ".join(out))


def declared(page: str) -> str | None:
    """Language code of the markup's ``lang`` or of a header tag, lower case."""
    of_meta = None
    for m in _TAG.finditer(page):
        tag, attributes = m.groups()
        if tag.lower() == "html":
            if found := _LANG.search(attributes):
                return found.group(1).lower()
        elif of_meta is None and (kind := _META.search(attributes)) and (found := _CONTENT.search(attributes, kind.end())):
            of_meta = found.group(1).lower()
    return of_meta


def evidence(pages: DataFrame, names: list[str], counts: np.ndarray) -> DataFrame:
    """``(page_id, url, host, suffix, declared, ll)``: ``ll`` holds a log-likelihood for each language."""
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).T.copy() if names else np.zeros((BUCKETS, 0))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                html = part.column("html").to_pylist()
                said = [declared(p) if p else None for p in html]
                texts = pa.array([visible(p).encode("utf-8", "replace") if p else b"" for p in html], pa.large_binary())
                ll = np.zeros((len(html), len(names)))
                for block in blocks(texts):
                    codes, text = buckets(block)
                    n = np.bincount(text, minlength=len(block))
                    sums = np.stack([np.bincount(text, weights=logs[codes, k], minlength=len(block)) for k in range(len(names))], axis=1) if names else np.zeros((len(block), 0))
                    ll[block.first : block.first + len(block)] = sums * (np.minimum(n, MOST_EVIDENCE) / np.maximum(1, n))[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(html) + 1, dtype=np.int32) * len(names)), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("page_id", "url", "host", "suffix")), pa.array(said, pa.string()), lists],
                    ["page_id", "url", "host", "suffix", "declared", "ll"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    host = host_of("url")
    pages = pages.select("page_id", "url", "html").withColumn("host", host)
    pages = pages.withColumn("suffix", F.regexp_extract("host", r"\.([a-z][^.]*)$", 1))
    return pages.mapInArrow(weigh, f"page_id {kind}, url string, host string, suffix string, declared string, ll array<double>")


def softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sums(pages: DataFrame, *keys: str) -> DataFrame:
    """Sum of the posteriors ``q`` by key and language number."""
    return pages.select(*keys, F.posexplode("q").alias("k", "x")).groupBy(*keys, "k").agg(F.sum("x").alias("x"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``(page_id, url, host, suffix, declared, text_lang, lang, p)`` of every row of ``pages(page_id, url, html)``.

    ``docs(text, lang)`` teach what languages look like.  ``text_lang`` is the best
    by text alone, null without text; ``lang`` the best of the whole posterior and
    ``p`` its probability (ties: first by name).

    Null or empty html has no text and declares nothing; the host's prior decides.
    An address without host or suffix has the empty one.  Without labelled
    documents every language is null.  Other columns are ignored; repeated rows are
    judged alike.
    """
    names, counts = language_counts(docs)
    found = saved(evidence(pages, names, counts), "evidence")
    if not names:
        empty = F.lit(None).cast("string")
        return found.select("page_id", "url", "host", "suffix", "declared", empty.alias("text_lang"), empty.alias("lang"), F.lit(0.0).alias("p"))
    size = len(names)
    known = F.array(*map(F.lit, names))
    # what is declared: a known language by number, another (size) or nothing (size + 1)
    code = F.when(F.col("declared").isNull(), size + 1).otherwise(F.coalesce(F.nullif(F.array_position(known, F.col("declared")), F.lit(0)) - 1, F.lit(size)))
    found = found.withColumn("code", code.cast("int"))
    by_text = found.withColumn("q", softmax(F.col("ll")))
    said = np.full((size, size + 2), DECLARED_TRUST / (size + 2))
    for row in _sums(by_text, "code").collect():  # at most languages x (languages + 2)
        said[row["k"], row["code"]] += row["x"]
    said = np.log(said / said.sum(axis=1, keepdims=True))
    table = F.array(*(F.array(*(F.lit(float(said[k, c])) for k in range(size))) for c in range(size + 2)))
    judged = found.withColumn("both", added(F.col("ll"), F.element_at(table, F.col("code") + 1)))
    first = judged.withColumn("q", softmax(F.col("both")))

    overall = np.full(size, 1.0)
    host = saved(_sums(first, "host", "suffix"), "hosts")
    for row in host.groupBy("k").agg(F.sum("x").alias("x")).collect():  # one a language
        overall[row["k"]] += row["x"]
    overall = overall / overall.sum()
    base = F.element_at(F.array(*(F.lit(float(x)) for x in overall)), F.col("k") + 1)
    suffix = host.groupBy("suffix", "k").agg(F.sum("x").alias("x"))
    everything = suffix.groupBy("suffix").agg(F.sum("x").alias("n"))
    suffix = suffix.join(everything, "suffix").select("suffix", "k", ((F.col("x") + SUFFIX_TRUST * base) / (F.col("n") + SUFFIX_TRUST)).alias("above"))
    pages_of = host.groupBy("host").agg(F.sum("x").alias("n"))
    prior = host.join(pages_of, "host").join(suffix, ["suffix", "k"])
    prior = prior.withColumn("prior", (F.col("x") + HOST_TRUST * F.col("above")) / (F.col("n") + HOST_TRUST))
    prior = prior.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "prior"))).alias("prior"))
    prior = prior.select("host", F.transform("prior", lambda s: F.log(F.greatest(s["prior"], F.lit(1e-12)))).alias("prior"))

    posterior = judged.join(prior, "host").withColumn("q", softmax(added(F.col("both"), F.col("prior"))))
    best = lambda a: F.element_at(known, F.array_position(a, F.array_max(a)).cast("int"))
    has_text = F.exists("ll", lambda x: x != 0)
    return posterior.select(
        "page_id", "url", "host", "suffix", "declared", F.when(has_text, best(F.col("ll"))).alias("text_lang"),
        best(F.col("q")).alias("lang"), F.array_max("q").alias("p"),
    )
