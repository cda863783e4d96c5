"""Main text of pages by wrappers inferred for each host.

A page's markup is folded into a union-free regular expression: nested elements,
of which some are optional (``?``) or repeated (``+``), with text slots (``#``).
The expressions of a host's pages are aligned one after the other; where they
differ an element becomes optional, a run of elements a repeated group, a text a
slot.  The host's wrapper tells which of its elements hold the article, and every
page of the host is read by it.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import saved

# Names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
#: An opening tag ends an open element of these, up to the element that may hold them.
ENDS = {
    "li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))),
    "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))),
    "option": ("option", frozenset(("select",))),
}
#: Elements that never hold an article's text.
ASIDE = frozenset(
    "head title nav footer aside form button select input textarea script style noscript template iframe object svg canvas audio video dialog menu "
    "label fieldset datalist".split()
)
#: Words in class, id or role that name what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "discussion disqus dropdown footer masthead menu menubar modal nav navbar navigation newsletter notice notices notification alert overlay pagination "
    "pager popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "tagcloud toolbar topbar widget widgets login search contentinfo complementary toc".split()
)
#: Elements that may hold a whole article.
HOLDERS = frozenset("body div section main article center table tbody tr td details figure".split())
#: Not the article's text where no article is marked; an article may have a header of its own.
OUTSIDE = frozenset(("header",))
#: Elements that hold the page or the article whatever their names say (``class="has-sidebar"``).
WHOLE = frozenset("html body main article".split())
#: Of the words, those that never lie above an article of the page's own.
OTHERS_WORDS = frozenset("comment comments commentlist discussion disqus recommended related replies respond promo promoted promotion sponsored".split())
ARTICLE_WORDS = frozenset("article articlebody".split())
MAIN_WORDS = frozenset("main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Plain containers, whose names mostly tell what they hold: part of a name (``site-footer``) is enough.
CONTAINERS = frozenset("div ul ol dl table tbody tr td center figure details".split())
#: Of other elements only a whole name counts, and an id, which often is a heading's slug, on sections alone.
NAMED_BY_ID = CONTAINERS | {"section"}
#: Elements nested deeper than this belong to the one at this depth, as in browsers, whose limit is 512.
DEEPEST = 200


def aside_by_name(tag: str, names: list[str]) -> bool:
    """Whether names (``c:``, ``i:``, ``r:`` and a class, id or role) say that an element is aside of the article."""
    for name in names:
        kind, value = name[0], name[2:]
        if kind == "i" and tag not in NAMED_BY_ID:
            continue
        words = _NAME.findall(value) if tag in CONTAINERS else [value]
        if not ASIDE_WORDS.isdisjoint(words):
            return True
    return False


class Element:
    __slots__ = ("tag", "path", "aside", "skipped", "inline")

    def __init__(self, tag: str, path: str, aside: bool, skipped: bool, inline: bool = False) -> None:
        self.tag, self.path, self.aside, self.skipped, self.inline = tag, path, aside, skipped, inline


_labels: dict[tuple[str, str], tuple[str, bool]] = {}


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """Name of an element in a wrapper, and whether it is aside of the article."""
    found = _labels.get((tag, attributes)) if attributes else None
    if found:
        return found
    names, hidden = [], False
    for key, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        key = key.lower()
        if key in ("class", "id", "role", "itemprop"):
            names += [f"{key[0]}:{re.sub(r'[^a-z_-]+', '#', v)}" for v in value.split()]
        else:
            hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    others = tag in WHOLE and any(not OTHERS_WORDS.isdisjoint(_NAME.findall(n[2:])) for n in names if n[0] != "i")
    aside = tag in ASIDE or hidden or others or (tag not in WHOLE and aside_by_name(tag, names))
    found = ".".join([tag, *sorted(set(names))]).replace("/", "#"), aside
    if attributes and len(attributes) < 200:
        if len(_labels) > 20_000:
            _labels.clear()
        _labels[tag, attributes] = found
    return found


def walk(page: str) -> Iterator[tuple[str, Element | str]]:
    """Events ``open``, ``close`` (an element) and ``text`` (its characters, references decoded).

    Lenient as browsers are: missing end tags are supplied, stray ones ignored, an
    unfinished tag or comment runs to the end.
    """
    stack: list[Element] = []
    top = Element("", "", False, False)
    at, end = 0, len(page)

    def close(down_to: int) -> Iterator[tuple[str, Element]]:
        while len(stack) > down_to:
            yield "close", stack.pop()

    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        token = m.group()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            if token[0] != "<" or token == "<":
                yield "text", html.unescape(token) if "&" in token else token
            continue
        if m.group(1) or m.group(4):  # an end tag
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    yield from close(i)
                    break
            if tag == "br":
                yield "text", " "
            continue
        if tag in CLOSES_P:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag not in INLINE), -1)
            if i >= 0 and stack[i].tag == "p":
                yield from close(i)
        elif tag in ENDS:
            ended, limit = ENDS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in ended.split():
                    yield from close(i)
                    break
                if stack[i].tag in limit:
                    break
        if tag == "br":
            yield "text", " "
            continue
        above = stack[-1] if stack else top
        label, aside = _label(tag, m.group(3) or "")
        inline = tag in INLINE or len(stack) >= DEEPEST
        path = above.path if inline else f"{above.path}/{label}"
        element = Element(tag, path, aside, above.skipped or aside, inline)
        yield "open", element
        if tag in VOID or token.endswith("/>") and tag not in INLINE and tag not in CLOSES_P and tag not in ENDS and tag not in RAW:
            yield "close", element
            continue
        if tag in RAW:
            m = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            yield "close", element
            at = m.end() if m else end
            continue
        stack.append(element)
    yield from close(0)


# An expression: [label, optional, repeated, slot, children, groups]; a group is a
# pair of children's labels between which the children repeat.  Siblings of one
# label share an expression.
LABEL, OPTIONAL, REPEATED, SLOT, CHILDREN, GROUPS = range(6)


def _children(node: list) -> dict[str, int]:
    return {c[LABEL]: i for i, c in enumerate(node[CHILDREN])}


def _grouped(groups: list, order: dict[str, int], first: str, last: str) -> list:
    """The groups and one more, overlapping ones joined, in order of place."""
    spans, out = sorted([*([order[a], order[b]] for a, b in groups), [order[first], order[last]]]), []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    names = list(order)
    return [[names[a], names[b]] for a, b in out]


def fold(page: str) -> tuple[list, dict[str, list]]:
    """A page's expression, and by element path: characters, those in links, crc32 of the text."""
    root = ["", False, False, False, [], []]
    stack: list[tuple[list, dict[str, int], int]] = [(root, {}, -1)]  # node, child places, place of the last child
    texts: dict[str, list] = {}
    linked, elements = 0, []
    seen: dict[int, list[set]] = {}
    for kind, x in walk(page):
        if kind == "text":
            if elements and x.strip():
                path = elements[-1].path
                stack[-1][0][SLOT] = True
                if not elements[-1].skipped:
                    entry = texts.setdefault(path, [0, 0, 0])
                    n = len(" ".join(x.split()))
                    entry[0] += n
                    entry[1] += n if linked else 0
                    entry[2] = zlib.crc32(x.encode("utf-8", "replace"), entry[2])
            continue
        if kind == "open":
            elements.append(x)
            linked += x.tag == "a"
            if x.inline:
                continue
            node, order, last = stack[-1]
            label = x.path.rpartition("/")[2]
            if label in order:
                child = node[CHILDREN][order[label]]
                if order[label] == last:
                    child[REPEATED] = True
                elif order[label] < last:
                    node[GROUPS] = _grouped(node[GROUPS], order, label, node[CHILDREN][last][LABEL])
            else:
                child = [label, False, False, False, [], []]
                order[label] = len(node[CHILDREN])
                node[CHILDREN].append(child)
            stack[-1] = (node, order, order[label])
            stack.append((child, _children(child), -1))
            seen.setdefault(id(child), []).append(set())
            if id(node) in seen:
                seen[id(node)][-1].add(label)
        else:
            elements.pop()
            linked -= x.tag == "a"
            if not x.inline:
                stack.pop()

    def mark(node: list) -> None:  # children that some instance of their parent lacks
        for child in node[CHILDREN]:
            times = seen.get(id(node))
            if times and any(child[LABEL] not in s for s in times):
                child[OPTIONAL] = True

    todo = [root]
    while todo:
        node = todo.pop()
        mark(node)
        todo += node[CHILDREN]
    return root, texts


def align(a: list, b: list) -> list:
    """The least expression of this kind that generalises both (same label)."""
    out = [a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[SLOT] or b[SLOT], [], []]
    in_a, in_b = _children(a), _children(b)
    names: list[str] = list(in_a)
    for i, child in enumerate(b[CHILDREN]):
        if child[LABEL] not in in_a:  # after its predecessor in b
            before = b[CHILDREN][i - 1][LABEL] if i else None
            names.insert(names.index(before) + 1 if before else 0, child[LABEL])
    order = {n: i for i, n in enumerate(names)}
    for name in names:
        x = a[CHILDREN][in_a[name]] if name in in_a else None
        y = b[CHILDREN][in_b[name]] if name in in_b else None
        if x and y:
            out[CHILDREN].append(align(x, y))
        else:
            out[CHILDREN].append([name, True, *(x or y)[REPEATED:]])
    for first, last in [*a[GROUPS], *b[GROUPS]]:
        lo, hi = sorted((first, last), key=order.__getitem__)
        out[GROUPS] = _grouped(out[GROUPS], order, lo, hi)
    common = [c[LABEL] for c in b[CHILDREN] if c[LABEL] in in_a]
    for x, y in zip(common, common[1:], strict=False):
        if order[x] > order[y]:  # met in the other order: the run between repeats
            out[GROUPS] = _grouped(out[GROUPS], order, y, x)
    return out


def expression(node: list) -> str:
    """The expression as text, for people: ``ul(li(#)+)?`` and so on."""
    parts = ["#"] if node[SLOT] else []
    order = _children(node)
    opens = {order[a] for a, _ in node[GROUPS]}
    shuts = {order[b] for _, b in node[GROUPS]}
    for i, child in enumerate(node[CHILDREN]):
        parts.append("(" * (i in opens) + expression(child) + ")+" * (i in shuts))
    inner = f"({' '.join(parts)})" if parts else ""
    return f"{node[LABEL]}{inner}{'+' * node[REPEATED]}{'?' * node[OPTIONAL]}"


def _tag(label: str) -> str:
    return label.partition(".")[0]


def _names(label: str) -> set[str]:
    return {w for part in label.split(".")[1:] for w in [re.sub(r"[^a-z]", "", part[2:])]}


def _is_aside(label: str, lenient: bool = False) -> bool:
    """Whether a wrapper's element is aside; if ``lenient``, only if it surely is."""
    tag, names = _tag(label), label.split(".")[1:]
    words = {w for part in names if part[0] != "i" or tag in NAMED_BY_ID for w in _NAME.findall(part[2:])}
    return tag in ASIDE or bool(words & OTHERS_WORDS) or (not lenient and tag not in WHOLE and aside_by_name(tag, names))


def article_paths(wrapper: list, texts: dict[str, list]) -> list[str]:
    """Paths of the elements that hold the article.

    The outermost ``article`` elements (or those so named), else ``main``, else the
    deepest element that has most of the body's text outside links.  Text that is
    the same on every page of the host (three or more) is the template's, not the
    article's, in that last case.  ``texts``: characters, those in links, whether
    constant, by path.
    """
    for lenient in (False, True):  # a layout's names (``with-sidebar``) do not hide the article in it
        found: dict[int, list[str]] = {0: [], 1: []}
        todo = [("", wrapper)]
        while todo:
            above, node = todo.pop()
            for child in node[CHILDREN]:
                path, label = f"{above}/{child[LABEL]}", child[LABEL]
                if _is_aside(label, lenient):
                    continue
                names = _names(label)
                if _tag(label) == "article" or names & ARTICLE_WORDS:
                    found[0].append(path)
                    continue
                if _tag(label) == "main" or names & MAIN_WORDS:
                    found[1].append(path)
                todo.append((path, child))
        if found[0] or found[1]:
            return sorted(found[0]) or sorted(p for p in found[1] if not any(p.startswith(f"{q}/") for q in found[1]))
    weight: dict[str, int] = {}
    for path, (n, linked, constant) in texts.items():
        steps = path.split("/")
        if constant or any(_tag(s) in OUTSIDE for s in steps):
            continue
        for i in range(2, len(steps) + 1):
            part = "/".join(steps[:i])
            weight[part] = weight.get(part, 0) + n - linked
    best = max((p for p in weight if p.count("/") == 1), key=lambda p: (weight[p], p), default="")
    while best:
        inner = [p for p in weight if p.rpartition("/")[0] == best and _tag(p.rpartition("/")[2]) in HOLDERS]
        deeper = max(inner, key=lambda p: (weight[p], p), default="")
        if not deeper or 5 * weight[deeper] < 4 * weight[best]:
            return [best] if best.count("/") > 2 else []  # all of the body is no wrapper's choice
        best = deeper
    return []


def read(page: str, paths: frozenset[str]) -> str:
    """The page's text in ``paths``; if it has none of them, in all of it but what is aside."""

    def blocks(within: bool) -> list[str]:
        out, held, inside, aside, elements = [], [], 0, 0, []
        for kind, x in walk(page):
            if kind == "text":
                if within:
                    keep = inside and not aside  # aside of the article, not above it
                else:
                    keep = elements and not elements[-1].skipped and not any(e.tag in OUTSIDE for e in elements)
                if keep:
                    held.append(x)
                continue
            root = not x.inline and x.path in paths
            if x.tag not in INLINE and held:
                out.append(" ".join("".join(held).split()))
                held = []
            step = 1 if kind == "open" else -1
            if kind == "open":
                elements.append(x)
            else:
                elements.pop()
            if inside - (step < 0 and root) and x.aside:
                aside += step
            if root:
                inside += step
        if held:
            out.append(" ".join("".join(held).split()))
        return [b for b in out if b]

    found = blocks(True) if paths else []
    return " ".join(found or blocks(False))


def host_of(url: str):
    """The host in an address column, lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _fold_sorted(column: str):
    """Aligns the expressions of each run of equal hosts, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(held)])], ["host", column])

        for batch in batches:
            salts = batch.column("salt").to_pylist() if "salt" in batch.schema.names else [0] * batch.num_rows
            for h, salt, x in zip(batch.column("host").to_pylist(), salts, batch.column(column).to_pylist(), strict=True):
                if held is not None and (h, salt) != key:
                    yield out()
                    held = None
                host, key, node = h, (h, salt), json.loads(x)
                held = node if held is None else align(held, node)
        if held is not None:
            yield out()

    return run


SALTS = 16


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper, paths)`` of every host in ``pages(host, html)``.

    Each page is folded where it is read; equal expressions of a host count once,
    the others are aligned in 16 shares of a host and these with one another, one
    expression at a time in order of its text: no task holds a host's pages.
    """

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, stats = set(), {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if not page:
                    continue
                node, texts = fold(page)
                seen.add((host, json.dumps(node)))
                for path, (n, linked, crc) in texts.items():
                    s = stats.setdefault((host, path), [0, 0, 0, crc, crc])
                    s[:] = [s[0] + n, s[1] + linked, s[2] + 1, min(s[3], crc), max(s[4], crc)]
            rows = [(h, e, None, 0, 0, 0, 0, 0) for h, e in sorted(seen)] + [(h, None, p, *s) for (h, p), s in sorted(stats.items())]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), *[pa.int64()] * 5), strict=True)],
                    ["host", "expression", "path", "chars", "linked", "pages", "lo", "hi"],
                )

    parts = pages.select("host", "html").mapInArrow(
        folded, "host string, expression string, path string, chars long, linked long, pages long, lo long, hi long"
    )
    parts = saved(parts, "folded")
    different = parts.where("expression is not null").select("host", F.col("expression").alias("wrapper")).distinct()
    shares = different.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int")).repartition("host", "salt")
    partial = shares.sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_fold_sorted("wrapper"), "host string, wrapper string")
    whole = partial.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_fold_sorted("wrapper"), "host string, wrapper string")
    slots = parts.where("path is not null").groupBy("host", "path").agg(
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("pages").alias("pages"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    constant = (F.col("lo") == F.col("hi")) & (F.col("pages") >= 3)
    by_host = slots.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "chars", "linked", constant.alias("constant")))).alias("slots"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wrapper, slots in zip(batch.column("wrapper").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                node = json.loads(wrapper)
                texts = {s["path"]: (s["chars"], s["linked"], s["constant"]) for s in slots or []}
                out.append((expression(node), article_paths(node, texts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([e for e, _ in out], pa.string()), pa.array([p for _, p in out], pa.list_(pa.string()))], ["host", "wrapper", "paths"]
            )

    return whole.join(by_host, "host", "left").mapInArrow(decide, "host string, wrapper string, paths array<string>")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, wrapper)`` of every row of ``pages(page_id, url, html)``.

    ``text``: the article's blocks, white space turned into single spaces, joined by
    one space; ``wrapper``: its host's expression.  A page without the host's
    article elements gives all its text but menus, forms and the like.  Of elements
    nested more than ``DEEPEST`` deep the text counts as that of the one at that depth.

    Null or empty html gives an empty text.  Pages whose address names no host form
    a host of their own.  Repeated rows are read alike.  Other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of("url"))
    known = saved(wrappers(pages), "wrappers")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                read(page, frozenset(paths or ())) if page else ""
                for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()), batch.column("wrapper")],
                ["page_id", "url", "text", "n_chars", "wrapper"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.join(known, "host", "left").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long, wrapper string")
