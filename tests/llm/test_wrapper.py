import random

from shelfline.llm import wrapper as w


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>if (a<b) '</p>';</script><style>p{{}}</style></head><body>{body}</body></html>"


def test_folding_finds_repeats_options_and_slots():
    node, texts = w.fold(page("<ul><li>a<li><b>x</b>b</ul><div class='post-12 big'><h2>1</h2><p>a<p>b<h2>2</h2></div>"))
    assert w.expression(node) == "(html(head(title script style) body(ul(li(#)+) div.c:big.c:post-#((h2(#) p(#)+)+))))"
    assert texts["/html/body/ul/li"][:2] == [3, 0]


def test_alignment_generalises_and_does_not_depend_on_order():
    bodies = ["<nav>n</nav><p>a</p><p>b</p>", "<p>c</p><div class=ad>x</div>", "<nav>n</nav><h1>t</h1><p>a</p>"]
    nodes = [w.fold(page(b))[0] for b in bodies]
    whole = w.align(w.align(nodes[0], nodes[1]), nodes[2])
    assert w.expression(whole).endswith("body(nav(#)? h1(#)? p(#)+ div.c:ad(#)?)))")
    for n in nodes:  # the wrapper covers what it was made of
        assert w.align(whole, n) == whole


def test_article_of_a_marked_page():
    body = (
        "<header>Site</header><nav><a href=/>menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Ti&eacute;tle &amp; more</h1>"
        "<p>One <i>two</i>three\n  four<p>five&nbsp;six<br>seven<!-- c --><aside>side</aside><form><input>q</form><ul><li>x<li>y</ul>"
        "<section id=comments><p>a reader</p></section></article><div class=sidebar>s</div><footer>f</footer>"
    )
    node, texts = w.fold(page(body))
    paths = w.article_paths(node, {p: (n, k, False) for p, (n, k, _) in texts.items()})
    assert paths == ["/html/body/article"]
    assert w.read(page(body), frozenset(paths)) == "Tiétle & more One twothree four five six seven x y"


def test_layout_names_do_not_hide_the_article():
    body = (
        "<div class='layout with-sidebar'><div class=sidebar>s</div><article class='post widget'><h1>T</h1><p>a</p><div class=ad>x</div>"
        "<p class=intro>b</p></article></div><section class=comments><article class=comment>c</article></section>"
    )
    html = page(body).replace("<body>", "<body class='has-sidebar cookie'>")
    node, texts = w.fold(html)
    paths = w.article_paths(node, {})
    assert len(paths) == 1 and paths[0].endswith("/article.c:post.c:widget")
    assert w.read(html, frozenset(paths)) == "T a b"


def test_unclosed_and_broken_markup():
    assert w.read("<p>a<p>b<b>c<p>d", frozenset()) == "a bc d"
    assert w.read("x < y & z &lt; <", frozenset()) == ""  # text outside any element is no block of a page
    assert w.read("<div>x < y & z &lt;<", frozenset()) == "x < y & z <<"
    assert w.read("<div><!-- never closed <p>x", frozenset()) == ""
    assert w.read("<div><script>var a = '<p>';", frozenset()) == ""
    assert w.read("<div title='a>b'>c</div></div></p>", frozenset()) == "c"
    deep = "<div>" * 3000 + "x"
    assert w.read(deep, frozenset()) == "x"


def unmarked(rng, i):
    words = lambda k: " ".join(rng.choices("lorem ipsum dolor sit amet elit sed".split(), k=k))
    text = [words(40) for _ in range(rng.randint(1, 4))]
    optional = "<div class='promo'>buy</div>" if i % 2 else ""
    html = page(
        f"<div id=top><a href=/>Home</a> <a href=/x>News</a></div><div><div class=x>Everywhere the same words here</div>{optional}"
        f"<div class=content>{''.join(f'<p>{t}</p>' for t in text)}</div></div><div class=footer>(c) {i}</div>"
    )
    return html, " ".join(text)


def test_wrapper_of_hosts_without_article_elements(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        html, text = unmarked(rng, i)
        rows.append((i, f"https://user@h{i % 3}.Example.org:80/p/{i}", html))
        want[i] = text
    got = w.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) and "div.c:promo(#)?" in r["wrapper"] for r in got)


def test_odd_and_empty_tables(spark):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, "http://a.b/", "<p>x"), (3, "nonsense", "no markup at all"), (4, "http://a.b/", " "), (5, "http://a.b", "<p>y" + " z" * 200_000)]
    schema = "page_id long, url string, html string, host string, text string, paths int, wrapper int"
    pages = spark.createDataFrame([(*r, "clash", "clash", 1, 1) for r in rows], schema)
    got = w.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert texts[1, None] == texts[2, ""] == texts[4, "http://a.b/"] == "" and texts[None, "http://a.b/"] == "x"
    assert len(texts[5, "http://a.b"]) == 400_001
    assert w.extract(pages.limit(0)).collect() == []


def test_slugs_and_compound_names_within_an_article_are_text():
    body = (
        "<article><h2 id=related-work>Related</h2><section id=search-algorithms><p>a</p></section><p class=social-history>b</p>"
        "<p id=notice-2>c <span class=ad-hoc>d</span></p><h3 id=copyright>e</h3><section class='ad-free'>f</section>"
        "<p class=advert>buy</p><span class=ad>now</span><div class='post-share'>s</div><section id=comments>r</section>"
        "<div id=related-posts>x</div><section class=newsletter>y</section></article>"
    )
    node, _ = w.fold(page(body))
    assert w.read(page(body), frozenset(w.article_paths(node, {}))) == "Related a b c d e f"


def test_deep_pages_are_read(spark):
    """Ten thousand nested elements, closed and not, on hosts with other pages."""
    deep = "<div>" * 10_000 + "deep <p>text" + "</div>" * 5_000 + "tail"
    rows = [(1, "http://a.b/1", page(deep)), (2, "http://a.b/2", page("<div><p>flat text</p></div>")), (3, "http://c.d/", page(f"<article>{deep}</article>"))]
    rows += [(4, "http://e.f/", page("<article>" + "<section><p>x</p>" * 3_000 + "</article>"))]
    got = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[3] == "deep text tail"
    assert got[2] == "flat text" and got[4] == " ".join(["x"] * 3_000)
