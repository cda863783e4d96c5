import random

import duckdb
import pytest

from shelfline.llm import language, licence


def scanned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, licence string")
    return {r["doc_id"]: r["licence"] for r in licence.scan(docs, licence.known_licences(spark)).collect()}


def test_variants_of_a_licence_are_found_and_other_texts_are_not(spark):
    mit = licence.KNOWN["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + mit.upper()),
        (2, mit.replace("sublicense", "sublicence").replace('"', "''").replace("\n", "  \r\n ")),
        (3, mit + "\nOne more sentence."),
        (4, "* " + mit.replace(". ", " ; ") + "\n© Someone"),
        (5, "licensed under the apache licence version 2 0"),
        (6, None), (7, ""), (8, "\n\t. "), (8, "\n\t. "), (9, "x " * 100_000),
        (10, "Copyright 1999 by A. Author\n" + licence.KNOWN["Zlib"]),
    ]
    found = scanned(spark, [(*r, "clash", "clash") for r in rows])
    assert found == {1: "MIT", 2: "MIT", 3: None, 4: "MIT", 5: "Apache-2.0-line", 6: None, 7: None, 8: None, 9: None, 10: "Zlib"}


MIT_FILE = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_files_as_they_are_found(spark):
    """With a heading, flattened to a line, with several holders, in comment marks; near misses are none."""
    flat = " ".join(MIT_FILE.split())
    two = MIT_FILE.replace("Copyright (c) 2020 Jane Doe", "Copyright (c) 1999-2020 Jane Doe <jane@a.b>\nCopyright © 2021, Doe Inc.\nAll rights reserved.")
    commented = "/*\n" + "".join(f" * {line}\n" for line in MIT_FILE.splitlines()) + " */"
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2017, A\nAll rights reserved.\n\n" + licence.KNOWN["BSD-3-Clause"]
    rows = [
        (1, MIT_FILE), (2, flat), (3, two), (4, commented), (5, "The MIT License (MIT)" + MIT_FILE.removeprefix("MIT License")),
        (6, bsd), (7, "The Unlicense\n" + licence.KNOWN["Unlicense"]), (8, "My " + MIT_FILE), (9, "ISC License\n" + licence.KNOWN["MIT"]),
        (10, flat.replace("free of charge", "for a fee")), (11, "Copyright (c) 2020 Jane Doe"), (12, "MIT License"),
        (13, "Copyright 2020 X. Permission is hereby granted"),
    ]
    found = scanned(spark, [(*r, None, None) for r in rows])
    want = {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: "MIT", 6: "BSD-3-Clause", 7: "Unlicense"}
    assert found == {i: want.get(i) for i, _ in rows}


def test_every_known_licence_finds_itself(spark):
    names = sorted(licence.KNOWN)
    found = scanned(spark, [(i, licence.KNOWN[n], None, None) for i, n in enumerate(names)])
    assert [found[i] for i in range(len(names))] == names


def test_against_sql(spark, sample_dir, odd_docs):
    rng = random.Random(1)
    parts = ["Copyright (c) 1 z ", "Permission is hereby granted", "copyright 7 redistribution and use", "Licence", "CENTRE centre", "é", " copyright 2001 x", "\ncopyright (c) y", "\r\nAll Rights Reserved.", "©", "İΣ", " -- ", "\n", "https"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice([" ", ""]) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(300, None)]
    rows += [(400 + i, t) for i, t in enumerate(licence.KNOWN.values())]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(licence.scan_sql()).fetchall(), key=lambda r: r[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in licence.scan(docs, licence.known_licences(spark)).collect()), key=lambda r: r[0])
    assert got == want
    assert licence.scan(odd_docs.limit(0), licence.known_licences(spark)).collect() == []


WORDS = {"en": "the and of with house that".split(), "de": "der und nicht für straße ein".split(), "fr": "le et être école dans une".split()}


def prose(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def site(rng, i, lang, n, declared):
    mark = f' lang="{declared}"' if declared else ""
    return f"<html{mark}><body><nav>{prose(rng, 'fr', 30)}</nav><p>{prose(rng, lang, n)}</p></body></html>"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(0)
    rows = [(prose(rng, lang, 200), lang) for lang in WORDS for _ in range(10)]
    return spark.createDataFrame(rows, "text string, lang string")


def test_evidence_is_fused(spark, labelled):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        host = f"{lang}{i % 4}.example.{'de' if lang == 'de' else 'org'}"
        text = 0 if i % 7 == 0 else 40  # without text: markup, then host
        declared = None if i % 2 else ("en" if i % 10 == 0 else lang)  # sometimes wrong
        rows.append((i, f"http://{host}/x", site(rng, i, lang, text, declared)))
        want[i] = (lang, text, declared)
    got = language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), labelled).collect()
    assert len(got) == 300
    for r in got:
        lang, text, declared = want[r["page_id"]]
        assert r["declared"] == declared and (r["text_lang"] == lang if text else r["text_lang"] is None)
        if text or declared != "en":
            assert r["lang"] == lang, r


def test_a_prior_is_smoothed_from_host_to_suffix_to_all(spark, labelled):
    rng = random.Random(3)
    rows = [(i, f"http://h{i}.example.de/", site(rng, i, "de", 40, None)) for i in range(40)]
    rows += [(100 + i, f"http://h{i}.example.org/", site(rng, i, "en", 40, None)) for i in range(60)]
    rows += [(200, "http://new.example.de/", "<p></p>"), (201, "http://new.example.org/", ""), (202, "http://other.xyz/", None)]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), labelled).collect()}
    assert [got[k]["lang"] for k in (200, 201, 202)] == ["de", "en", "en"]
    assert got[200]["p"] > got[202]["p"] > 1 / 3


def test_odd_and_empty_tables(spark, labelled):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, "x", "<p>the and of</p>"), (3, "http://a.b.c/", "<html lang=xx>" + "<p>der und" * 50_000)]
    pages = spark.createDataFrame([(*r, "x", "x", 1, 1) for r in rows], "page_id long, url string, html string, host string, lang string, k int, p int")
    got = language.identify(pages, labelled).collect()
    assert len(got) == 5 and all(r["lang"] in WORDS and 0 < r["p"] <= 1 for r in got)
    assert language.identify(pages.limit(0), labelled).collect() == []
    assert {r["lang"] for r in language.identify(pages, labelled.limit(0)).collect()} == {None}


def test_visible_text_is_as_by_definition_and_linear():
    import re
    import time

    by_regex = re.compile(r"<!--.*?-->|<(script|style|nav|footer|aside|head|form|template|svg)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    rng = random.Random(2)
    pieces = ["<p>", "</p>", "<!--", "-->", "<script>", "</SCRIPT >", "<nav class=x>", "</nav>", "<navy>", "a", " b ", "<", ">", "<form", "</form>", "&amp;", "<svg/>", "<head>"]
    for _ in range(3000):
        page = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert language.visible(page) == language._ENTITY.sub(" ", by_regex.sub(" ", page)), page
    for piece in ("<form>", "<!-- ", "<", "<script ", "<html ", "<meta property=og:locale "):
        began = time.perf_counter()
        page = piece * (10_000_000 // len(piece))
        language.visible(page)
        language.declared(page)
        assert time.perf_counter() - began < 20


def test_declared_languages():
    assert language.declared('<html class="a" lang="de-AT">') == "de"
    assert language.declared("<meta name=x content=y><meta http-equiv='Content-Language' content='FR'>") == "fr"
    assert language.declared("<meta property=og:locale content=en_US><HTML LANG=es>") == "es"
    assert language.declared("<html data-lang=x><p lang=de>") is None
    assert language.declared("") is None
