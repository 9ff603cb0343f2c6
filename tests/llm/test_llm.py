"""Each operator against a plain version on small tables with nulls, empties, ties, repeated rows and clashing names."""

import collections
import html as entities
import itertools
import math
import random
import re
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import best_fit, context_mixing, exact_topk, html_text, jaccard_join, license_scan, quality_rules, queries, source_mix, token_counts, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "x", "a b c", "ÀB\u00a0c d\u2003e", "w " * 4000, "same line\nsame line\nother", "z" * 30000, "a\x1cb\x85c MIT License, mit-license! mit"]


def texts(spark, more=()):
    """Odd texts twice, with an extra column of a clashing name."""
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, 7) for i, t in enumerate([*ODD, *more])]
    return spark.createDataFrame(rows + rows[:3] + [(None, "no id", None, None)], "doc_id long, text string, source string, n_words long")


def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def sample(spark, data):
    real = [r["text"] for r in documents(spark, data).select("text").collect()]
    return texts(spark, real)


# 5

def plain_quality(text):
    words = WORD.findall(text or "")
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    inside = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_rules(spark, data):
    out = quality_rules.quality_rules(sample(spark, data)).collect()
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(r["text"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(sample(spark, data).limit(0)).count() == 0


def test_bands():
    rng = random.Random(0)
    p, pack = quality_rules.Bands(), __import__("zstandard").ZstdCompressor(level=3)
    noise = rng.randbytes(20000)
    prose = " ".join(rng.choice(["of", "the", "river", "stone", "walked", "under", "green", str(rng.random())[2:6]]) for _ in range(3000)).encode()
    assert quality_rules.bands_fail(noise, p, pack)[2] and quality_rules.bands_fail(b"spam spam " * 3000, p, pack)[2]
    assert not quality_rules.bands_fail(prose, p, pack)[2] and not quality_rules.bands_fail(b"", p, pack)[2]


def test_kept_is_what_the_bands_say(spark, data):
    p, pack = quality_rules.Bands(), __import__("zstandard").ZstdCompressor(level=3)
    rng = random.Random(12)
    prose = " ".join(rng.choice(["of", "the", "river", "stone", "walked", "green"]) + str(rng.randrange(50)) for _ in range(1500))
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(900))
    more = [prose[:4000] + "ab " * 1400, prose, noise, prose + " " + noise, "spam eggs " * 2000, prose[:4095], prose[:4097]]
    ratio = lambda b: len(b) / len(pack.compress(b))
    for r in quality_rules.quality_rules(texts(spark, more)).collect():
        raw = (r["text"] or "").encode()
        low, high = [(lo, hi) for size, lo, hi in p.bands if len(raw) >= size][-1]
        parts = [raw[i : i + 4096] for i in range(0, len(raw) // 4096 * 4096, 4096)] + ([raw[-4096:]] if len(raw) > 4096 and len(raw) % 4096 else [])
        bad = sum(not p.chunk_low <= ratio(c) <= p.chunk_high for c in parts)
        fails = bool(raw) and (not low <= ratio(raw) <= high or bool(parts) and bad / len(parts) > p.chunk_share)
        assert r["kept"] == (not plain_quality(r["text"])[5] and not fails)


# 4

def test_token_counts_are_the_library_s(spark, data):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(1)
    letters = "aàbéИΣσς'’ß İı\u1100\u1161 \x00\t\n<|startoftext|><|endoftext|>12½٣ﬁ漢字'S'RE aaaa!!!==_-Å"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["<|endoftext|>a<|endoftext|> b<|start", "ab" * 2000, "!" * 999]
    for r in token_counts.token_counts(texts(spark, odd), path, limit=3).collect():
        s = r["text"] or ""
        n = len(t.encode(s, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(s.encode()), n, n > 3)


def test_token_counts_of_an_empty_table_and_clashing_columns(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "two words", "x"), (1, "two words", "x"), (None, None, None)], "doc_id long, text string, n_tokens string")
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, path).collect()), key=repr) == [(1, 9, 2), (1, 9, 2), (None, 0, 0)]
    assert token_counts.token_counts(df.limit(0), path).count() == 0


# 8

def test_license_words(spark, data):
    more = [" .,\x00a" + "-" * 5 + "b" + " " * 90 + "c\x7f\u00a0 d\u2003é9", "!" * 50, "MIT License mit license, the Apache-License! General public LICENSE", "SPDX-License-Identifier: MIT\nlicensed under the terms of the GNU General Public License version 3", "Licensed under the BSD 3-Clause License."]
    out = license_scan.license_scan(texts(spark, more)).collect()
    assert len(out) == len(ODD) + len(more) + 4
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in out:
        w = word.findall((r["text"] or "").translate(LOWER))
        hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = sorted({label for _, label in hits})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(hits), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    said = {r["text"]: r["labels"].split(",") for r in out}
    assert "gpl-3.0" in said[more[3]] and "mit" in said[more[3]]
    assert said[more[4]] == ["bsd-3-clause"]  # the plain BSD rule is inside and suppressed
    assert len(license_scan.rules()) > 200
    for rule in license_scan.rules():
        re.compile(rule.pattern)


def test_license_gate_and_gaps(spark):
    cases = {
        "Released under Apache 2.0.": "apache-2.0", "Distributed under the BSD terms": "bsd", "published under CC BY-SA 4.0": "cc-by-sa", "see https://www.mozilla.org/MPL/2.0/": "mpl-2.0",
        "http://www.eclipse.org/legal/epl-v10.html": "epl-1.0", "at unlicense.org": "unlicense", "openfontlicense.org": "ofl-1.1", "licensed under the GNU General\nPublic License v3": "gpl,gpl-3.0", "GNU  Lesser\tGeneral\u00a0Public License": "lgpl",
        "/*\n * covered by the Mozilla    *\n *\n * Public License, version  2.0 */": "mpl-2.0", "# released into the\r\n# public domain": "public-domain", "https://creativecommons.org/licenses/by/\nx": "cc-by",
        "open\n// database  license": "odbl-1.0", "published by the press": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r["text"]: r["labels"] for r in license_scan.license_scan(df).collect()} == cases
    grants = [(k, f"covered by {w}") for k, (_, w) in enumerate((f[0], x) for f in license_scan.FAMILIES for x in f[4].split("|"))]
    urls = [(k, f"x {h} y") for k, h in enumerate(h for f in license_scan.FAMILIES if f[3] for h in license_scan.hosts(f[3]))]
    low = spark.createDataFrame(grants + urls, "k long, text string")
    can = {r["text"]: r["can"] for r in low.select("text", (license_scan._can_match(F.col("text")) & license_scan._may_match(F.col("text"))).alias("can")).collect()}
    for _, text in grants + urls:  # no text that a rule matches is turned away
        assert can[text] or not any(re.search(r.pattern, text) for r in license_scan.rules())
    for rule in license_scan.rules():  # and each rule runs on what it matches
        for _, text in grants + urls:
            assert not re.search(rule.pattern, text) or any(w in text for w in rule.keyword.split("|"))


def test_license_names_in_lists_tags_and_short_forms(spark):
    """Labels written by hand, by no rule."""
    cases = {
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2.0,mit", "SPDX-License-Identifier: GPL-2.0-only WITH x": "gpl-2.0", "// SPDX-License-Identifier: MIT AND (ISC OR Zlib)": "isc,mit,zlib",
        "Dual licensed under MIT or Apache-2.0": "apache-2.0,mit", "It is licensed under the MIT, BSD-3-Clause and Apache 2.0 licenses.": "apache-2.0,bsd-3-clause,mit", 'license = "MIT"': "mit", "license: 'ISC'": "isc", "Lizenz: MIT": "mit",
        "GNU GPL v2 or later": "gpl-2.0", "GPLv3+": "gpl-3.0", "AGPLv3 only": "agpl-3.0", "BSD-3-Clause": "bsd-3-clause", "(c) me, BSD-2-Clause.": "bsd-2-clause", "CC BY-NC-SA 4.0": "cc-by-nc-sa", "Creative Commons Attribution 4.0 International": "cc-by",
        "Creative Commons\nAttribution-ShareAlike 3.0": "cc-by-sa", "See the LICENSE-MIT file": "mit", "LICENSE-APACHE": "apache", "Apache-2.0": "apache-2.0",
        "We met with Apache tribes or later": "", "mit dem Hund und der Katze": "", "cc by mail": "", "ruby or python, and mit": "", "x-gpl-3.0x or a bsd-3-clausette": "", "the creative commons": "",
    }
    out = license_scan.license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {r["text"]: r["labels"] for r in out} == cases


def plain_license(flat):
    """(labels, highest confidence) by all rules on a lower-cased text of single spaces."""
    found = []
    for k, r in enumerate(license_scan.rules()):
        if r.also in flat and any(w in flat for w in r.keyword.split("|")):
            before = 0
            for m in re.finditer(r.pattern, flat):
                said_no = re.search(license_scan.NEGATION, flat[max(before, m.start() - 96) : m.start()])
                found.append((m.start(), -m.end(), -r.priority, k, r.label, bool(said_no)))
                before = m.end()
    found.sort()
    live = [x for i, x in enumerate(found) if not x[5] and not any(not y[5] and y[1] <= x[1] and y[2] <= x[2] for y in found[:i])]
    return {x[4] for x in live}, max((license_scan.CONFIDENCE[-x[2]] for x in live), default=0.0)


def test_license_rules_against_a_plain_detector(spark):
    rng = random.Random(9)
    said = [
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "redistribution and use in source and binary forms, with or without modification, are permitted", "this is not under the mit license.",
        "it isn't licensed under the gnu general public license, version 2", "not only the mit license", "spdx-license-identifier: mit or apache-2.0", "licensed under the apache license, version 2.0", "instead of the bsd license we took mit no attribution license",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published, either version 3 of the license", "https://opensource.org/licenses/mit", "all rights reserved", "no part of this book may be reproduced",
        "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", "license: isc", "the mozilla public license 2.0", "released into the public domain", "mit mit license mit license", "words of prose about a permit",
    ]
    rows = [(i, t) for i, t in enumerate(said)] + [(100 + i, " ".join(rng.choices(said, k=rng.randint(2, 6)))) for i in range(60)] + [(200, "mit license " * 700)]
    out = {r["text"]: (set(filter(None, r["labels"].split(","))), r["score"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases={}).collect()}
    for _, t in rows:
        assert out[t] == plain_license(t), t
    assert out[said[0]] == ({"mit"}, 0.95) and out[said[1]] == ({"bsd"}, 0.95) and out[said[2]] == (set(), 0.0) and out[said[4]][0] == {"mit"}
    base = {r["text"]: (r["base_labels"], r["score"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert base[said[2]] == ("mit", 0.3) and base[said[16]] == ("mit", 0.9)
    spans = license_scan.license_spans(spark.createDataFrame([(1, "x MIT  license y", "clash")], "doc_id long, text string, label string")).collect()
    assert [(r["label"], r["start"], r["end"]) for r in spans if r["priority"] == 2] == [("mit", 2, 13)]
    assert license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([([],), ([5],), ([i % 7 for i in range(128)],), ([i % 11 for i in range(1000)],)], "a array<bigint>")
    for r in df.select("a", license_scan._running(F.col("a")).alias("s")).collect():
        assert r["s"] == list(itertools.accumulate(r["a"]))


# 9

def test_url_filter_sql(spark, data, same_rows):
    same_rows(queries.op9_url_filter(spark, data), queries.ORACLES["op9_url_filter"])


def test_url_filter_odd(spark):
    rows = [(1, "http://A.Example.com/en/7?x"), (2, "https://com/en/1"), (3, None), (4, "no scheme/en/"), (5, "x://a.net/de/8"), (6, "x://example.net/de/80#f"), (7, "x://h.org?/es/"), (7, "x://h.org?/es/")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 0, None), (1, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, labels).collect() if r["page_id"] != 3)
    assert got == [
        (1, "a.example.com", "/en/7", "example.com/en/7", "allow"), (2, "com", "/en/1", "com/en/", "block"), (4, "", "", None, "allow"), (5, "a.net", "/de/8", "net/de/", "block"),
        (6, "example.net", "/de/80", "example.net/de/8", "block"), (7, "h.org", "", None, "allow"), (7, "h.org", "", None, "allow"),
    ]
    assert url_filter.url_filter(pages.limit(0), labels.limit(0)).count() == 0 and url_filter.url_filter(pages, labels.limit(0)).count() == len(rows)
    long = spark.createDataFrame([(1, "x://h.org/" + "a/" * 200_000)], "page_id long, url string")
    assert len(url_filter.url_filter(long, labels).first()["path"]) == 400_001


def test_domains_and_suffixes(spark):
    cases = {"a.b.example.com": ("example.com", "com"), "x.shop.com.ng": ("shop.com.ng", "com.ng"), "a.co.uk:80": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "web.de": ("web.de", "de"), "a.com.de": ("com.de", "de"), "me@b.or.jp": ("b.or.jp", "or.jp"), "10.0.0.1": ("10.0.0.1", ""), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    assert {r["h"]: (r["d"], r["s"]) for r in df.select("h", *[c.alias(n) for c, n in zip(url_filter._parents(F.col("h")), "ds", strict=True)]).collect()} == cases


def test_each_level_of_a_reputation_changes_a_verdict(spark):
    """Bad pages out of 20 by host. new hosts have no labels and take what their domain or suffix gives."""
    bad = {f"h{i}.fine{j}.net": 1 for i in range(4) for j in range(30)}
    bad |= {f"h{i}.poor.net": 19 for i in range(6)} | {"good.poor.net": 0, "bad.fine1.net": 20}
    bad |= {f"h{i}.d{j}.evil": 18 for i in range(3) for j in range(6)}
    rows = [(f"x://{h}/{i}", i < n) for h, n in bad.items() for i in range(20)]
    new = ["new.poor.net", "new.fine1.net", "new.unheard.evil", "new.unheard.net", "new.unheard.zz"]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)] + [(100_000 + k, f"x://{h}/") for k, h in enumerate(new)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(not b), 0) for k, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")
    said = {r["host"]: r["verdict"] for r in url_filter.url_filter(pages, labels).collect()}
    assert said["bad.fine1.net"] == "block" and said["h1.fine1.net"] == "allow" and said["good.poor.net"] == "allow" and said["h1.poor.net"] == "block"  # the host
    assert said["new.poor.net"] == "block" and said["new.fine1.net"] == "allow"  # its domain
    assert said["new.unheard.evil"] == "block" and said["new.unheard.net"] == "allow" and said["new.unheard.zz"] == "allow"  # its suffix
    usual = spark.createDataFrame([(i, f"x://bad.org/{i}") for i in range(60)], "page_id long, url string")
    marks = spark.createDataFrame([(i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in url_filter.url_filter(usual, marks).collect()} == {"allow"}  # nothing is worse than all


# 6

def test_html_of_the_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in html_text.html_text(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = [x for x in (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", y)).split()) for y in re.split(r"</?(?:p|h1)>", body)) if x]
        assert (r["text"], r["n_chars"]) == ("\n".join(want), len("\n".join(want)))


def test_html_odd(spark):
    cases = {
        "<body><div id=main><p>a &amp; b<p>c <b>d</b><ul><li>x<li>y</ul><div class='cookie-notice'>n</div><!-- x --> t &lt;b&gt; <script>if(a<b)</script><a title='>'>l</a></div><footer>f</footer>": "a & b\nc d\nx\ny\nt <b> l",
        "<main><header><h1>T</h1></header><p>a\n  b<br>c</p><section id='comments'>no</section></main><aside>s</aside>": "T\na b c",
        "plain &euro; text": "plain € text", "": "", "<p": "", "<form>f<p>g</form>h": "h",
    }
    rows = [(i, h, "u") for i, h in enumerate(cases)] + [(99, None, None)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, html string, url string").withColumn("text", F.lit("clash"))
    got = html_text.html_text(df).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        assert r["text"] == cases.get(r["html"], "") and r["n_chars"] == len(r["text"])


def test_html_keeps_what_an_article_says():
    page = '<article><h2 id="search">Search</h2><section class="related-work"><p>Related work text</p></section><p>x <math><mi>y</mi></math> z</p><p class="menu">Menu of the day</p><h2 class="share-price">Price</h2><p id="ad">A.D. 5</p><div class="comments-intro">Intro</div><div class="share">tweet</div></article><p>beside</p>'
    assert html_text.main_text(page, {}, html_text.Tree(), html_text.Paths()) == "Search\nRelated work text\nx y z\nMenu of the day\nPrice\nA.D. 5\nIntro"


def test_html_leaves_out_what_stands_in_an_article_but_is_none_of_it():
    text = lambda page: html_text.main_text(page, {}, html_text.Tree(), html_text.Paths())
    assert text("<article></article><footer>f</footer><p>Sign in to read</p>") == "" and text("<main> </main><div>x</div>") == ""
    for part in (
        '<div class="comment-list"><p>x</p></div>', '<section class="user-comments">x</section>', '<ul class="comment-thread"><li>x</ul>', '<article class="comment"><p>x</p></article>', '<p class="advert">x</p>',
        '<div class="cookie-banner">x</div>', '<div id="ad-slot-3">x</div>', '<div class="wide shareButtons">x</div>', '<article id="comment-17">x</article>',
    ):
        for tag in ("article", "main"):
            assert text(f"<{tag}><p>before</p>{part}<p>after</p></{tag}><p>beside</p>") == "before\nafter", part
    assert text('<main><article class="story"><p>one</p></article><article class="story"><p>two</p></article></main>') == "one\ntwo"


def test_style_tree_finds_boilerplate(spark):
    page = lambda i: f"<body><div class=x1>Same words on all pages</div><div class=x2><p>Own text number {i} {'w' * i}</p><p>more of {i * i}</p></div></body>"
    df = spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(1, 21)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.html_text(df).collect()} == {f"Own text number {i} {'w' * i}\nmore of {i * i}" for i in range(1, 21)}


def test_style_tree_and_names_each_do_their_part(spark, monkeypatch):
    """Pages without article: a plain menu and a plain note that few variants share, which the tree finds, and comments, new on each page,
    which only their name tells. Short articles, so most of a page is boilerplate; copies of an article, which have to stay."""
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(n))
    menus, notes, copy = [some(12) for _ in range(5)], [some(60) for _ in range(3)], [some(25) for _ in range(3)]
    rows, want = [], {}
    for i in range(300):
        body = [some(20), *copy[1:]] if i % 3 == 0 else [some(rng.randint(3, 25)) for _ in range(rng.randint(1, 4))]
        menu = "".join(f"<li><a href=/{x}>{x}</a>" for x in rng.choice(menus).split())
        html = f"<html><body><div class=a><ul>{menu}</ul></div><div class=b>{''.join(f'<p>{x}</p>' for x in body)}</div><div class=c>{rng.choice(notes)}</div><div class=user-comments><p>{some(9)}</p></div></body></html>"
        rows.append((i, f"http://site.org/{i}", html))
        want[i] = "\n".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    right = lambda p: sum(r["text"] == want[r["page_id"]] for r in html_text.html_text(df, params=p).collect())
    assert right(html_text.Tree()) == 300
    assert right(html_text.Tree(names=False)) == 0 and right(html_text.Tree(pages=10_000)) == 0
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", 0)
    assert right(html_text.Tree()) == 300
    assert html_text.html_text(df.limit(0)).count() == 0
    long = "<article>" + "".join(f"<p>{k} " + "word " * 200 + "</p>" for k in range(3000)) + "</article>"
    assert html_text.html_text(spark.createDataFrame([(1, None, long)], df.schema)).first()["n_chars"] == sum(len(f"{k} ") + 999 for k in range(3000)) + 2999


# 1

def test_source_mix_keeps_to_its_weights(spark):
    rows = [(i, s) for i, s in enumerate(["a"] * 700 + ["b"] * 150 + ["c"] * 60 + [None] * 30)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, source string").withColumn("slot", F.lit("clash"))
    p = source_mix.Mix(block=8, slots=50, bucket=64)
    for weights in (None, {"a": 1.0, "b": 2.0, "c": 1.0, None: 0.5}):
        out = source_mix.source_mix(df, weights=weights, params=p).toPandas()
        sizes = df.groupBy("source").agg(F.count("*").alias("n"))
        share = {r["source"]: r["share"] / 50 for r in source_mix.shares(sizes, p, weights).collect()}
        assert abs(sum(share.values()) - 1) < 1e-9
        first = out[out["pass"] == 0]
        assert sorted(first.doc_id) == sorted(r[0] for r in rows + rows[:2])  # nothing is lost
        order = out.groupby("slot").source.agg(lambda x: x.iloc[0]).sort_index()
        assert list(order.index) == list(range(len(order))) and (out.groupby("slot").source.nunique(dropna=False) == 1).all()
        for s, w in share.items():
            done = np.cumsum([(x is None and s is None) or x == s for x in order])
            assert np.abs(done - w * np.arange(1, len(order) + 1)).max() < 1
        blocks = out.groupby(["source", "block", "pass"], dropna=False).size()
        assert blocks.max() == 8
    once = source_mix.source_mix(df, params=source_mix.Mix(block=8, slots=50, once=True))
    assert once.count() == len(rows) + 2 and source_mix.source_mix(df.limit(0)).count() == 0


def test_source_mix_takes_weights_as_they_are(spark):
    df = spark.createDataFrame([(i, "b" if i < 12 else f"s{i % 30}") for i in range(3000)], "doc_id long, source string")
    weights = {"b": 0.0003, **{f"s{i}": 0.9997 * (i + 1) / 465 for i in range(30)}}
    out = source_mix.source_mix(df, weights=weights, params=source_mix.Mix(block=4, slots=20)).select("source", "slot").distinct().toPandas().sort_values("slot")
    assert list(out.slot) == list(range(len(out))) and len(out) > 6000
    for s, w in weights.items():
        assert np.abs(np.cumsum(out.source == s) - w * np.arange(1, len(out) + 1)).max() < 1
    who, which = source_mix.schedule([0.7, 0.2, 0.1], [1000, 10, 3])
    for i, w in enumerate((0.7, 0.2, 0.1)):
        done = np.array(who) == i
        assert np.abs(np.cumsum(done) - w * np.arange(1, len(who) + 1)).max() < 1 and list(np.array(which)[done]) == list(range(done.sum()))


def test_schedule_is_earliest_deadline_first():
    from fractions import Fraction

    rng = random.Random(13)
    for _ in range(30):
        n = rng.randint(1, 6)
        weights = [Fraction(rng.randint(1, 40)) for _ in range(n)]
        blocks = [rng.randint(0, 12) for _ in range(n)]
        w = [x / sum(weights) for x in weights]
        want, k, t = [], [0] * n, 0
        while any(k[i] < blocks[i] for i in range(n)):
            released = [i for i in range(n) if t >= math.floor(k[i] / w[i])]
            i = min(released, key=lambda i: (math.ceil((k[i] + 1) / w[i]), i))
            want.append((i, k[i]))
            k[i] += 1
            t += 1
        who, which = source_mix.schedule([float(x) for x in weights], blocks)
        assert list(zip(who, which, strict=True)) == want


# 7

def test_pack_is_best_fit():
    rng = random.Random(3)
    n = 300
    lengths, clusters, sources = [rng.randint(1, 100) for _ in range(n)], [rng.randint(0, 40) for _ in range(n)], [rng.choice("abc") for _ in range(n)]
    got = best_fit.pack(lengths, clusters, sources, 100, 2)
    bins, want = [], [None] * n
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        fits = [(100 - sum(lengths[j] for j in b), k) for k, b in enumerate(bins) if sum(lengths[j] for j in b) + lengths[i] <= 100 and clusters[i] not in {clusters[j] for j in b} and sum(sources[j] == sources[i] for j in b) < 2]
        if not fits:
            bins.append([])
        k = min(fits)[1] if fits else len(bins) - 1
        want[i] = (k, len(bins[k]))
        bins[k].append(i)
    assert got == want


def test_best_fit(spark, data):
    df = sample(spark, data)
    out = best_fit.best_fit(df, params=best_fit.Packing(capacity=300, per_source=2, group=64)).toPandas()
    assert out.groupby(["pack_group", "bin"]).length.sum().max() <= 300
    assert out.groupby(["pack_group", "bin", "source"], dropna=False).size().max() <= 2
    tokens = {r["doc_id"]: len(WORD.findall(r["text"] or "")) + 1 for r in df.collect()}
    copies = collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())
    for i, n in out.dropna(subset=["doc_id"]).groupby("doc_id").length.sum().items():
        assert n == tokens[int(i)] * copies[int(i)]
    assert best_fit.best_fit(df.limit(0)).count() == 0
    p = best_fit.Packing(capacity=300, per_source=2, group=64)
    clash = df.withColumn("bin", F.lit("x")).withColumn("piece", F.lit(None).cast("string"))
    one, other = (sorted(map(repr, best_fit.best_fit(x, params=p).collect())) for x in (clash, clash.repartition(3, "source").orderBy(F.desc("doc_id"))))
    assert one == other and len(one) == len(out)


# 10

def test_long_texts_are_dealt_to_groups_by_their_pieces(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(60_001).alias("n"))
    out = best_fit.best_fit(df.withColumn("text", F.col("doc_id").cast("string")), tokens=F.col("n"), params=best_fit.Packing(group=64)).groupBy("pack_group").count().collect()
    assert sum(r["count"] for r in out) == 600 and len(out) == 10 and max(r["count"] for r in out) < 100


def plain_groups(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("leaf", "block"), [(64, 2048), (2, 2048), (2, 5)])
def test_jaccard_groups(spark, data, leaf, block):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(60)) for _ in range(4)]
    near = []
    for t in base * 6:
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "new" + str(rng.random())
        near.append(" ".join(w))
    df = texts(spark, [*near, "A b C", "a b c d", "a b c d e f", "A B C D E F"])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = jaccard_join.jaccard_groups(df, params=jaccard_join.Join(leaf=leaf, block=block, cell_bits=12))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_groups(rows)
    if leaf == 64:
        assert jaccard_join.jaccard_groups(df.limit(0)).count() == 0
        real = documents(spark, data).select("doc_id", "text")
        assert sorted((tuple(r) for r in jaccard_join.jaccard_groups(real).collect()), key=repr) == plain_groups([tuple(r) for r in real.collect()])


def test_each_step_finds_links(spark):
    """Chains of texts of which each is linked with the next alone: a pivot reaches few, so blocks have to find the others."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for _ in range(3):
        now = [word() for _ in range(200)]
        for _ in range(25):
            now = now[4:] + [word() for _ in range(4)]
            rows.append((len(rows), " ".join(now)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = jaccard_join.Join(leaf=4, block=8, cell_bits=12)
    steps = jaccard_join.link_steps(df, params=p)
    assert steps["first round"] > 0 and steps["pivots"] + steps["small regions"] + steps.get("blocks", 0) > 0
    assert sorted(map(tuple, jaccard_join.jaccard_groups(df, params=p).collect()), key=repr) == plain_groups(rows)


def test_sketches_lose_no_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, m = rng.integers(1, 400, 2)
        common = rng.integers(0, min(n, m) + 1)
        every = rng.integers(0, 1 << 63, n + m - common).astype(np.uint64)
        a, b = every[:n], every[n - common :]
        s = jaccard_join._sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
        apart = np.bitwise_count(s[0] ^ s[1]).sum()
        assert apart <= n + m - 2 * common
        if 100 * common >= 75 * (n + m - common):
            assert jaccard_join._may_link(np.array([n]), np.array([m]), np.array([apart]), 75)[0]


def test_one_of_each(spark):
    a, b, c = ("a1 a2 a3 a4 a5 a6 a7", "b1 b2 b3 b4 b5 b6", "c1 c2")
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "x"), (6, b, "z"), (None, c, "u"), (None, c, "t"), (None, "", "v"), (8, None, "w"), (8, None, "w"), (9, " \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, jaccard_join.one_of_each(df).collect()), key=repr) == sorted([(3, a, "x"), (5, b, "x"), (None, c, "t"), *rows[7:]], key=repr)
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


# 3

def test_exact_topk_sql(spark, data, same_rows):
    same_rows(queries.op3_exact_topk(spark, data), queries.ORACLES["op3_exact_topk"])


def test_exact_topk_odd(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [1.0, 1.0]), (None, [1.0] * 4), (50, [1.0] * 4), (400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, (i, q) in enumerate(good):
        if i is not None and i % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for m, (j, v) in enumerate(good) if m != k]
            want += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(scored)[:5])]
    out = exact_topk.exact_topk(df, params=exact_topk.Search(block=16, part=64, queries=3))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert exact_topk.exact_topk(df.limit(0)).count() == 0


def test_exact_topk_of_large_numbers(spark):
    """Scores that doubles can't tell apart: 2 ** 53 and one more, found at home and in another part."""
    rows = [(50, [1, 0, 1 << 20])] + [(i, [(1 << 53) + (i == 7), 0, -i]) for i in range(1, 5)] + [(7, [(1 << 53) + 1, 0, 0]), (8, [1 << 53, 0, 0])] + [(100 + i, [0, 100 + i, 0]) for i in range(1, 40)]
    blocks = [exact_topk.Block(np.array([i for i, _ in rows]), np.array([i for i, _ in rows]), (v := np.array([v for _, v in rows], dtype=np.int64)), v.max(axis=0), v.min(axis=0))]
    hits = exact_topk.search(blocks, np.array([-1]), np.array([[1, 0, 0]], dtype=np.int64), 2)
    assert hits.score[0].tolist() == [(1 << 53) + 1, 1 << 53] and hits.id[0].tolist() == [7, 1]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    good = [(i, [math.floor(256 * x / 256) for x in v]) for i, v in rows]
    want = [(-sum(a * b for a, b in zip(good[0][1], [math.floor(256 * (x / 256)) for x in v], strict=True)), i) for i, v in rows[1:]]
    out = exact_topk.exact_topk(df, params=exact_topk.Search(block=4, part=8)).orderBy("rank").collect()
    assert [(-r["score"], r["vec_id"]) for r in out if r["query_id"] == 50] == sorted(want)[:5]


def test_queries_go_where_a_bound_reaches_them_alone(spark):
    p = exact_topk.Search(block=4, part=8, told=2)
    values = lambda part: np.eye(8, dtype=np.int64)[[part] * 4] * 100
    blocks = spark.createDataFrame([(k, np.arange(4).tobytes(), np.arange(4).tobytes(), values(k).tobytes(), 8) for k in range(5)], "part int, rows binary, ids binary, values_ binary, width int")
    asked = spark.createDataFrame([(1, 1, [0, 0, 1] + [0] * 5, 0, "50"), (2, 2, [1, 0, 1] + [0] * 5, 0, "100"), (3, 3, [1], 4, None)], "row long, id long, v array<long>, part int, least string")
    assert sorted((r["row"], r["part"]) for r in exact_topk.surviving(asked, blocks, p).collect()) == [(1, 2), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3)]


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    block = lambda c: exact_topk.Block(np.arange(64) + 1000 * c, np.arange(64) + 1000 * c, (v := rng.integers(0, 5, (64, 8)) + (np.arange(8) == c) * 100), v.max(axis=0), v.min(axis=0))
    blocks, looked = [block(c) for c in range(8)], []
    q = np.eye(8, dtype=np.int64)[2:3] * 9
    add = exact_topk.Hits.add
    exact_topk.Hits.add = lambda self, rows, scores, ids: looked.append(ids[0]) or add(self, rows, scores, ids)
    try:
        exact_topk.search(blocks, np.array([-1]), q, 5)
    finally:
        exact_topk.Hits.add = add
    assert looked == [2000]


# 2

SMALL = context_mixing.Model(coded=60, known=200, slot_bits=10, task_words=3000, learn_words=2000, common=8, anchor=2)


def lower_words(t):
    return (t or "").encode().lower().split() + [b""]


def plain_count(byte):
    """Counts to 64 as they are, then 191 equal steps of their logarithm up to 2^40."""
    return byte if byte <= 64 else round(2 ** (6 + 34 * (byte - 64) / 191))


def plain_bits(model, words, train):
    """What each word's code costs, a bit at a time, with Python numbers; words: hashes."""
    c, mask = model.coder, 0xFFFFFFFF
    place = {int(k): i for i, k in enumerate(c.keys)}
    symbol = [int(c.symbols[place.get(w, len(c.keys))]) for w in words]
    short = [((w ^ w >> 32) & mask) | 1 for w in words]
    out = []
    for i, s in enumerate(symbol):
        one, two = (short[i - k] if i >= k else 0 for k in (1, 2))
        often = [j for j in range(i) if symbol[j] < min(c.m.common, c.escape)][-2:]
        near, far = (short[often[-k]] if len(often) >= k else 0 for k in (1, 2))
        contexts = [one * 0x9E3779B1 + 1, (one * 0x85EBCA6B & mask ^ two * 0xC2B2AE35 & mask) + 2, two * 0x27D4EB2F + 3, (near * 0x165667B1 & mask ^ far * 0xD3A2646D & mask) + 4, (one * 0xFD7046C5 & mask ^ near * 0xB55A4F09 & mask) + 5]
        contexts = [(x & mask) ^ (x & mask) >> 16 for x in contexts]
        bits = 0.0
        for at in range(c.firsts[s], c.firsts[s] + c.lengths[s]):
            node, bit = int(c.nodes[at]), int(c.bits[at])
            turned = (node + 1) * 0xCC9E2D51 & mask
            turned ^= turned >> 15
            x, seen = [], []
            for table, h in zip(model.tables, contexts, strict=True):
                pair = int(table[((h ^ turned) * 2654435761 & mask) >> 32 - model.slot_bits])
                counts = [plain_count(pair & 255), plain_count(pair >> 8)]
                if train and counts[bit]:
                    counts[bit] -= 1
                x.append(math.log((counts[1] + 0.4) / (counts[0] + 0.4)))
                seen.append(sum(sum(counts) >= k for k in (1, 3, 24)))
            gate = 4 * seen[1] + seen[0]
            mixed = sum(w[gate] * v for w, v in zip(model.weights, [*x, float(c.often[at]), 1.0], strict=True))
            cell = min(node, 255) * 129 + int(max(-8.0, min(8.0, mixed)) * 8 + 64.5)
            bits += model.costs[2 * cell + bit]
        out.append(bits)
    return symbol, out


def plain_chunks(words, anchor):
    """(from, to, signed hash) of the chunks of a text, with Python numbers."""
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & m
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & m
        return x ^ x >> 31

    out, start = [], 0
    for i, w in enumerate(words):
        if mix(w * 0xA0761D6478BD642F + (words[i - 1] if i else 0) & m) >> 64 - anchor == 0 or i == len(words) - 1:
            part = words[start : i + 1]
            value = mix(sum(mix(x + (part[j - 1] if j else 0) * 0xE7037ED1A0B428DB & m) for j, x in enumerate(part)) & m)
            out.append((start, i + 1, value - (1 << 64) if value >> 63 else value))
            start = i + 1
    return out


def test_lm_scores(spark, data):
    df = sample(spark, data)
    out = context_mixing.lm_scores(df, params=SMALL).collect()
    assert len(out) == df.count()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for i, t in rows:
        if not held(i):
            c.update(lower_words(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower_words(t))
    want = sorted((repr(i), held(i), len(lower_words(t)), sum(c[w] > 0 for w in lower_words(t)), n, round(base(t), 6)) for i, t in rows)
    assert want == sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert context_mixing.lm_scores(df.limit(0), params=SMALL).count() == 0
    held_back = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held_back) > sum(r["base_score"] for r in held_back)


def test_lm_scores_are_those_of_a_plain_mixer(spark, data):
    docs = sample(spark, data).select(F.col("doc_id").alias("id"), "text")
    held = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(10)) == 0
    learnt = docs.withColumn("held_out", held).filter("not held_out")
    words = context_mixing.written(context_mixing.count_words(learnt))
    total = words.agg(F.sum("c")).first()[0]
    model = context_mixing.train(learnt, words, total, SMALL)
    counts = collections.Counter(w for r in learnt.collect() for w in lower_words(r["text"]))
    hasher = context_mixing.WordHasher()
    name = lambda w: int(hasher([w]).__next__()[1][0]) if w else int(context_mixing.END)
    hashes = {w: name(w) for w in counts}
    assert dict(zip(model.coder.keys.tolist(), model.coder.counts.tolist(), strict=True)).items() <= {hashes[w]: n for w, n in counts.items()}.items()
    rest = sum(counts.values()) - sum(sorted(counts.values())[::-1][: SMALL.coded])
    below = rest + 0.1 * (len(counts) - SMALL.coded + 1)
    got = {(repr(r["doc_id"]), r["n_tokens"]): r["score"] for r in context_mixing.lm_scores(docs.withColumnRenamed("id", "doc_id"), params=SMALL).collect()}
    texts_ = [(r["id"], r["held_out"], lower_words(r["text"])) for r in docs.withColumn("held_out", held).collect()]
    cut = {id(t): plain_chunks([hashes.get(w) or name(w) for w in t], SMALL.anchor) for _, _, t in texts_}
    moves = collections.defaultdict(collections.Counter)
    for _, out, t in texts_:
        for before, (_, _, value) in zip([None, *(v for _, _, v in cut[id(t)])], cut[id(t)], strict=False):
            if not out:
                moves[before][value] += 1
    saved = 0
    for i, out, told in texts_:
        if len(told) < 400:
            symbols, bits = plain_bits(model, [hashes.get(w) or name(w) for w in told], not out)
            bits = [b - (math.log2((counts[w] + 0.1) / below) if s == model.coder.escape else 0) for w, s, b in zip(told, symbols, bits, strict=True)]
            total, before = 0.0, None
            for a, z, value in cut[id(told)]:
                after = moves[before].copy()
                if not out:
                    after[value] -= 1
                n, d, c, cost = sum(after.values()), sum(x > 0 for x in after.values()), after[value], sum(bits[a:z])
                p = c / (n + d) + (d / (n + d) * 2.0**-cost if cost < 1000 else 0.0) if n else 0.0
                total += cost if not n else -math.log2(p) if c else cost - math.log2(d / (n + d))
                saved += c > 0
                before = value
            assert got[repr(i), len(told)] == pytest.approx(-total * math.log10(2), rel=2e-3)
    assert saved > 20


def test_copies_stand_apart(spark):
    """A text that stands in the corpus a second time costs a fraction of what one that does not costs, held out or not."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=150))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in context_mixing.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), params=context_mixing.Model(slot_bits=12)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    twice = [out[a] for i in range(20) for a, b in ((i, 1000 + i), (1000 + i, i)) if not held(b)]
    assert min(twice) > -0.5 and max(out[i] for i in range(20, 400)) < -2


def test_contexts_are_counted_whole_however_texts_are_split(spark):
    m = context_mixing.Model(coded=4)
    rows = [(i, "a b a b " * (300 if i == 0 else 2) + f"w{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string")
    words = context_mixing.count_words(docs).toPandas().sort_values("h", key=lambda h: h.to_numpy().view(np.uint64))
    coder = context_mixing.Coder(words.h.to_numpy().view(np.uint64), words.c.to_numpy(), int(words.c.sum()), m)
    shared = types.SimpleNamespace(value=coder)
    one, many = (context_mixing.context_tables(docs.repartition(n), shared, 10, tasks) for n, tasks in ((1, 1), (8, 100)))
    assert (one == many).all() and one.max() > 255
    big = np.array([0, 254, 255, 1 << 40], dtype=np.int64)
    assert (context_mixing._unpacked(context_mixing._packed(big), 4) == big).all()


def test_counts_keep_their_ratio_and_lose_their_own_one():
    pairs = np.array([[100_000, 1], [1_000_000, 3_000], [300, 1], [255, 1], [20, 1], [0, 0], [64, 65], [1 << 40, 7]])
    coded = context_mixing._paired(pairs)
    assert len(set(coded.tolist())) == len(pairs)
    for (z, o), byte in zip(pairs.tolist(), coded.tolist(), strict=True):
        assert all(abs(plain_count(b) - c) <= 0.07 * c for b, c in ((byte & 255, z), (byte >> 8, o)))
        whole, less = context_mixing._STRETCH[byte], context_mixing._STRETCH[byte + 2 * 65536]
        assert whole == pytest.approx(math.log((plain_count(byte >> 8) + 0.4) / (plain_count(byte & 255) + 0.4)), abs=1e-5)
        assert less < whole or not o
    big = np.unique(np.geomspace(1, 2.0**40, 5000).astype(np.int64))
    back = context_mixing._COUNTED[np.searchsorted(context_mixing._MIDDLES, big)]
    assert (np.abs(back - big) <= 0.07 * big).all()


def test_a_word_s_costs_are_a_probability(spark):
    """Over all codes the probabilities of one context sum to one."""
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 1000, 40)
    coder = context_mixing.Coder(np.sort(rng.integers(0, 1 << 63, 40).astype(np.uint64)), counts, int(counts.sum()) + 17, context_mixing.Model(coded=30))
    refined = rng.uniform(0.05, 0.95, 256 * 129)
    model = context_mixing.Trained(coder, rng.integers(0, 65536, (5, 1024)).astype(np.uint16), rng.normal(size=(7, 16)).astype(np.float32), -np.log2(np.stack([1 - refined, refined], axis=1)).ravel(), 10)
    n = coder.escape + 1
    bits = model.word_bits(np.arange(n), np.repeat(rng.integers(0, 1 << 32, (5, 1)).astype(np.uint32), n, axis=1), np.zeros(n, dtype=np.int32))
    assert n == 31 and (2.0**-bits).sum() == pytest.approx(1.0)


def test_lm_scores_know_the_order_of_words(spark):
    rng = random.Random(6)
    line = "north wind moved slowly over the old stone bridge while two quiet boats went home".split()
    rows = [(i, " ".join(line * 3 + [rng.choice(line)])) for i in range(300)] + [(10_000 + i, " ".join(rng.sample(line * 3, len(line) * 3))) for i in range(20)]
    out = {r["doc_id"]: r["score"] / r["n_tokens"] for r in context_mixing.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), params=context_mixing.Model(slot_bits=14)).collect()}
    assert min(out[i] for i in range(300)) > max(out[10_000 + i] for i in range(20))


# pipeline

def test_pipeline(spark, data):
    docs = documents(spark, data)
    clean = {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, data)
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == docs.columns
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(kept).collect()}
    single = stages["near_duplicates"](spark, kept.unionByName(kept.limit(3)), data)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(groups.values()))
    for name, stage in stages.items():
        empty = stage(spark, docs.limit(0), data)
        assert empty.count() == 0 and (name == "pack" or empty.columns == docs.columns)
    mixed = stages["mix"](spark, single, data)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(groups.values())
    placed = source_mix.source_mix(single).select("doc_id", "slot", "place").toPandas().sort_values(["slot", "place"])
    assert [r["doc_id"] for r in mixed.collect()] == placed.doc_id.tolist()
    packed = corpus_pipeline.run(spark, data).toPandas()
    assert set(packed.doc_id) == set(groups.values()) and len(packed.groupby(["doc_id", "piece"])) <= len(packed)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    times, tokens = collections.Counter(placed.doc_id), packed.groupby("doc_id").length.sum()
    assert all(tokens[i] == times[i] * (len(WORD.findall(text[i])) + 1) for i in times)
    for _, window in packed.groupby(["pack_group", "bin"]):
        assert window.length.sum() <= 2048 and window.doc_id.is_unique and window.source.value_counts().max() <= 4
        assert sorted(window.place) == list(range(len(window)))


def test_windows_of_the_pipeline_follow_the_mix(spark):
    """Each group packs a stretch of the mix: its documents are of the sources by their weights, within a block."""
    rows = [(i, f"{'w ' * 400}{i}", "abc"[(i % 10 > 4) + (i % 10 > 7)]) for i in range(6000)]
    docs = spark.createDataFrame(rows + [(None, None, None), (None, None, None), (1, "x " * 30_000, "a")], "doc_id long, text string, source string")
    out = corpus_pipeline.pack(spark, docs, "").toPandas()
    assert out.pack_group.nunique() > 1 and out.groupby("doc_id").ngroups == 6000 and len(out) == 6002 + -(-30_001 // 2048)
    share = {"a": 0.5, "b": 0.3, "c": 0.2}
    for _, group in out[out.doc_id != 1].groupby("pack_group"):
        n = group.source.value_counts()
        assert all(abs(n.get(s, 0) - share[s] * len(group)) <= 2 * 64 for s in share)
    ranges = out.groupby("pack_group").slot.agg(["min", "max"]).sort_index()
    assert (ranges["min"].iloc[1:].to_numpy() > ranges["max"].iloc[:-1].to_numpy()).all()  # stretches follow each other
    for _, window in out.groupby(["pack_group", "bin"]):
        assert window.length.sum() <= 2048


def test_stages_take_odd_rows(spark):
    """Null ids and texts, very long texts, repeated rows and columns with clashing names."""
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", "de", None, 0), (3, "word " * 60_000, "en", "s", 1), (4, " ".join(f"w{k}" for k in range(120)), "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.withColumns({c: F.lit("clash") for c in ("slot", "place", "piece", "kept", "__size", "component_id")})
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, more, "")
    assert [r["doc_id"] for r in kept.collect()] == [4] and kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in stages["near_duplicates"](spark, more, "").collect()) == sorted(["None", "1", "1", "2", "3", "4"])
    mixed = stages["mix"](spark, more, "")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == {None, 1, 2, 3, 4}
    packed = stages["pack"](spark, more, "").collect()
    assert sum(r["length"] for r in packed) == 4 + 60_001 + 121 and len(packed) == 5 + -(-60_001 // 2048)
