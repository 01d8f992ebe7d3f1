"""Operators on single texts against brute force: quality rules, URLs, decontamination, personal data, licenses, pages, quotes."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnwise.llm import common, contamination, html_text, licenses, personal_data, quotes, repetition, urls

WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))


def texts(rng, n):
    marks = [" ", "  ", "\n", "\n\n", "\t", "\x1c ", "é ", "# ", "$%& ", "| "]
    return ["".join(rng.choice(WORDS) + rng.choice(marks) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def docs_of(spark, values, extra="row string, n_words string, kept int, text_ string"):
    rows = [(i, v, "a", "b", 1, "c") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


# ---- quality rules ----


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def covered(text, n):
    words = text.split()
    seen, hit = set(), set()
    for i in range(len(words) - n + 1):
        if tuple(words[i : i + n]) in seen:
            hit |= set(range(i, i + n))
        seen.add(tuple(words[i : i + n]))
    return sum(len(words[i]) for i in hit)


def test_quality_rules(spark):
    values = [None, "", " \n\t", LONG, "same line here\n" * 40, "x " * 500, *texts(random.Random(1), 300)]
    values += values[:20]  # repeated rows
    found = repetition.repetition_coverage(docs_of(spark, values)).collect()
    assert len(found) == len(values)
    for r in found:
        assert tuple(r[1:6]) + (r.base_failed,) == rule_counts(r.row.text), r.row.doc_id
        assert not (r.base_failed and r.kept)
        if r.row.text and len(r.row.text) < 5000:
            assert r.dup_ngram_chars == [covered(r.row.text, n) for n in (5, 7, 10)]
    kept = repetition.keep_good(docs_of(spark, values))
    assert kept.columns == docs_of(spark, values[:1]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.row.doc_id for r in found if r.kept)
    assert repetition.repetition_coverage(docs_of(spark, values).limit(0)).count() == 0


# ---- urls ----


def test_url_rules_and_terms(spark):
    rules = urls.UrlRules(rules=(("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/")))
    wanted = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme casino": ("", "", None, "block"),
        "http://A.Example.ORG/en/12?q=1": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "http://badexample.org/es/1": ("badexample.org", "/es/1", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://org/x#y": ("org", "/x", "org/", "allow"),
        "https://free-bets.example.net/a": ("free-bets.example.net", "/a", None, "block"),
        "https://www.freebets.example.net/free": ("www.freebets.example.net", "/free", None, "allow"),
        "https://free.example.net/free/FREE": ("free.example.net", "/free/FREE", None, "allow"),
        "https://x.com/casinos": ("x.com", "/casinos", None, "allow"),
        "https://casino.com/fr/x": ("casino.com", "/fr/x", "com/fr/", "allow"),
        "https://h.net?casino": ("h.net", "", None, "block"),
        "https://" + "a" * 200_000: ("a" * 200_000, "", None, "allow"),
    }
    rows = [(k, u, "clash", "clash") for k, u in enumerate(wanted)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, row string")
    found = urls.judge_urls(pages, rules).collect()
    assert len(found) == 2 * len(wanted)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == wanted[r.row.url], r.row.url
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


# ---- decontamination ----


def item_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(text, items, window):
    words, hit, found = item_words(text), set(), set()
    for item, body in items:
        own = item_words(body)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add("" if item is None else str(item))
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_decontamination(spark, block_bytes):
    rng = random.Random(3)
    body = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(k, body(rng.choice([2, 3, 5, 9]))) for k in range(12)] + [(3, "Ünïcode, TWO—three"), (None, "twelve eleven"), (99, None), (98, " ?! "), (4, body(5))]
    values = [None, "", "?", *[body(rng.randint(1, 60)) for _ in range(60)], "a ünïcode... two—three b", "twelve-eleven", items[0][1].upper() + "!"]
    values += values[:9]
    docs, bench = docs_of(spark, values, "runs string, items string, row string, scanned string"), spark.createDataFrame(items, "item_id long, text string")
    found = contamination.with_passages(contamination.find_items(docs, bench, window=4, block_bytes=block_bytes)).collect()
    assert len(found) == len(values)
    for r in found:
        n, hit, names = brute_hits(r.row.text, items, 4)
        assert (r.n_words, {w for run in r.runs for w in range(run["first"], run["after"])}, r.items) == (n, hit, names)
        for run, place in zip(r.runs, r.passages, strict=True):
            assert item_words(r.row.text[place["start"] : place["end"]]) == item_words(r.row.text)[run["first"] : run["after"]]
    clean = {r.row.doc_id for r in found if not r.runs}
    kept = contamination.keep_clean(docs, bench, window=4, block_bytes=block_bytes)
    assert {r.doc_id for r in kept.collect()} == clean and kept.columns == docs.columns
    assert contamination.find_items(docs, bench.limit(0)).where(F.size("runs") > 0).count() == 0


# ---- personal data ----

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            valid = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]
            if valid():
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def trees(spark):
    return personal_data.train(spark, n=600)


def test_personal_data(spark, trees):
    rng = random.Random(5)
    units = [*"0123456789", "@", ".", "-", " ", "+", "(", ")", "a", "Z", "é", "_", "1.", "@a.b", "4111 1111 1111 1111"]
    values = [None, "", "x" * 200_000 + "@y.z", "1.1.1.1" * 50, "a@b.c," * 500, "a@b.c_d@e.f", "300.1.1.1 001.02.3.255", "5" * 60, "call 555-123-4567 or mail joe(at)foo(dot)com"]
    values += ["".join(rng.choice(units) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    values += values[:5]
    docs = docs_of(spark, values, "base string, spans string, row string, wide string")
    found = personal_data.find_spans(docs, trees).collect()
    assert len(found) == len(values)
    for r in found:
        base, spans = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
        assert base == brute_spans(r.row.text), r.row.text
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (personal_data.KINDS.index(s[0]), s[1], s[2]))
    added = [tuple(s) for s in next(r for r in found if r.row.doc_id == 8).spans]
    assert added == [("email", 26, 44), ("phone", 5, 17)]
    clean = {r.doc_id: r.text for r in personal_data.redact(docs, trees).collect()}
    assert clean[0] is None and clean[1] == "" and clean[8] == "call [PHONE] or mail [EMAIL]"
    assert clean[5] == "[EMAIL][EMAIL]" and personal_data.redact(docs, trees).columns == docs.columns
    assert personal_data.find_spans(docs.limit(0), trees).count() == 0


def test_trees_on_held_out_rows(spark, trees):
    rows = spark.createDataFrame(personal_data.training_rows(400, seed=99), "row long, text string, label int")
    found = personal_data.find_spans(rows, trees).select("row.label", F.size("spans").alias("n")).collect()
    taken = [r.label for r in found if r.n]
    assert sum(taken) / len(taken) >= 0.95
    assert sum(taken) / sum(r.label for r in found) >= 0.8


def test_forms_that_the_generator_does_not_make(spark):
    personal = {
        "email": ["JANE (AT) EXAMPLE (DOT) COM", "jane at example dot com", "Bob_Smith AT mail DOT example DOT org", "Maria.Lopez2 at Uni-Bonn dot de", "kim [AT] example [DOT] net"],
        "ip": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "2001:DB8:0:0:8:800:200C:417A", "1[.]2[.]3[.]4", "192(.)168(.)0(.)7", "10.0.0[.]5", "8 dot 8 dot 4 dot 4"],
    }
    other = ["met at noon.Then", "std::vector", "at 12:30:45", "00:1b:44:11:3a:b7", "list[::2]", "Foo::Bar", "looks at the dot on it", "300[.]1[.]1[.]1", "1:2:3", "abc::def", "the ratio 16:9:4"]
    rows = [(kind, value) for kind, values in personal.items() for value in values] + [("", value) for value in other]
    texts = [(k, f"Yesterday we saw {value} in the text.") for k, (_, value) in enumerate(rows)]
    found = personal_data.find_spans(spark.createDataFrame(texts, "row long, text string"), personal_data.train(spark)).collect()
    spans = {r.row.row: [(s["kind"], r.text[s["start"] : s["end"]].removeprefix("saw ")) for s in r.spans] for r in found}
    assert {rows[k][1]: s for k, s in spans.items()} == {value: [(kind, value)] if kind else [] for kind, value in rows}


def test_numbers_and_prose(spark, data):
    trees = personal_data.train(spark)
    personal = {
        "1-800-555-0199": "1-800-555-0199", "my number is 555.123.4567": "555.123.4567", "tel 030 901820": "030 901820", "call 1 (800) 555-0199": "1 (800) 555-0199",
        "call 555-0199 now": "555-0199", "(030) 901820": "(030) 901820", "write to bob at uni.de": "bob at uni.de",
    }
    prose = ["inhe at and. At", "haly th at thhablewh. Es", "meet at noon dot com", "look at it. Me too", "pages 1200-1300", "in 1914-1918", "order 1234 5678 9012", "version 1.800.555.0199", "at home. De"]
    rows = [(k, f"Yesterday we saw {value} in the text.") for k, value in enumerate([*personal, *prose])]
    found = personal_data.find_spans(spark.createDataFrame(rows, "row long, text string"), trees).collect()
    spans = {r.row.row: [r.text[s["start"] : s["end"]] for s in r.spans] for r in found}
    assert [spans[k] for k, _ in rows] == [[v] for v in personal.values()] + [[]] * len(prose)
    # The given documents hold base forms only: whatever else is accepted there would be prose.
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert personal_data.find_spans(docs, trees).where(F.size("spans") > F.size("base")).count() == 0


def test_candidates_hide_nothing_from_each_other(spark):
    trees = personal_data.Trees(((1.0, personal_data.Leaf(1.0)),), 0.0)  # accepts all
    text = "joe at foo (at) bar.com, 1 800 555 1234"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = {text[s["start"] : s["end"]] for r in personal_data.find_spans(docs, trees).collect() for s in r.spans}
    assert {"foo (at) bar.com", "1 800 555 1234"} <= spans and "800 555 1234" not in spans


# ---- licenses ----


def test_licenses(spark):
    filler = lambda n, seed: " ".join(random.Random(seed).choices([f"v{i}" for i in range(400)], k=n))
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and 200 < len(t) < 500)
    words = mit.split()
    edited = " ".join(words[:30] + ["inserted"] + words[30:])
    values = [
        None, "", "Licensed", f"{filler(300, 1)}. Released under the MIT License. {filler(50, 2)}", f"{filler(77, 3)} {mit.upper()} {filler(999, 4)}",
        f"{filler(5, 5)}\n{edited}\n{filler(5, 6)}", " ".join(words[: len(words) // 2]), "This work is licensed under the GNU General Public License, version 3.",
        "license license copyright " * 300, LONG,
    ]
    docs = docs_of(spark, values + values, "words string, hashes string, license string, row string")
    found = {r.doc_id: (r.license, r.n_matched / r.n_shingles, r.first_word) for r in licenses.scan(docs).collect()}
    assert found[3] == ("MIT", 1, 300) and found[4][:2] == ("MIT", 1) and found[4][2] == 77
    assert found[5][0] == "MIT" and 0.75 <= found[5][1] < 1 and found[7] == ("GPL-3.0", 1, 0)
    assert set(found) == {3, 4, 5, 7, 13, 14, 15, 17}
    assert licenses.scan(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None), ("a", "four words are few"), ("b", "  ")], "license string, text string")
    assert licenses.scan(docs, none).count() == 0 and licenses.scan(docs, none.where("license = 'b'")).count() == 0
    short = spark.createDataFrame([("a", "public domain"), ("b", "Domain"), ("c", mit)], "license string, text string")
    texts = ["in the PUBLIC, domain and a domain", "publicdomain domains", f"a domain {mit}"]
    found = licenses.scan(docs_of(spark, texts), short).orderBy("doc_id", "license").collect()
    assert [(r.doc_id, r.license, r.n_matched, r.first_word) for r in found] == [(0, "a", 1, 2), (0, "b", 1, 3), (2, "b", 1, 1), (2, "c", found[-1].n_shingles, 2)]


def test_relatives_of_licenses(spark):
    """Notices at every offset within the stride of the windows, and with words around them."""
    notice = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, version 3."
    opening = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    lists = (
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    )
    names = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    later = notice.replace(", version 3.", ", either version {} of the License, or (at your option) any later version.")
    whole = {n: t for n, t in licenses.TEMPLATES if n in ("MIT", "MIT-0", "X11", "BSD-4-Clause") and len(t) > 500} | {"BSD-4-Clause": next(t for n, t in licenses.TEMPLATES if n == "BSD-4-Clause")}
    cases = [
        (notice.format("program", "").replace(", version 3", ""), {"GPL"}), (notice.format("program", "Affero ").replace(", version 3", ""), {"AGPL"}),
        (notice.format("library", "Lesser ").replace(", version 3", ""), {"LGPL"}), (notice.format("program", "Lesser ").replace(", version 3", ""), {"LGPL"}),
        (later.format("program", "", 3), {"GPL-3.0-or-later"}), (later.format("program", "", 2), {"GPL-2.0-or-later"}), (later.format("program", "Affero ", 3), {"AGPL-3.0-or-later"}),
        (later.format("library", "Lesser ", "2.1"), {"LGPL-2.1-or-later"}), (notice.format("program", "").replace("version 3", "version 2 of the License"), {"GPL-2.0-only"}),
        (opening, {"BSD"}), (opening + lists, {"BSD-2-Clause"}), (opening + lists + "3. " + names, {"BSD-3-Clause"}), ("Distributed under the Boost Software License, Version 1.0.", {"BSL-1.0"}),
        *[(text, {name}) for name, text in whole.items()], (whole["MIT"].replace("OR OTHER DEALINGS", "OR ANY OTHER DEALING"), {"MIT"}), (whole["MIT-0"].replace("OR OTHER DEALINGS", "OR ANY OTHER DEALING"), {"MIT-0"}),
        (f"{whole['MIT-0']} and then {names}", {"MIT-0", "BSD-3-Clause"}),
    ]
    rows = [(len(cases) * k + c, f"{'word ' * k}{text} {' '.join(WORDS)}") for k in range(13) for c, (text, _) in enumerate(cases)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg(F.collect_set("license").alias("names")).collect()
    assert {r.doc_id: set(r.names) for r in found} == {k: cases[k % len(cases)][1] for k, _ in rows}


def test_license_windows_without_list_of_shingles(spark, monkeypatch):
    values = [f"{' '.join(WORDS * 3)} {text} {' '.join(WORDS)}" for _, text in licenses.TEMPLATES[:9]]
    docs = docs_of(spark, values)
    templates = licenses.templates_of(spark).where("length(text) < 120")
    listed = set(map(tuple, licenses.scan(docs, templates).collect()))
    monkeypatch.setattr(licenses, "LISTED_SHINGLES", 0)
    assert listed and set(map(tuple, licenses.scan(docs, templates).collect())) == listed


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav>
<div class="cookie-notice">we use cookies</div><div class="story-{0}"><h2>Title &amp; more</h2><p>First <b>bo</b>ld <a href="x">link</a> text of the page number {0}.
<p>Second<br>line &lt;{0} a < b &nbsp; end<form><p>form</p></form><div class="ad">buy</div><section id="comments"><p>{1}</p></section></div>
<aside>side bar</aside><footer>&copy; foot</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_pages(spark):
    rows = [(k, f"http://h.org/{k}", PAGE.format(k, "a reader says a lot of things, " * 9)) for k in range(8)]
    rows += [(100, None, None), (101, "http://h.org/e", ""), (102, "x", "only text"), (103, "http://h.org/z", "<p>cut off <b>here</b> <i"), (104, "http://h.org/s", "<script>a")]
    rows += [(105, "http://H.org/long", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>" + "word " * 100_000)]
    rows += rows[:2]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, path string")
    found = html_text.main_text(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        k = r.row.page_id
        if k < 8:
            assert r.text == f"Title & more First bold link text of the page number {k}. Second line <{k} a < b end"
            assert r.path == "html>body>div.story-#"
    by_id = {r.row.page_id: r.text for r in found}
    assert [by_id[k] for k in (100, 101, 102, 103, 104)] == ["", "", "only text", "cut off here", ""]
    assert len(by_id[105]) >= 499_999
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_host_path_decides_between_containers(spark):
    page = "<body><div class=main><p>{}</p></div><div class=box><p>{}</p></div></body>"
    rows = [(k, "http://a.b/", page.format("story " * 30, "note " * 5)) for k in range(5)] + [(9, "http://a.b/", page.format("short story", "long note " * 20))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.path for r in html_text.main_text(pages).collect()} == {"html>body>div.main"}


def test_every_page_gives_its_article(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract("row.html", r"(?s)<article>(.*?)</article>", 1), "</?b>", ""), "<[^>]*>", " ")
    found = html_text.main_text(pages).where("NOT row.html RLIKE '(?s)<article>.*&.*</article>'")
    squeezed = F.trim(F.regexp_replace(plain, r"\s+", " "))
    assert found.count() > 0 and found.where(F.col("text") != squeezed).count() == 0


@pytest.mark.parametrize(
    "body",
    [
        "<div class=post><div class=part>{0}</div><div class=part>{1}</div></div>",
        "<article><h1>Head</h1><section>{0}</section><section>{1}</section></article>",
        "<main><article><h1>Head</h1><section class=a>{0}</section><section class=b>{1}</section></article></main>",
        "<main><h1>Head</h1><article>{0}{1}</article></main>",
        "<div class=post><h1>Head</h1><div class=first>{0}</div><div class=second>{1}</div></div>",
        "<div class=post><div class=row><div class=left>{0}</div><div class=right>{1}</div></div></div>",
        "<div class=rows><div class=row><div class=col>{0}</div></div><div class=row><div class=col>{1}</div></div></div>",
    ],
)
def test_no_part_of_an_article_is_dropped(body):
    long, short = "many words " * 50, "few words " * 12
    page = f"<body><nav>menu</nav>{body.format(f'<p>{long}</p>', f'<p>{short}</p>')}<footer>foot</footer></body>"
    wanted = f"Head {long}{short}" if "Head" in body else f"{long}{short}"
    for path in (None, html_text.votes(page)[0][0]):
        assert html_text.extract(page, path)[0] == wanted.strip()


def test_a_path_gives_all_its_containers():
    page = "<body><div class=p><p>one two</p></div><div class=x>other</div><div class=p><p>three</p></div><div class=p><a href=y>link</a></div></body>"
    assert html_text.extract(page, "html>body>div.p") == ("one two three", "html>body>div.p")


def test_holders_of_noise_and_forms():
    said = "<p>a reader says a lot of things</p>" * 30
    text = lambda body: html_text.extract(f"<body>{body}</body>", None)[0]
    for name in ("ad-container", "comments-wrapper", "cookie-wrapper", "sidebar-container", "newsletter-wrap", "ad no-print"):
        assert text(f"<article><p>The story</p><div class='{name}'><p>noise</p></div><p>ends</p></article>") == "The story ends", name
        assert text(f"<article><p>The story.</p></article><div class='{name}'>{said}</div>") == "The story.", name
        assert text(f"<div><h1>The story.</h1><p>It ends.</p></div><div class='{name}'>{said}</div>") == "The story. It ends.", name
    for name in ("sidebar-container", "page-with-sidebar", "has-sidebar", "container comments", "layout no-sidebar"):
        assert text(f"<div class='{name}'><article><p>The story.</p></article><aside>side</aside></div>") == "The story.", name
        assert text(f"<div class='{name}'><h1>A</h1><p>story.</p><div class=comments>{said}</div></div>") == "A story.", name
    comments = f"<div class=comments-container><article class=comment>{said}</article></div>"
    assert text(f"<div class=page-sidebar><article><p>The story.</p></article>{comments}</div>") == "The story."
    page = "<form id=aspnetForm><input value=x><label>label</label><div><h1>A</h1><p>story.</p></div><div class=ad-wrap><p>buy</p></div></form>"
    assert text(page) == "A story."
    assert text(f"<form role=search><p>find</p></form>{page}") == "A story."
    assert text("<article><p>The story.</p><form><p>Your name</p></form></article>") == "The story."


def test_names_alone_never_lose_an_article():
    text = lambda body: html_text.extract(f"<body><nav>menu</nav>{body}<footer>foot</footer></body>", None)[0]
    story = "<p>The story.</p><p>" + "It goes on. " * 20 + "</p>"
    wanted = ("The story. " + "It goes on. " * 20).strip()
    for around in ("<div id=main class='post comments-open'>", "<div class=widget>", "<div class='docs login'>", "<div class=notice>", "<div class='ad-hoc'>"):
        assert text(f"{around}{story}</div>") == wanted, around
        assert text(f"<article><h1>Title</h1>{around}{story}</div></article>") == f"Title {wanted}", around
        assert text(f"{around}<article>{story}</article></div>") == wanted, around
    assert text(f"<section class='notice-of-motion'>{story}</section>") == wanted
    for name in ("share-price", "notice-period", "ad-hoc", "advert-free", "comments-open", "related-to-this"):
        assert text(f"<article>{story}<div class={name}>Inside.</div></article>") == f"{wanted} Inside.", name
    for name in ("share-buttons", "ad", "cookie-notice", "newsletter-signup", "related-posts", "adSlot", "discussion", "feedback", "comment-thread"):
        assert text(f"<article>{story}<div class={name}>Inside.</div></article>") == wanted, name
    assert text(f"<article><h1>T</h1><p>Short.</p><div class=comments>{story * 9}</div></article>") == "T Short."
    assert text(f"<article><header><h1>T</h1><p>The lead.</p><nav><p>menu</p></nav><div class=share><p>share</p></div></header>{story}</article>") == f"T The lead. {wanted}"
    assert text(f"<h1>T</h1><main>{story}<h2>Part</h2>{story}</main>") == f"T {wanted} Part {wanted}"
    assert text(f"<h1>Site</h1><main><h2>T</h2>{story}</main>") == f"T {wanted}"
    assert text(f"<article>{story}<div style='color:red; display: none'>unseen</div><p style='display:block'>Seen.</p></article>") == f"{wanted} Seen."
    stub = f"<body><div class=teaser-text>stub</div><div class=box><p>stub of a page</p></div><article>{story}</article></body>"
    assert html_text.extract(stub, "html>body>div.box") == (wanted, "html>body>article")


def test_made_pages(spark):
    """Articles among noise, under neutral and misleading names: nearly all words of the article and nearly none of the noise."""
    rng = random.Random(11)
    plain, misleading = ["post", "content", "c-12", "entry-body", "text"], ["comments-open", "notice-of-motion", "share-price", "docs login", "widget"]
    noise = ["<div class={}>{}</div>", "<div id={}><p>{}</p></div>", "<section class={}><div><p>{}</p></div></section>"]
    names, tags = ["sidebar", "cookie-notice", "ad", "comments", "related-posts", "newsletter-signup"], ["nav", "aside", "footer", "form"]
    rows = []
    for k in range(300):
        words = lambda mark, n: " ".join(f"{mark}{rng.randrange(999)}" for _ in range(n))
        parts = [f"<p>{words('w', rng.randint(20, 60))}</p>" for _ in range(rng.randint(3, 6))]
        junk = [rng.choice(noise).format(rng.choice(names), words("x", rng.randint(3, 12))) for _ in range(3)]
        junk += [f"<{t}>{words('x', 5)}</{t}>" for t in rng.sample(tags, 2)]
        if rng.random() < 0.5:
            parts.insert(1, f"<div class={rng.choice(misleading).split()[0]}>{words('w', 9)}</div>" if k % 3 == 0 else junk.pop())
        tag = rng.choice(["article", "main", "div", "section"])
        body = f"<{tag} class='{rng.choice(plain + misleading if k % 2 else plain)}'><h1>{words('w', 4)}</h1>{''.join(parts)}</{tag}>"
        at = rng.randint(0, len(junk))
        rows.append((k, f"http://h{k}.org/", f"<html><body>{''.join(junk[:at])}{body}{''.join(junk[at:])}</body></html>"))
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kept = right = whole = 0
    for r in found:
        wanted, given = re.findall(r"\bw[0-9]+", r.row.html), r.text.split()
        whole, kept, right = whole + len(wanted), kept + len(given), right + sum(w[0] == "w" for w in given)
    assert right / whole >= 0.98 and right / kept >= 0.98, (right / whole, right / kept)


# ---- quotes ----


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there everybody.\nHow do I write a join in this engine?"),
        (1, 1, "assistant", "On Monday, user wrote:\n> How do I write a join in\n> this engine?\n\nYou call the join method.\nSee the guide for more of it."),
        (1, 2, "user", "> > How do I write a join in this engine?\r\n> You call the join method.\r\n\r\nThanks a lot, that helps me!"),
        (1, 3, "user", "No quotes in here at all."),
        (1, 4, "assistant", ">> You call the join method.\n> Thanks a lot, that helps me!\nWelcome then."),
        (1, 4, "assistant", ">> You call the join method.\n> Thanks a lot, that helps me!\nWelcome then."),
        (2, 0, "user", "> Hello there everybody.\nfrom another one"), (None, 0, "user", "> x"), (2, None, "user", None), (3, 0, "user", ""),
        (4, 0, "user", LONG), (4, 1, "user", "> " + LONG + "\nlong one"),
    ]
    rows += [(5, k, "user", (f"> message number {k - 1} of five\n" if k else "") + f"message number {k} of five") for k in range(40)]
    messages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, parent string, lines string")
    linked = quotes.link_quotations(messages)
    found = linked.collect()
    assert len(found) == len(rows)
    by_key = {(r.conv_id, r.turn): r for r in found}
    links = {k: (r.parent_turn, r.root_turn, r.depth, r.text) for k, r in by_key.items()}
    assert links[1, 1] == (0, 0, 1, "You call the join method.\nSee the guide for more of it.")
    assert links[1, 2] == (1, 0, 2, "Thanks a lot, that helps me!") and links[1, 4] == (2, 0, 3, "Welcome then.")
    assert links[1, 3] == (None, 3, 0, "No quotes in here at all.") and links[2, 0] == (None, 0, 0, "from another one")
    assert links[None, 0][3] == "" and links[2, None][3] is None and links[4, 1][::3] == (0, "long one")
    assert [links[5, k][:3] for k in (1, 2, 39)] == [(0, 0, 1), (1, 0, 2), (38, 0, 39)] and links[5, 39][3] == "message number 39 of five"
    nested = {(r.conv_id, r.root_turn): [m.turn for m in r.messages] for r in quotes.conversations(linked).collect()}
    assert nested[1, 0] == [0, 1, 2, 4] and nested[1, 3] == [3] and nested[5, 0] == list(range(40))
    assert quotes.link_quotations(messages.limit(0)).count() == 0


def parents(spark, *conversations):
    rows = [(c, k, "user", text) for c, texts in enumerate(conversations) for k, text in enumerate(texts)]
    found = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by_key = {(r.conv_id, r.turn): r for r in found}
    return [[by_key[c, k].parent_turn for k in range(len(texts))] for c, texts in enumerate(conversations)]


@pytest.mark.parametrize("sayers", [8, 0])
def test_own_words_and_the_latest_sayer_decide(spark, monkeypatch, sayers):
    monkeypatch.setattr(quotes, "SAYERS", sayers)
    monkeypatch.setattr(quotes, "PIECE_TURNS", 4)
    long, thanks = "This is a very long passage that everybody quotes again and again", "Thanks a lot for your help."
    replies = [long, f"> {long}\nI agree.", f"> {long}\nI do not.", f">> {long}\n> I do not.\nWhy not?"]
    repeated = [thanks, "Something else.", thanks, "Another thing.", f"> {thanks}\nWelcome.", *["Filler."] * 20, f"> {thanks}\nStill welcome."]
    found = parents(spark, replies, repeated, [*[thanks] * 30, f"> {thanks}\nAll right."])
    assert found[0] == [None, 0, 0, 2]
    assert found[1][4] == 2 and found[1][-1] == 2
    assert found[2][-1] == 29


def test_who_said_all_of_a_quote_wins(spark):
    talk = ["The first point is here.\n\nThe other point is there.", "The first point is here.", "The other point is there.", "> The first point is here.\n\n> The other point is there.\nBoth."]
    assert parents(spark, talk)[0][-1] == 0


@pytest.mark.parametrize("n", [3, 12])
def test_number_of_sayers_does_not_decide(spark, n):
    a, b = "The first point is here.", "The other point is there."
    talk = ["Hello.", f"{a}\n\n{b}", *[a] * n, *[b] * n, f"> {a}\n\n> {b}\nBoth."]
    assert parents(spark, talk)[0][-1] == 1


def brute_passages(text, level_of, sizes=None):
    """{(level, passage, whole): characters} of a text: paragraphs, lines, sentences and windows of words."""
    found, run, at = {}, [], None
    for line in [*text.split("\n"), "> " * 9]:
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        level, body = marks.count(">"), re.sub(r"^(?:[ \t]*>)+ ?", "", line)
        if (level != at or not body.strip()) and run:
            for unit in {" ".join(" ".join(x).lower().split()) for x in ([*run], *[[y] for y in run])}:
                words = re.findall(r"\w+", unit)
                if level_of(at) >= 0:
                    found |= {(level_of(at), p, True): len(p) for p in [unit, *re.split(r"(?<=[.!?]) ", unit)]}
                    for size in sizes or {min(5, len(words))}:
                        windows = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if size else []
                        found |= {(level_of(at), w, False): len(w) for w in windows}
            run = []
        if body.strip():
            run.append(body)
        at = level
    return found


def brute_parents(talk):
    out = []
    asked = [brute_passages(t, lambda level: level - 1) for t in talk]
    sizes = {len(p.split()) for found in asked for _, p, whole in found if not whole}
    said = [brute_passages(t, lambda level: level, sizes) if sizes else {} for t in talk]
    for turn, wanted in enumerate(asked):
        best = None
        for earlier in range(turn):
            shared = [k for k in wanted if k in said[earlier]]
            if shared:
                votes = [sum(wanted[k] for k in shared if (k[0] == 0) == own) for own in (True, False)]
                best = max(best or (), (*votes, earlier))
        out.append(best and best[-1])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_parents_equal_comparing_all_messages(spark, seed):
    rng = random.Random(seed)
    talks = []
    for n in (5, 30, 220):
        pool = [" ".join(rng.choices("red green blue big small round flat old new far".split(), k=rng.randint(1, 7))) + rng.choice(".!?") for _ in range(rng.randint(3, 9))]
        talk = []
        for _ in range(n):
            lines = rng.choices(pool, k=rng.randint(1, 3))
            quoted = rng.choice(talk).split("\n") if talk and rng.random() < 0.4 else []
            talk.append("\n".join([*(f"> {q}" for q in rng.sample(quoted, min(len(quoted), rng.randint(1, 3)))), *lines]))
        talks.append(talk)
    assert parents(spark, *talks) == [brute_parents(talk) for talk in talks]


def test_parts_and_short_quotes(spark):
    talks = [
        ["One thing is. Another is this. The third too.", "No.", "> Another is this.\nYes."],
        ["We could move the whole of the data over to the new\nengine before the winter comes and look at it then.", "No.", "> data over to\n> the new engine before the\n> winter comes\nYes."],
        ["Is it up?", "What is it?", "> Is it up?\nYes."],
        ["42", "43", "> 42\nWhy?"],
        ["你好吗？我很好。", "再见", "> 你好吗？\n好"],
        ["今天天气很好，我们去公园", "再见", "> 天气很好\n好"],
        ["You call the join method for it.", "See you.", "> the join method\nThanks."],
        ["Yes.", "I say yes. But only now.", "No", "> Yes.\nGood."],
    ]
    assert [found[-1] for found in parents(spark, *talks)] == [0, 0, 0, 0, 0, 0, 0, 0]


def test_blocks_of_items_are_bounded(spark):
    items = spark.createDataFrame([("a", "same words here")] * 500 + [(f"i{k}", f"other words {k} " * (k % 9)) for k in range(300)] + [("big", "long item " * 400), ("none", None)], "item_id string, text string")
    blocks = [[(r[0], len(r[1])) for r in block.collect()] for block in contamination._blocks(items, "item_id", "text", 1000)]
    assert sorted(i for block in blocks for i, _ in block) == sorted(["a", "big", *(f"i{k}" for k in range(300))])
    assert all(len(block) == 1 or sum(n for _, n in block) <= 2000 for block in blocks)


NO_SETTING = """
from pyspark.sql import SparkSession
from turnwise.llm import common
spark = SparkSession.builder.master("local[1]").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = common.shared_dir(spark)
assert first == common.shared_dir(spark) and common.written(spark.range(3), "t").count() == 3
class Cluster:
    master, getCheckpointDir = "spark://host:7077", lambda self: None
class Session:
    sparkContext, conf = Cluster(), spark.conf
try:
    common.shared_dir(Session())
except RuntimeError as error:
    print("refused:", error)
"""


def test_shared_folder_without_the_setting(tmp_path):
    """A session whose defaults set no folder: a local one makes its own, a cluster is told to set one."""
    environment = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", NO_SETTING], env=environment, capture_output=True, text=True, timeout=300)
    assert "refused: set spark.checkpoint.dir" in done.stdout, done.stderr[-2000:]


def test_shared_folder_is_read_from_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(personal_data.span_text(F.array().cast(f"array<{personal_data.SPAN}>")), 256)).collect()[0][0]
