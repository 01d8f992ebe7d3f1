"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Expressions of Spark SQL only. For each number of shingles T that a template has, a text is cut into windows of T + T // 2 + stride - 1 shingles,
one every stride = max(1, T // 4): an occurrence of the template, with up to half as much text put in, lies whole in one of them. The
Jaccard similarity of a window that holds ``CONTAINED`` percent of a template with it is at least 0.375, so with ``BANDS`` bands of one
row each, a template is missed with probability (1 - 0.375) ** 32 = 3e-7 at that edge, and far less for whole copies.

Texts without any of a few words, and windows without any shingle of a template, hold no template and are left out before.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import once

SHINGLE = 5
CONTAINED = 75
BANDS = 32
#: Shingles of all templates up to which windows without a known shingle are left out; beyond it all windows are compared, with the same result.
LISTED_SHINGLES = 20_000
WORDS = r"[0-9a-z\x{80}-\x{10ffff}]+"
# Public license wording. Holders' names and years are not part of it.
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_FURNISHED = ", and to permit persons to whom the Software is furnished to do so"
_INCLUDED = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_NOT_USED = " Except as contained in this notice, the name of the copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the copyright holder."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_LISTS = ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISING = " All advertising materials mentioning features or use of this software must display the following acknowledgement"
_NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
_LATER = "; either version {} of the License, or (at your option) any later version."
_ONLY = ", version {} of the License."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _GRANT),
    ("MIT", _GRANT + _FURNISHED + _INCLUDED + _AS_IS),
    ("MIT-0", _GRANT + _FURNISHED + "." + _AS_IS),
    ("X11", _GRANT + _FURNISHED + _INCLUDED + _AS_IS + _NOT_USED),
    ("BSD", _REDISTRIBUTION),
    ("BSD-2-Clause", _REDISTRIBUTION + _LISTS),
    ("BSD-3-Clause", _REDISTRIBUTION + _LISTS + _NAMES),
    ("BSD-3-Clause", _NAMES),
    ("BSD-4-Clause", _REDISTRIBUTION + _LISTS + _ADVERTISING + _NAMES),
    ("BSD-4-Clause", _ADVERTISING),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", _GNU.format("program", ":", "")),
    ("GPL-3.0-or-later", _GNU.format("program", ":", "") + _LATER.format("3")),
    ("GPL-2.0-or-later", _GNU.format("program", ";", "") + _LATER.format("2")),
    ("GPL-3.0-only", _GNU.format("program", ":", "") + _ONLY.format("3")),
    ("GPL-2.0-only", _GNU.format("program", ";", "") + _ONLY.format("2")),
    ("AGPL", _GNU.format("program", ":", "Affero ")),
    ("AGPL-3.0-or-later", _GNU.format("program", ":", "Affero ") + _LATER.format("3")),
    ("AGPL-3.0-only", _GNU.format("program", ":", "Affero ") + _ONLY.format("3")),
    ("LGPL", _GNU.format("library", ";", "Lesser ")),
    ("LGPL", _GNU.format("program", ":", "Lesser ")),
    ("LGPL-2.1-or-later", _GNU.format("library", ";", "Lesser ") + _LATER.format("2.1")),
    ("LGPL-3.0-or-later", _GNU.format("program", ":", "Lesser ") + _LATER.format("3")),
    ("LGPL-2.1-only", _GNU.format("library", ";", "Lesser ") + _ONLY.format("2.1")),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced or transmitted in any form or by any means without prior written permission"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def shingles(found: Column) -> Column:
    """Hashes of each run of five words, in order; fewer words have none."""
    places = F.when(F.size(found) >= SHINGLE, F.sequence(F.lit(0), F.size(found) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.xxhash64(*[F.get(found, k + i) for i in range(SHINGLE)]))


def bands(window: Column) -> Column:
    """The smallest hash under each of ``BANDS`` seeds, with the band's number."""
    def band(k: Column) -> Column:
        return F.xxhash64(k, F.array_min(F.transform(window, lambda x: F.xxhash64(x, k))))

    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), band)


def templates_of(spark: SparkSession, listed: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in listed])
    return spark.range(1).select(F.inline(rows))


def _gate(texts: list[str]) -> list[str]:
    """Words of which every text that holds ``CONTAINED`` percent of a template holds one: one word of each of so many shingles that not all
    of them can be absent."""
    chosen: set[str] = set()
    for text in texts:
        found = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        distinct = list(dict.fromkeys(tuple(found[k : k + SHINGLE]) for k in range(len(found) - SHINGLE + 1)))
        spare = len(distinct) - math.ceil(len(distinct) * CONTAINED / 100)
        best = sorted(distinct, key=lambda s: (not chosen & set(s), -max(map(len, s))))
        for shingle in best[: spare + 1]:
            if not chosen & set(shingle):
                chosen.add(max(shingle, key=len))
    return sorted(chosen)


def scan(docs: DataFrame, templates: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and license found: doc_id, license, n_shingles of the template, n_matched (most of them in a window), first_word
    (the number of the word where the first window's first shingle of it begins).

    ``templates`` (license, text) is a list that a person keeps: its texts pass through the driver, and to each task. Templates of fewer
    than five words are one shingle and match as a whole. Of matches that begin at one word the one with the most shingles counts, then the one
    found to the greatest part; a match that lies inside one of another license whose template holds its own is left out; and of
    one license the longest match is reported. So a template that relatives have in common names the family (``GPL``, ``BSD``) only where no
    clause decides between them. Null or empty texts hold nothing, rows that share an id are one document, an empty table gives
    an empty result; only the two columns are read.
    """
    templates = templates_of(docs.sparkSession) if templates is None else templates
    known = templates.select("license", F.col("text").alias("body")).where("body IS NOT NULL").distinct()
    known = once(once(known, words=words(F.col("body"))), template=F.array_distinct(shingles(F.col("words")))).where(F.size("words") > 0)
    listed = known.select("license", "body", "words", "template").collect()
    whole = [r for r in listed if r["template"]]
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    verified = _short_matches(given, [r for r in listed if not r["template"]])
    if whole:
        long = _matches(given, known.where(F.size("template") > 0), whole)
        verified = long if verified is None else long.unionByName(verified)
    if verified is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, license string, n_shingles bigint, n_matched bigint, first_word bigint")
    # Where texts of several licenses share shingles, the one with the most of them counts.
    match = F.struct("n_matched", (F.col("n_matched") / F.col("n_shingles")).alias("share"), "license", "n_shingles", "last_word", "holders")
    here = verified.groupBy("doc_id", "first_word").agg(F.max(match).alias("m")).select("doc_id", F.struct("first_word", "m.*").alias("m"))
    # The matches of one text are at most as many as its words.
    per_text = here.groupBy("doc_id").agg(F.collect_list("m").alias("all"))
    kept = F.filter("all", lambda m: (F.size(m["holders"]) == 0) | ~F.exists("all", lambda o: _covers(o, m)))
    found = per_text.select("doc_id", F.explode(kept).alias("m")).select("doc_id", "m.*")
    best = F.max(F.struct("n_matched", "n_shingles", (-F.col("first_word")).alias("f"))).alias("best")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "best.n_shingles", "best.n_matched", (-F.col("best.f")).alias("first_word"))


def _covers(other: Column, match: Column) -> Column:
    """Whether a match encloses one whose template its own license holds."""
    around = (other["first_word"] <= match["first_word"]) & (other["last_word"] >= match["last_word"])
    return F.array_contains(match["holders"], other["license"]) & around & (other["n_matched"] >= match["n_matched"])


def _holders(known: DataFrame) -> DataFrame:
    """Per license and size of its templates, the other licenses that have a template which holds ``CONTAINED`` percent of one of these."""
    own = known.select("license", "body", F.size("template").alias("size"), F.explode("template").alias("shingle"))
    other = own.select(F.col("license").alias("holder"), F.col("body").alias("holding"), "shingle")
    shared = own.join(other, "shingle").where("license <> holder").groupBy("license", "body", "size", "holder", "holding").count()
    return shared.where(F.col("count") * 100 >= F.col("size") * CONTAINED).groupBy("license", "size").agg(F.array_sort(F.collect_set("holder")).alias("holders"))


def _short_matches(given: DataFrame, listed: list) -> DataFrame | None:
    """Matches of templates that are shorter than a shingle: their words in a row."""
    if not listed:
        return None
    low = F.lower(F.col("text"))
    given = given.where(reduce(or_, [low.contains(max(r["words"], key=len)) for r in listed]))
    given = once(given, words=words(F.col("text")))
    rows = F.array(*[F.struct(F.array(*map(F.lit, r["words"])).alias("found"), F.lit(r["license"]).alias("license")) for r in listed])
    per_length = []
    for length in sorted({len(r["words"]) for r in listed}):
        wanted = [F.array(*map(F.lit, r["words"])) for r in listed if len(r["words"]) == length]
        last = F.size("words") - length
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        per_length.append(F.filter(F.transform(places, _run_of(length)), _one_of(wanted)))
    hits = given.select("doc_id", F.explode(F.concat(*per_length)).alias("h")).select("doc_id", "h.*")
    table = given.sparkSession.range(1).select(F.inline(rows))
    one = F.lit(1).cast("long")
    return hits.join(table, "found").select(
        "doc_id", "license", one.alias("n_shingles"), one.alias("n_matched"), F.col("place").cast("long").alias("first_word"),
        (F.col("place") + F.size("found") - 1).cast("long").alias("last_word"), F.array().cast("array<string>").alias("holders"),
    )


def _one_of(wanted: list[Column]):
    return lambda run: reduce(or_, [run["found"] == one for one in wanted])


def _run_of(length: int):
    return lambda k: F.struct(k.alias("place"), F.slice("words", k + 1, F.lit(length)).alias("found"))


def _matches(given: DataFrame, known: DataFrame, listed: list) -> DataFrame:
    """Windows that hold enough of a template: doc_id, license, n_shingles, n_matched, first_word, last_word, holders."""
    hashes = sorted({h for r in listed for h in r["template"]})
    sizes = sorted({len(r["template"]) for r in listed})

    low = F.lower(F.col("text"))
    gate = reduce(or_, [low.contains(word) for word in _gate([r["body"] for r in listed])])
    given = once(given.where(gate), words=words(F.col("text")))
    given = once(given.select("doc_id", "words"), hashes=shingles(F.col("words"))).select("doc_id", "hashes")
    if len(hashes) <= LISTED_SHINGLES:
        places = F.filter(F.transform("hashes", lambda h, k: F.when(h.isin(hashes), k)), lambda k: k.isNotNull())
    else:
        places = F.when(F.size("hashes") > 0, F.sequence(F.lit(0), F.size("hashes") - 1)).otherwise(F.array().cast("array<int>"))
    given = once(given, places=places)

    per_size = []
    for size in sizes:
        stride = max(1, size // 4)
        length = size + size // 2 + stride - 1
        starts = F.array_distinct(F.flatten(F.transform("places", _windows(stride, length))))
        per_size.append(F.transform(starts, _window(size, stride, length)))
    given = once(given, windows=F.concat(*per_size))
    cut = given.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.*")
    keyed = once(cut, bands=bands(F.array_distinct("window")))
    keyed = keyed.select("doc_id", "size", "start", "window", F.explode("bands").alias("band"))
    table = known.withColumn("size", F.size("template")).join(_holders(known), ["license", "size"], "left")
    holders = F.coalesce("holders", F.array().cast("array<string>")).alias("holders")
    table = table.select("license", "template", "size", holders, F.explode(bands(F.col("template"))).alias("band"))
    retrieved = keyed.join(F.broadcast(table) if len(hashes) <= LISTED_SHINGLES else table, ["size", "band"])
    matched = F.size(F.array_intersect("window", "template"))
    verified = once(retrieved, n_matched=matched).where(F.col("n_matched") * 100 >= F.col("size") * CONTAINED)
    inside = F.filter(F.transform("window", lambda h, k: F.when(F.array_contains(F.col("template"), h), k)), lambda k: k.isNotNull())
    verified = once(verified, inside=inside)
    place = lambda at: (F.col("start") + at).cast("long")
    return verified.select(
        "doc_id", "license", F.col("size").cast("long").alias("n_shingles"), F.col("n_matched").cast("long").alias("n_matched"),
        place(F.array_min("inside")).alias("first_word"), place(F.array_max("inside") + (SHINGLE - 1)).alias("last_word"), "holders",
    )


def _windows(stride: int, length: int):
    """Numbers of the windows that a place lies in."""
    first = lambda place: F.greatest(F.ceil((place - (length - 1)) / F.lit(stride)).cast("int"), F.lit(0))
    return lambda place: F.sequence(first(place), F.floor(place / F.lit(stride)).cast("int"))


def _window(size: int, stride: int, length: int):
    return lambda k: F.struct(F.lit(size).alias("size"), (k * stride).alias("start"), F.slice(F.col("hashes"), k * stride + 1, F.lit(length)).alias("window"))


def oracle() -> str:
    """The same rows by counting the shingles of each template in each window, for DuckDB."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    split = "regexp_extract_all(lower({}), '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+')"
    return f"""
WITH t AS (SELECT DISTINCT license, body, {split.format("body")} AS w FROM (VALUES {quoted}) v(license, body)),
ts AS MATERIALIZED (SELECT DISTINCT license, body, list_slice(w, k, k + 4) AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM t)),
sizes AS MATERIALIZED (SELECT license, body, count(*) AS size FROM ts GROUP BY ALL),
d AS (SELECT doc_id, {split.format("text")} AS w FROM documents),
ds AS MATERIALIZED (SELECT doc_id, k - 1 AS place, list_slice(w, k, k + 4) AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d)),
hits AS (SELECT doc_id, license, body, size, place, s, greatest(1, size // 4) AS stride FROM ds JOIN ts USING (s) JOIN sizes USING (license, body)),
wins AS (SELECT *, unnest(range(greatest(0, CAST(ceil((place - (size + size // 2 + stride - 2)) / stride) AS BIGINT)), place // stride + 1)) AS win FROM hits),
found AS MATERIALIZED (SELECT doc_id, license, body, size, win, count(DISTINCT s) AS n, min(place) AS place, max(place) AS last FROM wins GROUP BY ALL HAVING count(DISTINCT s) * 100 >= size * {CONTAINED}),
here AS MATERIALIZED (SELECT doc_id, license, size, n, place, last FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY n DESC, n / size DESC, license DESC, size DESC, last DESC) = 1),
held AS MATERIALIZED (SELECT DISTINCT license, size, holder FROM (SELECT a.license, a.body, b.license AS holder, b.body AS holding, count(*) AS n FROM ts a JOIN ts b USING (s)
WHERE a.license <> b.license GROUP BY ALL) JOIN sizes USING (license, body) WHERE n * 100 >= size * {CONTAINED}),
kept AS (SELECT * FROM here m WHERE NOT EXISTS (SELECT 1 FROM here o JOIN held h ON h.holder = o.license
WHERE o.doc_id = m.doc_id AND h.license = m.license AND h.size = m.size AND o.place <= m.place AND o.last >= m.last AND o.n >= m.n))
SELECT doc_id, license, size AS n_shingles, n AS n_matched, place AS first_word FROM kept
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY n DESC, size DESC, place) = 1
"""
