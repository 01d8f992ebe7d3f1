"""DuckDB SQL that gives the rows of the queries whose operators SQL can express."""

from __future__ import annotations

import string

from turnwise.llm.fill_middle import MiddleRules
from turnwise.llm.repetition import RepetitionRules
from turnwise.llm.urls import SOFT_TERMS, STRICT_TERMS


def lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def quality_rules(rules: RepetitionRules) -> str:
    """Words by place, repeated n-grams by window functions, covered places by unnesting."""
    space = r"[\x20\x09-\x0D]+"
    grams = """SELECT doc_id, i, list_slice(w, i, i + {0} - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {0} + 2)) AS i FROM d)"""
    covered = "".join(
        f""",
c{n} AS (SELECT doc_id, sum(length(w[p])) AS c{n} FROM (
  SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM ({grams.format(n)})) WHERE k > 1
  ) JOIN d USING (doc_id) GROUP BY doc_id)"""
        for n in rules.ngrams
    )
    joins = "".join(f" LEFT JOIN c{n} USING (doc_id)" for n in rules.ngrams)
    limits = "".join(f" AND coalesce(c{n}, 0) <= {share}::DOUBLE * word_chars" for n, share in zip(rules.ngrams, rules.max_ngram_share, strict=True))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r3 AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (
    SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM ({grams.format(3)})) WHERE k > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '{space}', '', 'g'))) AS line_chars FROM lines WHERE k > 1 GROUP BY doc_id){covered},
counts AS (SELECT *, len(w) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
joined AS (SELECT *, n_words < {rules.min_words} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM counts LEFT JOIN r3 USING (doc_id) LEFT JOIN dup USING (doc_id){joins})
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(line_chars, 0) <= {rules.max_line_share}::DOUBLE * word_chars
    AND n_symbols <= {rules.max_symbols}::DOUBLE * n_words{limits} AS kept
FROM joined
"""


def url_filters(rules: tuple[tuple[str, str], ...]) -> str:
    """One pattern per term for the vocabulary, a join for the rules."""
    rows = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in rules)
    hits = "len(list_filter({}, lambda t: regexp_matches(low, '(^|[^0-9a-z])' || t || '([^0-9a-z]|$)')))"
    return rf"""
WITH p AS (SELECT page_id, {lower("url")} AS low, {lower("regexp_extract(url, '://([^/?#]*)', 1)")} AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS host, substr(rule, strpos(rule, '/')) AS start FROM (VALUES {rows}) v(verdict, rule)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {hits.format(_list(STRICT_TERMS))} > 0
  OR {hits.format(_list(SOFT_TERMS))} >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""


def decontamination(window: int) -> str:
    """A join of all windows of the items with all windows of the documents."""
    words = rf"regexp_extract_all({lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, w, least({window}, len(w)) AS size FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, size, list_slice(w, i, i + size - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
dw AS (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS g FROM (
  SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b))),
hits AS (SELECT doc_id, item, i, size FROM dw JOIN bw USING (size, g)),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits GROUP BY doc_id),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN places USING (doc_id)
"""


def near_duplicates(shingle: int, similar: int) -> str:
    """All pairs that share a shingle, and what can be reached over the links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {shingle - 1}) AS g FROM (
  SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {shingle - 1}) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {similar} * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id),
found AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN n USING (doc_id)
"""


def vector_codes(entries: int, parts: int, rounds: int, scale: int) -> str:
    """Every part against every entry, a pair of subqueries per round."""
    sql = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, q // (len(v) // {parts}) AS part, q % (len(v) // {parts}) AS place, v[q + 1] AS x FROM (SELECT r, v, unnest(range(len(v))) AS q FROM kept)),
e0 AS (SELECT part, r - 1 AS entry, place, x AS e FROM p WHERE r <= {entries})"""
    far = "SELECT r, part, entry, sum((x - e) * (x - e))::BIGINT AS far FROM p JOIN e{0} USING (part, place) GROUP BY r, part, entry"
    for k in range(rounds + 1):
        sql += f""",
a{k} AS (SELECT r, part, min(far * {entries} + entry) % {entries} AS entry, min(far) AS far FROM ({far.format(k)}) GROUP BY r, part)"""
        if k < rounds:
            sql += f""",
e{k + 1} AS (SELECT part, entry, place, coalesce(m, e) AS e FROM e{k}
  LEFT JOIN (SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM p JOIN a{k} USING (r, part) GROUP BY part, entry, place) USING (part, entry, place))"""
    return (
        sql
        + f""",
coded AS (SELECT vec_id, label, code, error FROM kept JOIN (
  SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY r) USING (r))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY part, entry, place)) FROM e{rounds}) AS codebooks_sha256 FROM coded
"""
    )


def nearest_neighbours(nearest: int, every: int) -> str:
    """All rows by inner product, summed in the order of the components; what an exact search gives."""
    return f"""
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i]::DOUBLE * c.e[i]::DOUBLE), lambda s, x: s + x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= {nearest}
"""


def fill_in_middle(rules: MiddleRules) -> str:
    """Lists of lines, cut and put together again."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS l, sha256('{rules.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {rules.rate} THEN 'plain'
    WHEN h4 % 100 < {rules.spm} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
