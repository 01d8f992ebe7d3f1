"""Column classification: every kind of rule and default, regular expressions against Python, and large tables of rules."""

import itertools
import json
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from turnwise.functions.patterns import compiled, required_literals
from turnwise.operators import classify
from turnwise.operators.classify import (
    CLASS_DEFAULTS,
    MARKDOWN_NAMES,
    MARKDOWN_SUFFIXES,
    RULE_SCHEMA,
    TIMESTAMP_NAMES,
    TIMESTAMP_SUFFIXES,
    Rule,
    classify_columns,
    matching_rules,
    rule_problems,
    rules_table,
)

NAMED = "column_name string, inferred_type string"


def config(kind, **params):
    return json.dumps({"type": kind, **params})


def columns(spark, names, kind="text"):
    return spark.createDataFrame([(name, kind) for name in names], NAMED)


def classes(catalog, rules=()):
    return {(r.column_name, r.inferred_type): (r["class"], json.loads(r.params)) for r in classify_columns(catalog, rules).collect()}


def test_defaults_of_every_name_and_type(spark):
    """Each known name, and each suffix behind a stem, in both cases and in near misses, with every inferred type."""
    names = {}
    for kind, whole, suffixes in (("timestamp", TIMESTAMP_NAMES, TIMESTAMP_SUFFIXES), ("markdown", MARKDOWN_NAMES, MARKDOWN_SUFFIXES)):
        known = [*whole, *(f"oak{s}" for s in suffixes), *suffixes]
        names |= {n: kind for n in [*known, *map(str.upper, known)]}
        names |= {near: "text" for n in known for near in (n + "s", n + "_") if not near.lower().endswith(TIMESTAMP_SUFFIXES + MARKDOWN_SUFFIXES)}
    types = ("text", "json", "timestamp", "integer", "float", "boolean", "binary", "unknown")
    rows = [(name, kind) for name in names for kind in types]
    found = classes(spark.createDataFrame(rows, NAMED))
    for (name, kind), (chosen, params) in found.items():
        wanted = kind if kind in ("json", "timestamp") else names[name] if kind == "text" else "text"
        assert (chosen, params) == (wanted, CLASS_DEFAULTS[wanted]), (name, kind)
    assert len(found) == len(rows)


def asks(kind, pattern, name):
    if kind == "regex":
        try:
            return bool(re.fullmatch(pattern, name))
        except re.error:
            return False
    return {"exact": name == pattern, "prefix": name.startswith(pattern), "suffix": name.endswith(pattern)}.get(kind, False)


WORDS = ["", "a", "ab", "elm", "elm_oak", "oak_elm", "oak", "oakoak", "ELM", "él_m", "elm\n", "x" * 60 + "elm"]


@pytest.mark.parametrize("as_table", [False, True])
def test_every_kind_of_rule_against_python(spark, as_table):
    patterns = [*WORDS, "[", "*", "elm.*", ".*elm", ".*_oak", "(elm|oak)+", "(?:oak_)?elm", "el[a-z]+", "(?i)elm.*", "(?i:el)m", "x{60}elm", "(?=elm)elm_.*", "elm|ash|.b", "(o)ak\\1?.*", r"oak\Z"]
    rules = [Rule(i, p, k, config("tag"), i % 5, i % 7 > 0) for i, (k, p) in enumerate(itertools.product(("exact", "prefix", "suffix", "regex", "glob"), patterns))]
    wanted = sorted((n, r.id, r.match_type, r.priority) for n in WORDS for r in rules if r.enabled and asks(r.match_type, r.match_pattern, n))
    found = matching_rules(columns(spark, WORDS), rules_table(spark, rules) if as_table else rules)
    assert sorted((r.column_name, r.rule_id, r.match_type, r.priority) for r in found.collect()) == wanted


@pytest.mark.parametrize("as_table", [False, True])
def test_highest_priority_then_lowest_id_of_usable_rules_decides(spark, as_table):
    rng = random.Random(6)
    usable = [config(k) for k in CLASS_DEFAULTS] + [config("code", language="c"), config("timestamp", format="YY"), config("json", collapsed=False)]
    broken = ["{", "[]", config("bar"), config("code", language=1)]
    rules = [
        Rule(i, rng.choice(["elm", "oak", "el", "ak", "e.*", ".*k", "["]), rng.choice(["exact", "prefix", "suffix", "regex"]), rng.choice(usable + broken), rng.randint(0, 3), rng.random() < 0.8)
        for i in rng.sample(range(1000), 60)
    ]
    for name in ("elm", "oak", "ash"):
        hits = [r for r in rules if r.enabled and r.render_config in usable and asks(r.match_type, r.match_pattern, name)]
        given = json.loads(min(hits, key=lambda r: (-r.priority, r.id)).render_config) if hits else {"type": "text"}
        kind = given.pop("type")
        assert classes(columns(spark, [name]), rules_table(spark, rules) if as_table else rules) == {(name, "text"): (kind, CLASS_DEFAULTS[kind] | given)}


def test_problems_of_a_rules_table(spark):
    rows = [
        (1, "p", "prefix", "{not-json", 0, True), (2, "[", "regex", '{"type":"markdown"}', 0, True),
        (3, "p", "exact", '["x"]', 0, True), (4, "p", "exact", '{"type":"chart"}', 0, True),
        (5, "p", "exact", '{"type":"json","collapsed":"no"}', 0, True), (6, "[", "prefix", '{"type":"tag"}', 0, True),
        (7, "[", "regex", "{not-json", 0, False), (8, "p", "exact", '{"kind":"text"}', 0, True),
        (9, "x+", "regex", '{"type":"code","language":"sql","extra":1}', 9, True),
    ]
    rules = spark.createDataFrame(rows, RULE_SCHEMA)
    found = {r.rule_id: r.reason for r in rule_problems(rules).collect()}
    assert found == {
        1: "contains invalid JSON", 2: "invalid regex: unterminated character set at position 0",
        3: "render_config must be an object", 4: "render_config failed validation",
        5: "render_config failed validation", 8: "render_config failed validation",
    }


def test_repeated_and_missing_names_stay_rows(spark):
    df = spark.createDataFrame([("a", "text"), ("a", "text"), (None, "json"), (None, "json"), ("", "text"), ("a", "json")], NAMED)
    rules = [Rule(1, "", "prefix", config("tag")), Rule(2, "a?", "regex", config("code"))]
    found = classify_columns(df, rules[:1]).collect()
    assert sorted((r.column_name is None, r.column_name or "", r["class"]) for r in found) == [(False, "", "tag"), *[(False, "a", "tag")] * 3, *[(True, "", "json")] * 2]
    assert sorted((r.column_name, r.rule_id) for r in matching_rules(df, rules).collect()) == [("", 1), ("", 2), *[("a", 1)] * 3, *[("a", 2)] * 3]
    assert classify_columns(df.limit(0), rules).count() == 0 and matching_rules(df.limit(0), rules_table(spark, rules)).count() == 0


def random_pattern(rng, depth=2):
    """An expression over few letters, of every construct that may or may not need its letters."""
    if depth == 0:
        return "".join(rng.choices("abc_", k=rng.randint(1, 5)))
    inner = lambda: random_pattern(rng, depth - 1)
    made = [
        lambda: inner() + inner(), lambda: f"(?:{inner()}|{inner()})", lambda: f"({inner()})?", lambda: f"(?:{inner()})*", lambda: f"(?:{inner()})+", lambda: f"(?:{inner()}){{2}}",
        lambda: f"(?i:{inner()})", lambda: f"[abc]+{inner()}", lambda: f".*{inner()}", lambda: f"(?={inner()}){inner()}", lambda: f"(?!{inner()}).*", lambda: f"^{inner()}$", lambda: f"(?>{inner()})",
        lambda: f"({inner()})\\1" if depth == 1 else inner(), lambda: f"(?P<n{rng.randrange(10**6)}>{inner()})",
    ]
    return rng.choice(made)()


def valid_patterns(rng, count):
    """Such expressions, without those whose reference names a group that is not there yet."""
    made = (random_pattern(rng) for _ in itertools.count())
    return list(itertools.islice(filter(compiled, made), count))


def test_needed_literals_are_in_every_match():
    rng = random.Random(12)
    names = ["".join(rng.choices("abcAB_", k=rng.randint(0, 9))) for _ in range(3000)]
    with_literals = 0
    for pattern in valid_patterns(rng, 1500):
        needed = required_literals(pattern)
        assert needed is not None and all(len(text) >= 3 for text in needed)
        with_literals += bool(needed)
        if needed:
            full = re.compile(pattern).fullmatch
            assert all(any(text in name for text in needed) for name in names if full(name)), pattern
    assert with_literals > 300
    assert required_literals("[") is None and required_literals("(?i)abcd") == [] and required_literals("ab|cdef") == []
    assert required_literals("x.*abcd.*abcde") == ["abcde"] and required_literals("(?:abc|bcde)_") == ["abc", "bcde"]


def test_random_expressions_match_as_in_python(spark):
    rng = random.Random(13)
    rules = [Rule(i, pattern, "regex", config("tag")) for i, pattern in enumerate(valid_patterns(rng, 200))]
    names = sorted({"".join(rng.choices("abcAB_", k=rng.randint(0, 9))) for _ in range(400)})
    wanted = sorted((n, r.id) for r in rules for n in names if re.fullmatch(r.match_pattern, n))
    found = matching_rules(columns(spark, names), rules_table(spark, rules)).collect()
    assert sorted((r.column_name, r.rule_id) for r in found) == wanted and len(wanted) > 300


def test_fifty_thousand_expressions_over_a_hundred_thousand_names(spark):
    """The literal index leaves Python few pairs to look at; checked in whole for names and expressions drawn at random."""
    n = F.col("id")
    code = lambda x: F.concat(*[F.substring(F.lit(string.ascii_lowercase), (F.floor(x / 26**k) % 26 + 1).cast("int"), F.lit(1)) for k in range(4)])
    pattern = F.when(n % 3 == 0, F.concat(F.lit("tool_"), code(n * 7), F.lit("_[0-9]+"))).when(n % 3 == 1, F.concat(F.lit("(in|out)_"), code(n * 7), F.lit(".*")))
    pattern = pattern.otherwise(F.concat(F.lit(".*_"), code(n * 7), F.lit("|"), code(n * 7 + 3), F.lit("_9")))
    rules = spark.range(50_000).select(
        n.cast("int").alias("id"), pattern.alias("match_pattern"), F.lit("regex").alias("match_type"), F.lit(config("tag")).alias("render_config"),
        F.lit(0).alias("priority"), F.lit(True).alias("enabled"),
    )
    name = F.concat(F.element_at(F.array(*map(F.lit, ("tool_", "in_", "out_", "x_"))), (n % 4 + 1).cast("int")), code(n * 11), F.when(n % 5 > 0, F.concat(F.lit("_"), (n % 13).cast("string"))).otherwise(""))
    names = spark.range(100_000).select(name.alias("column_name"), F.lit("text").alias("inferred_type"))
    asked, kinds = classify._prepared(names, rules)
    distinct = names.distinct().count()
    pairs = classify._keyed(names, kinds).join(asked, classify._KEY)
    assert pairs.count() < 40 * distinct
    found = {(r.column_name, r.rule_id) for r in matching_rules(names, rules).collect()}
    rng = random.Random(1)
    patterns = [(r.id, re.compile(r.match_pattern).fullmatch) for r in rules.collect()]
    all_names = sorted({r.column_name for r in names.collect()})
    for some_patterns, some_names in ((rng.sample(patterns, 60), all_names), (patterns, rng.sample(all_names, 60))):
        wanted = {(x, i) for i, full in some_patterns for x in some_names if full(x)}
        ids, known = {i for i, _ in some_patterns}, set(some_names)
        assert {(x, i) for x, i in found if i in ids and x in known} == wanted
    assert len(found) > 1000


def test_matching_runs_no_job_before_it_is_asked(spark):
    counter = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan only", "")
    try:
        rules = spark.range(10).select(F.col("id").cast("int").alias("id"), F.lit("a.*").alias("match_pattern"), F.lit("regex").alias("match_type"), F.lit(config("tag")).alias("render_config"), F.lit(0).alias("priority"), F.lit(True).alias("enabled"))
        found = classify_columns(spark.range(5).select(F.lit("ab").alias("column_name"), F.lit("text").alias("inferred_type")), rules)
        assert not counter.getJobIdsForGroup("plan only")
        assert {r["class"] for r in found.collect()} == {"tag"}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
