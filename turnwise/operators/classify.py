"""Column classification: prioritised name rules over a column catalog, then defaults.

A catalog is a table of columns (``column_name``, ``inferred_type`` and whatever else), rules are
another table. All rules meet the names in one equi-join on (kind, text), where a name brings itself,
its prefixes, its suffixes and its pieces of three letters.

Regular expressions have Python's meaning (full match). Of each, the literals that a match must hold
are known; it is joined by the one piece of these that the fewest expressions share, so only names
with that piece meet it. Names that hold the whole literal are then matched in Python. Expressions
without such a literal meet every name, dealt over ``SALTS`` keys.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnwise.functions.jsons import canonical_text, parse_strict
from turnwise.functions.patterns import GRAM, compiled, grams, required_literals

# Classes with the parameters they take when none are given.
CLASS_DEFAULTS = {
    "text": {},
    "markdown": {},
    "json": {"collapsed": True},
    "code": {"language": "plain"},
    "timestamp": {"format": "YYYY-MM-DD HH:mm:ss"},
    "tag": {},
}
# Column names that look like timestamps or markdown.
TIMESTAMP_NAMES = ("timestamp", "time", "date", "datetime")
TIMESTAMP_SUFFIXES = ("_at", "_time", "_timestamp", "_date", "_datetime")
MARKDOWN_NAMES = ("content", "markdown", "md")
MARKDOWN_SUFFIXES = ("_content", "_markdown", "_md")

# Keys over which names are dealt that meet expressions without a literal.
SALTS = 64
# Expressions that a Python worker keeps compiled.
_COMPILED = 4096
_KEY, _NEEDLE, _NEEDLES, _COPIES, _CONFIG = "__tw_key", "__tw_needle", "__tw_needles", "__tw_copies", "__tw_config"
_KINDS = ("exact", "prefix", "suffix", "piece", "any")

RULE_SCHEMA = (
    "id int, match_pattern string, match_type string, render_config string, priority int, "
    "enabled boolean"
)
WARNING_CODE = "RENDER_RULE_INVALID"


@dataclass(frozen=True)
class Rule:
    id: int
    match_pattern: str
    match_type: str
    render_config: str
    priority: int = 0
    enabled: bool = True


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules as a table."""
    schema = T._parse_datatype_string(RULE_SCHEMA)
    rows = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(astuple(r), schema, strict=True)]) for r in rules]
    values = F.array(*rows).cast(T.ArrayType(schema))
    return spark.range(0, 1, 1, 1).select(F.inline(values))


def _config_problem(config: Column) -> Column:
    """Why a class configuration is unusable, or NULL."""
    value = parse_strict(config)
    kind = F.schema_of_variant(F.try_variant_get(value, "$.type", "variant"))
    name = F.try_variant_get(value, "$.type", "string")

    def wrong(path: str, wanted: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        return found.isNotNull() & (found != wanted)

    valid = (
        (kind == "STRING")
        & name.isin(*CLASS_DEFAULTS)
        & ~((name == "json") & wrong("$.collapsed", "BOOLEAN"))
        & ~((name == "code") & wrong("$.language", "STRING"))
        & ~((name == "timestamp") & wrong("$.format", "STRING"))
    )
    return (
        F.when(value.isNull(), "contains invalid JSON")
        .when(~F.schema_of_variant(value).startswith("OBJECT"), "render_config must be an object")
        .when(~F.coalesce(valid, F.lit(False)), "render_config failed validation")
    )


def rule_problems(rules: DataFrame) -> DataFrame:
    """One warning per enabled rule that cannot be used, with the reason."""

    # Uses nothing of this package, so that workers need not have it installed.
    @F.pandas_udf("string")
    def regex_problem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        def reason(pattern: str) -> str | None:
            try:
                re.compile(pattern)
            except re.error as error:
                return f"invalid regex: {error}"
            return None

        for patterns in batches:
            reasons = {p: reason(p) for p in patterns.dropna().unique()}
            yield patterns.map(reasons).astype(object)

    is_regex = F.col("match_type") == "regex"
    checked = rules.where("enabled").withColumn(
        "pattern_problem", regex_problem(F.when(is_regex, F.col("match_pattern")))
    )
    reason = F.coalesce(F.col("pattern_problem"), _config_problem(F.col("render_config")))
    return checked.select(
        F.lit(WARNING_CODE).alias("code"), F.col("id").alias("rule_id"), reason.alias("reason")
    ).where("reason is not null")


def _full_match():
    """Whether names match expressions whole, a column of each; without an expression, yes."""

    @F.pandas_udf("boolean")
    def matches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from functools import lru_cache

        known = lru_cache(_COMPILED)(compiled)
        for names, patterns in batches:
            yield pd.Series([p is None or bool((e := known(p)) and e.fullmatch(n)) for n, p in zip(names, patterns, strict=True)])

    return matches


def _literals():
    """The literals that expressions need; null where Python refuses the expression."""

    @F.pandas_udf("array<string>")
    def needed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for patterns in batches:
            yield patterns.map(required_literals).astype(object)

    return needed


def _key(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def _keys(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda text: _key(kind, text))


def _salts() -> Column:
    return _keys("any", F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda salt: salt.cast("string")))


def _asked(rules: DataFrame) -> DataFrame:
    """Enabled rules with what they ask of a name (``_KEY``), and of expressions the literals of which one must be in it, a row for each."""
    enabled = rules.where("enabled AND match_pattern IS NOT NULL")
    none = [F.lit(None).cast("string").alias(_NEEDLE), F.lit(None).cast("array<string>").alias(_NEEDLES)]
    plain = enabled.where(F.col("match_type").isin("exact", "prefix", "suffix"))
    plain = plain.select("*", F.struct(F.col("match_type").alias("kind"), F.col("match_pattern").alias("text")).alias(_KEY), *none)
    needed = enabled.where("match_type = 'regex'").withColumn(_NEEDLES, _literals()(F.col("match_pattern"))).where(F.col(_NEEDLES).isNotNull())
    columns = [*rules.columns, _KEY, _NEEDLE, _NEEDLES]

    anywhere = needed.where(F.size(_NEEDLES) == 0).select(*rules.columns, F.explode(_salts()).alias(_KEY), *none)

    needles = needed.select("*", F.explode(_NEEDLES).alias(_NEEDLE))
    pieces = needles.select("*", F.explode(_pieces(F.col(_NEEDLE))).alias("__tw_piece"))
    shared = pieces.withColumn("__tw_shared", F.count("*").over(Window.partitionBy("__tw_piece")))
    rarest = F.min(F.struct("__tw_shared", "__tw_piece"))["__tw_piece"]
    # Equal rules are one group and come out as often as they went in.
    often = F.count_if(F.col("__tw_piece") == F.substring(_NEEDLE, 1, GRAM))
    indexed = shared.groupBy(*rules.columns, _NEEDLE, _NEEDLES).agg(rarest.alias("__tw_piece"), often.alias(_COPIES))
    indexed = _copies(indexed).withColumn(_KEY, _key("piece", F.col("__tw_piece")))
    return reduce(DataFrame.unionByName, [t.select(columns) for t in (plain, anywhere, indexed)])


def _asked_of_list(spark: SparkSession, rules: Sequence[Rule]) -> tuple[DataFrame, set[str]]:
    """The same for rules in Python, without a job, and the kinds of things that are asked."""
    enabled = [rule for rule in rules if rule.enabled and rule.match_pattern is not None]
    needed = [(rule, required_literals(rule.match_pattern) if rule.match_type == "regex" else None) for rule in enabled]
    shared = Counter(piece for _, needles in needed for needle in needles or () for piece in grams(needle))
    rows = []
    for rule, needles in needed:
        if rule.match_type in ("exact", "prefix", "suffix"):
            rows.append((rule, rule.match_type, rule.match_pattern, None, None))
        elif needles:
            rows += [(rule, "piece", min(grams(needle), key=lambda piece: (shared[piece], piece)), needle, needles) for needle in needles]
        elif needles is not None:
            rows.append((rule, "any", None, None, None))
    schema = T._parse_datatype_string(f"{RULE_SCHEMA}, {_KEY} struct<kind: string, text: string>, {_NEEDLE} string, {_NEEDLES} array<string>")
    values = [
        F.struct(
            *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(astuple(rule), schema.fields, strict=False)],
            _key(kind, F.lit(text).cast("string")).alias(_KEY),
            F.lit(needle).cast("string").alias(_NEEDLE),
            (F.array(*map(F.lit, needles)) if needles else F.lit(None)).cast("array<string>").alias(_NEEDLES),
        )
        for rule, kind, text, needle, needles in rows
    ]
    table, kinds = spark.range(0, 1, 1, 1).select(F.inline(F.array(*values).cast(T.ArrayType(schema)))), {row[1] for row in rows}
    if "any" in kinds:
        table = table.withColumn(_KEY, F.explode(F.when(F.col(_KEY)["kind"] == "any", _salts()).otherwise(F.array(_KEY))))
    return table, kinds


def _pieces(text: Column) -> Column:
    """The different pieces of ``GRAM`` letters of a text."""
    places = F.when(F.char_length(text) >= GRAM, F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1)))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda k: F.substring(text, k, F.lit(GRAM))))


def _keyed(catalog: DataFrame, kinds: set[str]) -> DataFrame:
    """One row per column and thing a rule could ask of its name: (kind, text); equal columns are one row with their number.

    Without a name, or if nothing can be asked of it, a column has one row without a key.
    """
    name = F.col("column_name")
    lengths = F.sequence(F.lit(0), F.char_length(name))
    texts = {
        "exact": F.array(name),
        "prefix": F.transform(lengths, lambda n: F.substring(name, F.lit(1), n)),
        "suffix": F.transform(lengths, lambda n: F.substring(name, F.char_length(name) - n + 1, n)),
        "piece": _pieces(name),
        "any": F.array(F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("string")),
    }
    none = F.array().cast("array<struct<kind: string, text: string>>")
    every = F.concat(none, *[_keys(kind, texts[kind]) for kind in _KINDS if kind in kinds])
    distinct = catalog.groupBy(*[F.col(f"`{c}`") for c in catalog.columns]).agg(F.count("*").alias(_COPIES))
    return distinct.select("*", F.explode_outer(F.when(name.isNotNull(), every)).alias(_KEY))


def _copies(found: DataFrame) -> DataFrame:
    """As many rows as there were equal columns."""
    return found.withColumn(_COPIES, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(_COPIES)))).drop(_COPIES)


def _hits(catalog: DataFrame, asked: DataFrame, kinds: set[str]) -> DataFrame:
    """Columns and the rules that match them. Python sees only the pairs of an expression and a name that holds its literal."""
    pairs = _keyed(catalog, kinds).join(asked, _KEY)
    if not kinds & {"piece", "any"}:
        return pairs
    name = F.col("column_name")
    # A name that holds several of an expression's literals meets it by the first of them.
    first = F.get(F.filter(_NEEDLES, lambda needle: F.contains(name, needle)), F.lit(0))
    pairs = pairs.where(F.col(_NEEDLE).isNull() | F.coalesce(first == F.col(_NEEDLE), F.lit(False)))
    return pairs.where(_full_match()(name, F.when(F.col("match_type") == "regex", F.col("match_pattern"))))


def _prepared(catalog: DataFrame, rules: DataFrame | Sequence[Rule]) -> tuple[DataFrame, set[str]]:
    if isinstance(rules, DataFrame):
        return _asked(rules.select(*[F.col(f"`{f}`") for f in ("id", "match_pattern", "match_type", "render_config", "priority", "enabled")])), set(_KINDS)
    return _asked_of_list(catalog.sparkSession, rules)


def matching_rules(catalog: DataFrame, rules: DataFrame | Sequence[Rule]) -> DataFrame:
    """One row per column and enabled rule that matches its name. Rules of which an id repeats count each."""
    asked, kinds = _prepared(catalog, rules)
    asked = asked.withColumnRenamed("id", "rule_id")
    found = _copies(_hits(catalog, asked, kinds))
    return found.select(*catalog.columns, "rule_id", "match_type", "priority")


def default_class(name: Column, kind: Column) -> Column:
    """Class of a column that no rule decides."""
    lower = F.lower(name)

    def looks_like(names: Sequence[str], suffixes: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [lower.endswith(s) for s in suffixes], lower.isin(*names))

    return (
        F.when(kind == "json", "json")
        .when(kind == "timestamp", "timestamp")
        .when((kind == "text") & looks_like(TIMESTAMP_NAMES, TIMESTAMP_SUFFIXES), "timestamp")
        .when((kind == "text") & looks_like(MARKDOWN_NAMES, MARKDOWN_SUFFIXES), "markdown")
        .otherwise("text")
    )


def _default(name: Column, kind: Column) -> Column:
    """Class and parameters of a column that no rule decides."""
    params = F.create_map(*[F.lit(x) for c, p in CLASS_DEFAULTS.items() for x in (c, _text(p))])
    return F.transform(
        F.array(default_class(name, kind)),
        lambda c: F.struct(c.alias("class"), F.element_at(params, c).alias("params")),
    )[0]


def classify_columns(catalog: DataFrame, rules: DataFrame | Sequence[Rule] = ()) -> DataFrame:
    """Add ``class`` and ``params`` (JSON text) to every column of a catalog.

    The first usable rule by priority, then id, decides; otherwise the default does. Rules are a table of any size, and no job runs before
    the result is asked for. The decision depends on a column's name alone, so names are decided and joined to the catalog.
    """
    asked, kinds = _prepared(catalog, rules)
    name, kind = F.col("column_name"), F.col("inferred_type")
    columns = [F.col(f"`{c}`") for c in catalog.columns]
    usable = asked.where(_config_problem(F.col("render_config")).isNull())
    keyed = _hits(catalog.select("column_name"), usable, kinds).where("column_name IS NOT NULL")
    order = F.struct((-F.col("priority")).alias("p"), F.col("id").alias("i"), F.col("render_config").alias("c"))
    picked = keyed.groupBy("column_name").agg(F.min(order)["c"].alias(_CONFIG))
    decided = picked.select(F.col("column_name").alias(_KEY), _rule_class(F.col(_CONFIG)).alias(_CONFIG))
    found = catalog.join(decided, name == F.col(_KEY), "left") if kinds else catalog.withColumn(_CONFIG, F.lit(None).cast("struct<class: string, params: string>"))
    pick = F.coalesce(F.col(_CONFIG), _default(name, kind))
    return found.withColumn(_CONFIG, pick).select(*columns, F.col(f"{_CONFIG}.class").alias("class"), F.col(f"{_CONFIG}.params").alias("params"))


def _text(params: dict) -> str:
    return json.dumps(params, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _rule_class(config: Column) -> Column:
    """Class and parameters a usable configuration sets, with the defaults it leaves out."""
    value = parse_strict(config)
    name = F.try_variant_get(value, "$.type", "string")
    given = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: k != "type")
    defaults = F.create_map(
        *[x for c, p in CLASS_DEFAULTS.items() for x in (F.lit(c), F.from_json(F.lit(_text(p)), "map<string,string>"))]
    )
    own = F.transform_values(F.element_at(defaults, name), lambda k, v: F.coalesce(F.try_parse_json(v), v.cast("variant")))
    missing = F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k))
    params = canonical_text(F.to_variant_object(F.map_concat(given, missing)))
    return F.struct(name.alias("class"), params.alias("params"))
