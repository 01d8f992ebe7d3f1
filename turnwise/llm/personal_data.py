"""Personal data by candidate spans and gradient-boosted trees; expressions of Spark SQL only.

High-recall generators propose spans: the four base kinds (email, ip, card, phone), which stay whatever the trees say, and wider kinds that
may overlap them (written-out addresses, IPv6, numbers with labels or separators). Boosted trees score the wider candidates from their format
and the characters around them; candidates above a threshold, calibrated for precision on held-out rows, are added as spans.

The trees are trained with Spark's own GBTClassifier on labelled candidates from a bounded generated sample (``training_rows``), and applied
as SQL expressions over an array, so the main path is one scan without shuffle or Python.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import once

#: Fixed patterns of the base kinds, written without backtracking over long runs: a match can only begin where a run of its
#: first character class does, or where the last match ended (\G), and nothing after a possessive part could use what it took.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched for the kind.
NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_POINT = r"(?:\.|\x20?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\x20dot\x20)\x20?)"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})"
_NOT_IN_NUMBER = r"(?<![0-9A-Za-z.,+-])"
_END = r"(?![0-9A-Za-z-])"
#: The wider generators: a kind, what a text must hold to be searched, and the pattern. Matches of one pattern do not overlap, those of
#: several may, so what one proposes in vain hides nothing from another.
WIDE = (
    ("email", r"(?i)[(\[]at[)\]]", r"(?i)[A-Za-z0-9][A-Za-z0-9._-]{0,63}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\.|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}){1,4}"),
    ("email", r"(?i)\x20at\x20", r"(?i)[A-Za-z0-9][A-Za-z0-9._-]{0,63}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\.|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}){1,4}"),
    ("ip", r"(?i)[0-9]\x20?(?:[\[({]\.|[\[(\x20]dot)", rf"(?i)(?<![0-9A-Za-z.:]){_OCTET}(?:{_POINT}{_OCTET}){{3}}(?![0-9A-Za-z])"),
    ("ip", r"(?i)::|[0-9a-f]:[0-9a-f]{1,4}:", rf"(?i)(?<![0-9A-Za-z.:])(?=[0-9a-f]{{0,4}}(?::[0-9a-f]{{0,4}}){{2,8}}(?![0-9A-Za-z:]))(?:{_GROUPS}{{7}}|{_GROUPS}{{0,6}}::(?:{_GROUPS}{{0,6}})?|::{_GROUPS}{{0,6}})(?![0-9A-Za-z:])"),
    ("phone", r"[0-9][\x20.)-]", rf"{_NOT_IN_NUMBER}(?:\([0-9]{{2,5}}\)[\x20-]?|[0-9]{{2,5}}[\x20.-])[0-9]{{2,4}}(?:[\x20.-][0-9]{{2,4}}){{1,3}}{_END}"),
    ("phone", r"[01][\x20.-]\(?[0-9]{3}", rf"{_NOT_IN_NUMBER}[01][\x20.-](?:\([0-9]{{3}}\)[\x20.-]?|[0-9]{{3}}[\x20.-])[0-9]{{3}}[\x20.-][0-9]{{4}}{_END}"),
    ("phone", r"[0-9]\)?[\x20/-][0-9]{4}", rf"{_NOT_IN_NUMBER}(?:\([0-9]{{2,5}}\)\x20?|[0-9]{{3,5}}[\x20/-])[0-9]{{4,9}}{_END}"),
    ("card", r"[0-9]{4}[./_][0-9]{4}", r"(?<![0-9A-Za-z.,-])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9A-Za-z])"),
)
KINDS = ("email", "ip", "card", "phone")
#: Code points of context on either side.
CONTEXT = 40
#: Words that go before personal data, and words and signs that go with other numbers. Lower case, found anywhere in the context.
CUES = {
    "email": r"mail|contact|write to|reach",
    "ip": r"\bipv?[46]?\b|address|host|server|ping|dns|gateway|client|logged in|connect",
    "phone": r"phone|\btel\b|\bcall|mobile|\bcell|\bfax|\bdial|\bring\b|\bsms|whatsapp|(?:my|our|the) number|hotline",
    "card": r"card|visa|mastercard|amex|credit|debit|payment|paid",
    "other": r"isbn|issn|version|release|build|date|page|chapter|figure|table|room|year|total|price|score|order|invoice|[$€£%=/:]",
}
#: Words that stand before or after a plain "at" in prose, and are no name and no host.
STOP_WORDS = (
    "a all an any arrive arrived arrives be begin begins both came come dawn dusk each end ends every first five four gather gathered held her "
    "here his home it its last least look looked looking looks meet meeting meets met midnight most my night noon nothing now once one open "
    "opens our play school see start started starts stay stop stopped ten that the their them there these they this those three times two us "
    "was were what which will work your"
).split()
#: Ends of common host names.
TOP_DOMAINS = r"\b(?:com|org|net|edu|gov|info|biz|io|co|dev|app|ai|me|eu|de|fr|uk|es|it|nl|ch|at|pl|se|ru|cn|jp|br|ca|au)"
FEATURES = ("kind_email", "kind_ip", "kind_phone", "kind_card", "n_digits", "n_chars", "n_groups", "parens", "dots", "dashes", "spaces", "brackets", "own_cue", "other_cue", "next_to_mark", "luhn", "colons", "dot_words", "top_domain", "octets", "stop_word", "ends_sentence", "trunk", "last_digits")
SPAN = "struct<kind:string,start:bigint,end:bigint>"


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    left: Leaf | Split
    right: Leaf | Split


@dataclass(frozen=True)
class Trees:
    """Weighted regression trees; a candidate's score is their weighted sum, above ``threshold`` it becomes a span."""

    trees: tuple[tuple[float, Leaf | Split], ...]
    threshold: float

    def score(self, features: Column) -> Column:
        def value(node: Leaf | Split) -> Column:
            if isinstance(node, Leaf):
                return F.lit(node.value)
            return F.when(features[FEATURES[node.feature]] <= node.threshold, value(node.left)).otherwise(value(node.right))

        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * value(root)
        return total


def _matches(text: Column, pattern: str, needed: str) -> Column:
    """array<struct<value, start, end>> of the leftmost matches that do not overlap, in code points.

    The pieces between the matches, as ``split`` gives them, have the lengths that lead from one match to the next.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda piece: F.char_length(piece).cast("long"))
    pairs = F.arrays_zip(found.alias("value"), F.slice(between, F.lit(1), F.size(found)).alias("gap"))
    empty = F.array().cast("array<struct<value:string,start:bigint,end:bigint>>")
    walk = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + F.char_length(m["value"])).alias("at"),
            F.array_append(
                acc["spans"],
                F.struct(m["value"].alias("value"), (acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + F.char_length(m["value"])).alias("end")),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(needed), walk).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit counts double, less 9 if that has two digits."""
    backwards = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(k: Column) -> Column:
        digit = F.substring(backwards, k, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(k % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _features(text: Column, span: Column, kind: str) -> Column:
    value = span["value"]
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(CONTEXT)).cast("int")))
    after = F.lower(F.substring(text, span["end"].cast("int") + 1, F.lit(CONTEXT)))
    around = F.concat(before, F.lit(" "), after)
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    flag = lambda condition: condition.cast("double")
    digits = _digits(value)
    named = {
        "kind_email": F.lit(float(kind == "email")),
        "kind_ip": F.lit(float(kind == "ip")),
        "kind_phone": F.lit(float(kind == "phone")),
        "kind_card": F.lit(float(kind == "card")),
        "n_digits": F.length(digits).cast("double"),
        "n_chars": F.char_length(value).cast("double"),
        "n_groups": count("[0-9]+"),
        "parens": count(r"\("),
        "dots": count(r"\."),
        "dashes": count("-"),
        "spaces": count(r"\x20"),
        "brackets": count(r"(?i)[(\[{](?:at|dot|\.)[)\]}]"),
        "own_cue": flag(before.rlike(CUES[kind])),
        "other_cue": flag(around.rlike(CUES["other"])),
        "next_to_mark": flag(before.rlike(r"[$€£#%=/:.,+*-]\x20?$") | after.rlike(r"^[%=/*]")),
        "luhn": flag(F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))),
        "colons": count(":"),
        "dot_words": count(r"(?i)\x20dot\x20"),
        "octets": flag(F.lit(kind == "ip") & ~value.contains(":")),
        "stop_word": flag(value.rlike(rf"(?i)^(?:{'|'.join(STOP_WORDS)})\x20at\x20|\x20at\x20(?:{'|'.join(STOP_WORDS)})(?![A-Za-z0-9-])")),
        "ends_sentence": flag(value.rlike(r"\.\x20")),
        "trunk": flag(value.rlike(r"^(?:[(]|0|1[\x20.-])")),
        "last_digits": F.length(F.regexp_extract(value, "[0-9]*$", 0)).cast("double") if kind == "phone" else F.lit(0.0),
        "top_domain": flag(value.rlike(rf"(?i)(?:{TOP_DOMAINS})$")),
    }
    return F.struct(*[named[name].alias(name) for name in FEATURES])


def _described(text: Column, kind: str):
    """From a match to a candidate with its features."""
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), _features(text, s, kind).alias("features"))


def candidates(text: Column) -> Column:
    """array<struct<kind, value, start, end, features>> of the wide generators."""
    return F.concat(*[F.transform(_matches(text, pattern, needed), _described(text, kind)) for kind, needed, pattern in WIDE])


def _span(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _is_valid(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the valid matches of the base patterns, by kind, then start."""
    return F.concat(*[F.transform(F.filter(_matches(text, BASE[kind], NEEDED[kind]), _is_valid(kind)), _span(kind)) for kind in KINDS])


# ---- training ----

#: Rows of the generated sample; four fifths train, one fifth sets the threshold.
TRAINING_ROWS = 3_000
PRECISION = 0.98


def training_rows(n: int = TRAINING_ROWS, seed: int = 7) -> list[tuple[int, str, int]]:
    """(row, text, label) with one candidate each: personal data in the ways people write it, and numbers that look like it."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))

    def luhn_card() -> str:
        body = [rng.randint(0, 9) for _ in range(15)]
        total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(body))
        return "".join(map(str, [*body, -total % 10]))

    def filler() -> str:
        return " ".join(letters() for _ in range(rng.randint(2, 8)))

    def positive() -> str:
        what = rng.randrange(9)
        if what == 6:
            s = rng.choice("-. ")
            return rng.choice(["phone ", "call ", "hotline ", "our number is ", "", ""]) + rng.choice([f"1{s}{digits(3)}{s}{digits(3)}{s}{digits(4)}", f"1{s}({digits(3)}) {digits(3)}-{digits(4)}"])
        if what == 7:
            return rng.choice(["tel ", "tel. ", "phone: ", "call ", "fax ", "my number is "]) + rng.choice([f"0{digits(2)} {digits(6)}", f"0{digits(3)}/{digits(6)}", f"(0{digits(2)}) {digits(7)}", f"0{digits(4)}-{digits(5)}", f"{digits(3)}-{digits(4)}"])
        if what == 4:
            at, dot = rng.choice([(" at ", " dot "), (" AT ", " DOT ")])
            name = letters() + rng.choice(["", "", f".{letters()}", f"_{letters()}", digits(2)])
            host = letters() + rng.choice(["", "", dot + letters()])
            if rng.random() < 0.15:
                dot = "."
            found = f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'edu', 'io', 'co'])}"
            return rng.choice(["mail ", "contact ", "write to ", "", "", ""]) + (found.upper() if rng.random() < 0.3 else found)
        if what in (5, 8):
            cue = rng.choice(["ip ", "host ", "server ", "from ", "", ""])
            if rng.random() < 0.6:
                dot = rng.choice(["[.]", "(.)", "[dot]", " dot ", " dot ", "{.}", " [.] "])
                most = rng.choice([9, 99, 255])
                parts = [str(rng.randint(0, most)) for _ in range(4)]
                return cue + (".".join(parts[:3]) + dot + parts[3] if "." in dot and rng.random() < 0.5 else dot.join(parts))
            group = lambda: f"{rng.randint(0, rng.choice([0, 0xF, 0xFFF, 0xFFFF, 0xFFFF])):x}"
            if rng.random() < 0.5:
                return cue + ":".join(rng.choice([group(), group().zfill(4)]) for _ in range(8))
            return cue + rng.choice(["2001:", "2a02:", "fe80:", "fd00:"]) + "".join(group() + ":" for _ in range(rng.randint(0, 3))) + ":" + ":".join(group() for _ in range(rng.randint(1, 5)))
        if what == 0:
            at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] ")])
            found = f"{letters()}{rng.choice(['', f'.{letters()}'])}{at}{letters()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"
            return rng.choice(["mail ", "contact ", "write to ", "", "", ""]) + (found.upper() if rng.random() < 0.2 else found)
        if what == 1:
            s = rng.choice("-. ")
            return rng.choice(["phone ", "tel. ", "call ", "call me at ", "fax ", "mobile: ", "my number is ", "reach us by phone: "]) + f"{digits(3)}{s}{digits(3)}{s}{digits(4)}"
        if what == 2:
            return rng.choice(["phone ", "tel: ", "call ", "", ""]) + f"({digits(3)}) {digits(3)}-{digits(4)}"
        card, s = luhn_card(), rng.choice("._/")
        return rng.choice(["card ", "visa ", "credit card: ", ""]) + s.join(card[k : k + 4] for k in range(0, 16, 4))

    def negative() -> str:
        what = rng.randrange(12)
        if what == 8:
            end = rng.choice(["At", "Es", "De", "It", "Me", "Fr", "Is", "The", "No", "com", letters().title()])
            return f"{letters()} at {letters()}. {end} {letters()}"
        if what == 9:
            stop = rng.choice(STOP_WORDS)
            return rng.choice([f"{stop} at {letters()}", f"{letters()} at {stop}", f"{stop} at {rng.choice(STOP_WORDS)}"]) + rng.choice([" dot ", " dot ", "."]) + rng.choice(["com", "org", "net", "de", "it", letters()])
        if what == 10:
            return rng.choice(["in ", "", "from ", "years ", "lines ", "pages "]) + rng.choice([f"{rng.randint(1800, 2030)}-{rng.randint(1800, 2030)}", f"{digits(4)} {digits(4)}", f"{digits(5)}-{digits(4)}", f"{digits(3)}/{digits(4)}", f"{digits(3)} {digits(5)}"])
        if what == 11:
            return rng.choice(["version ", "release ", "build ", "= "]) + f"1.{digits(3)}.{digits(3)}.{digits(4)}"
        if what == 6:
            return f"{letters()} at {rng.choice(['the', 'a', 'that', 'every', letters()])} dot {rng.choice(['on', 'of', 'and', 'near', 'above', 'product', letters()])}"
        if what == 7:
            word = lambda: rng.choice(["a", "b", "add", "be", "face", "dead", "fade", "ace", "1", "2", "10", "-1"])
            return rng.choice([f"{word()}::{word()}", f"x[::{rng.randint(1, 9)}]", f"[{rng.randint(0, 99)}::{rng.randint(1, 9)}]", f"::{word()}", f"{word()}::", f"{rng.randint(1, 23)}::{digits(2)}"])
        if what == 0:
            return f"{letters()} at {letters()}.{letters()}"
        if what == 1:
            return rng.choice(["date ", "", "on "]) + f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"
        if what == 2:
            return rng.choice(["isbn ", "ISBN: "]) + f"978-{digits(2)}-{digits(4)}-{digits(3)}"
        if what == 3:
            return rng.choice(["total ", "scores ", "version ", "", "page "]) + " ".join(digits(rng.randint(2, 4)) for _ in range(rng.randint(3, 5)))
        if what == 4:
            return rng.choice(["order ", "", "$", "ref "]) + f"{digits(2)}.{digits(3)}.{digits(3)}"
        s = rng.choice("._/")
        return rng.choice(["serial ", "key ", ""]) + s.join(digits(4) for _ in range(4))

    rows = []
    for k in range(n):
        label = k % 2
        rows.append((k, f"{filler()} {positive() if label else negative()} {filler()}.", label))
    return rows


def train(spark: SparkSession, n: int = TRAINING_ROWS, precision: float = PRECISION, seed: int = 7) -> Trees:
    """Fit the trees on the candidates of ``training_rows`` and set the threshold: the lowest score of the held-out fifth from which on
    the share of true candidates is at least ``precision``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame(training_rows(n, seed), "row long, text string, label int").coalesce(1)
    found = rows.select("row", "label", F.explode(candidates(F.col("text"))).alias("c")).select("row", F.col("label").cast("double").alias("label"), "c.features.*")
    found = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found).select("row", "label", *FEATURES, "features").cache()
    try:
        model = GBTClassifier(maxIter=20, maxDepth=3, maxBins=32, stepSize=0.4, seed=seed).fit(found.where("row % 5 <> 4").select("label", "features"))
        roots = [(float(w), _tree(t)) for w, t in zip(model.treeWeights, model._java_obj.trees(), strict=True)]
        trees = Trees(tuple(roots), 0.0)
        one = F.struct(*FEATURES)
        held = sorted(((r[0], r[1]) for r in found.where("row % 5 = 4").select(trees.score(one), "label").collect()), reverse=True)
    finally:
        found.unpersist()
    threshold, right = float("inf"), 0.0
    for k, (score, label) in enumerate(held, 1):
        right += label
        if right / k >= precision and (k == len(held) or held[k][0] < score):
            threshold = score
    return Trees(tuple(roots), threshold)


def _tree(tree) -> Leaf | Split:
    """A tree of the fitted model, as plain data."""

    def node(n) -> Leaf | Split:
        if n.getClass().getSimpleName() == "LeafNode":
            return Leaf(float(n.prediction()))
        return Split(int(n.split().featureIndex()), float(n.split().threshold()), node(n.leftChild()), node(n.rightChild()))

    return node(tree.rootNode())


# ---- the operator ----


def _overlaps(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))


def _holds(larger: Column, c: Column) -> Column:
    """Whether a span is larger than another of its kind and holds it."""
    return (larger["kind"] == c["kind"]) & (larger["start"] <= c["start"]) & (c["end"] <= larger["end"]) & (larger["end"] - larger["start"] > c["end"] - c["start"])


def find_spans(docs: DataFrame, trees: Trees, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the input's columns, or those in ``keep``), ``text``, ``base`` and ``spans``: arrays of (kind, start, end) in code points,
    end exclusive, by kind, then start.

    ``spans`` holds the base spans and the candidates that the trees accept, that overlap no base span and that lie in no larger accepted
    one of their kind. A null text is empty and
    has no spans. Rows are judged one by one, an empty table gives an empty result, columns of any name may come along.
    """
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    found = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = found.select("row", "text", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("wide"))
    accepted = F.filter("wide", lambda c: (trees.score(c["features"]) >= trees.threshold) & ~_overlaps(F.col("base"), c))
    alone = F.array_distinct(F.transform(accepted, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    found = once(found, added=alone)
    added = F.filter("added", lambda c: ~F.exists("added", lambda o: _holds(o, c)))
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return found.select("row", "text", "base", F.when(F.size(added) > 0, ordered).otherwise(F.col("base")).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones joined) replaced by its kind in brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        more = F.array_append(F.array_append(acc["out"], between), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"),
        )

    whole = F.aggregate(ordered, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"].cast("int") + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The input with its texts redacted; null texts stay null."""
    found = find_spans(docs, trees, text)
    clean = F.when(F.col(f"row.`{text}`").isNull(), F.lit(None)).otherwise(redacted(F.col("text"), F.col("spans")))
    return found.select(*[(clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c)) for c in docs.columns])
