"""Audit of logged SQL statements: which are plain reads, and what is wrong with the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions that block, lock or read files, and the locking clauses.
DANGEROUS_FUNCTIONS = (
    "BENCHMARK",
    "GET_LOCK",
    "LOAD_FILE",
    "MASTER_POS_WAIT",
    "RELEASE_ALL_LOCKS",
    "RELEASE_LOCK",
    "SLEEP",
    "SOURCE_POS_WAIT",
    "WAIT_FOR_EXECUTED_GTID_SET",
    "WAIT_UNTIL_SQL_THREAD_AFTER_GTIDS",
)
LOCKING_CLAUSES = ("FOR UPDATE", "FOR SHARE", "LOCK IN SHARE MODE")
# Statement types that are named in the verdict.
STATEMENT_TYPES = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "UPSERT", "REPLACE", "MERGE",
    "CREATE OR REPLACE", "CREATE", "ALTER", "DROP",
)

# Stands for a quoted text once its content has been blanked.
_QUOTED = "\x01"
_LINE = r"(?:--|# )[^\r\n]*"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+\*/"
_COMMENT = f"{_LINE}|{_BLOCK}"
# Possessive runs: no recursion per character, and one pass over a text of any length.
_SINGLE = r"'(?:[^'\\]++|''|\\.)*+"
_DOUBLE = r"\"(?:[^\"\\]++|\"\"|\\.)*+"
_BACKTICK = r"`(?:[^`]++|``)*+"
_TEXT = f"{_SINGLE}'|{_DOUBLE}\"|{_BACKTICK}`"


# Everything up to a quote or comment that is never closed.
_CLOSED = rf"(?s)\A(?:{_COMMENT}|{_TEXT}|[^'\"`/#-]++|/(?!\*)|[#-])*+"


def _has_marks(sql: Column) -> Column:
    return reduce(lambda a, b: a | b, [sql.contains(mark) for mark in ("'", '"', "`", "--", "# ", "/*")])


def _closed_part(sql: Column) -> Column:
    """The statement up to a quote or comment that is never closed; what follows counts as code."""
    clean = F.translate(sql, _QUOTED, " ")
    return F.when(_has_marks(sql), F.regexp_extract(clean, _CLOSED, 0)).otherwise(clean)


def _blank_texts(sql: Column) -> Column:
    """Quoted texts become a mark; comments stay and get a mark behind them."""
    blanked = F.regexp_replace(sql, f"(?s)({_COMMENT})|{_TEXT}", f"$1{_QUOTED}")
    return F.when(_has_marks(sql), blanked).otherwise(sql)


def _executable_comment(marked: Column) -> Column:
    comments = F.regexp_extract_all(marked, F.lit(f"({_COMMENT}){_QUOTED}"), F.lit(1))
    found = F.exists(comments, lambda c: c.startswith("/*!") | c.startswith("/*+"))
    return (marked.contains("/*!") | marked.contains("/*+")) & found


def _drop_comments(marked: Column) -> Column:
    dropped = F.regexp_replace(marked, f"(?:{_COMMENT}){_QUOTED}", " ")
    return F.when(marked.contains(_QUOTED), dropped).otherwise(marked)


def _dangerous(code: Column) -> Column:
    """The first dangerous keyword of upper-case code, '' when there is none."""
    named = F.when(
        code.contains("INTO"), F.regexp_replace(code, r"(\.|\bAS\b)\s*INTO\b", "$1 NAME")
    ).otherwise(code)
    functions = "|".join(DANGEROUS_FUNCTIONS)
    clauses = "|".join(c.replace(" ", r"\s+") for c in LOCKING_CLAUSES)
    hit = F.regexp_extract(
        named, rf"(:=|\bINTO\b|\b(?:{functions})\s*\(|\b(?:{clauses})\b)", 1
    )
    # Most statements hold none of the words, which is cheaper to see than to match.
    words = [":=", "INTO", *DANGEROUS_FUNCTIONS, *[c.split(" ")[-1] for c in LOCKING_CLAUSES]]
    possible = reduce(lambda a, b: a | b, [code.contains(word) for word in words])
    return F.when(possible, hit).otherwise("")


def _keyword(hit: Column) -> Column:
    word = F.regexp_replace(F.regexp_replace(hit, r"\s*\($", ""), r"\s+", " ")
    return F.when(hit == "", "").when(hit == ":=", "ASSIGNMENT").otherwise(word)


def _outer_type(statement: Column) -> Column:
    """First statement keyword outside parentheses, for statements that start with WITH."""
    types = "|".join(STATEMENT_TYPES)
    marks = F.regexp_extract_all(statement, F.lit(rf"([()]|\b(?:{types})\b)"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("found"))

    def walk(state: Column, mark: Column) -> Column:
        depth = (
            state["depth"]
            + F.when(mark == "(", F.lit(1)).when(mark == ")", F.lit(-1)).otherwise(F.lit(0))
        )
        first = (state["found"] == "") & (state["depth"] == 0) & ~mark.isin("(", ")")
        return F.struct(
            depth.alias("depth"), F.when(first, mark).otherwise(state["found"]).alias("found")
        )

    return F.aggregate(marks, start, walk, lambda state: state["found"])


def _first_word(statement: Column) -> Column:
    first = F.regexp_extract(statement, r"^\s*(CREATE\s+OR\s+REPLACE\b|[A-Z_]+)", 1)
    return F.when(first.startswith("CREATE"), F.regexp_replace(first, r"\s+", " ")).otherwise(first)


def audit(log: DataFrame, sql: str = "sql_text") -> DataFrame:
    """Add ``verdict`` and ``detail`` to every logged statement.

    ``ok``; ``SQL_DANGEROUS_FUNCTION`` with the keyword; ``SQL_FORBIDDEN_STATEMENT`` with EMPTY,
    MULTI_STATEMENT or the statement type. Quoted texts and ordinary comments never count; behind a
    quote or comment that is never closed, everything does. Each stage is a column of its own, so that
    no stage is computed twice; statements and literals may be of any length.
    """
    closed = F.col("__tw_closed")
    # Lengths in bytes differ only where something is left over.
    left_over = F.octet_length(closed) < F.octet_length(F.col(sql))
    rest = F.when(left_over, F.substring(F.col(sql), F.char_length(closed) + 1, F.char_length(F.col(sql)))).otherwise("")
    marked, code, parts = F.col("__tw_marked"), F.col("__tw_code"), F.col("__tw_parts")
    hint, hit, word = F.col("__tw_hint"), F.col("__tw_hit"), F.col("__tw_word")
    statement = F.get(parts, F.lit(0))
    staged = (
        log.withColumn("__tw_closed", _closed_part(F.col(sql)))
        .withColumn("__tw_marked", _blank_texts(closed))
        .withColumns(
            {
                "__tw_hint": _executable_comment(marked),
                "__tw_code": F.upper(F.concat(_drop_comments(marked), rest)),
            }
        )
        .withColumns(
            {
                "__tw_hit": _dangerous(code),
                "__tw_parts": F.filter(F.split(code, ";"), lambda part: part.rlike(r"\S")),
            }
        )
        .withColumn("__tw_word", _first_word(statement))
        .withColumn("__tw_word", F.when(word == "WITH", _outer_type(statement)).otherwise(word))
    )
    kind = F.when(word.isin(*STATEMENT_TYPES), word).otherwise("UNKNOWN")
    detail = (
        F.when(hint, "EXECUTABLE_COMMENT")
        .when(hit != "", _keyword(hit))
        .when(F.size(parts) == 0, "EMPTY")
        .when(F.size(parts) > 1, "MULTI_STATEMENT")
        .otherwise(kind)
    )
    verdict = (
        F.when(hint | (hit != ""), "SQL_DANGEROUS_FUNCTION")
        .when((F.size(parts) == 1) & (kind == "SELECT"), "ok")
        .otherwise("SQL_FORBIDDEN_STATEMENT")
    )
    return staged.select(*log.columns, verdict.alias("verdict"), detail.alias("detail"))


def audit_summary(log: DataFrame, sql: str = "sql_text") -> DataFrame:
    """Statements per verdict and detail."""
    return audit(log, sql).groupBy("verdict", "detail").agg(F.count("*").alias("n_statements"))
