"""Chat formatting by quotation linking; expressions of Spark SQL only.

Nested quote levels are parsed from the marks at line starts. Quoted passages (paragraphs, lines, sentences and windows of words) are
normalised and hashed, and joined to the earlier messages that said them, one level up. The message whose own words most of the quoted text
is, is the one replied to; following replies to their roots gives threads. What is left without quotes is the message's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import once, written

_MARKS = r"^((?:[\x20\t]*>)+)"
#: Lines that announce a quote, left out where a quote follows.
ANNOUNCE = r"^\s*(?:On\b.*\bwrote|Le\b.*\ba écrit|Am\b.*\bschrieb\b.*|El\b.*\bescribió)\s?:\s*$"
#: Where a normalised paragraph is cut into sentences.
SENTENCE_END = r"(?<=[.!?\x{2026}])\x20|(?<=[\x{3002}\x{ff01}\x{ff1f}])\x20?"
_SINGLE = r"\x{2e80}-\x{2fdf}\x{3040}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"
#: Words of a window; letters of scripts without spaces are words of their own.
WORD = rf"[{_SINGLE}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_SINGLE}]]+"
#: Words in a window; of a quote that has fewer, all.
WINDOW = 5
#: Messages of a conversation up to which all that said a passage are compared one by one; more are compared by kind, with the same result.
SAYERS = 8
#: Turn numbers that are searched in one piece for the latest one that said such a passage.
PIECE_TURNS = 1 << 16
#: Turn numbers in one row of the nested form.
SEGMENT_TURNS = 256


def quoted_lines(text: Column) -> Column:
    """array<struct<level, body>>: the lines of a text, with the number of quote marks before each."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(x, _MARKS + r"\x20?", "")).otherwise(x).alias("body"))

    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), line)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_text(lines: Column) -> Column:
    """What is not quoted: level 0, without the lines that announce a quote."""
    def own(x: Column, k: Column) -> Column:
        following = F.get(lines, k + 1)["level"]
        after_blank = F.when(F.trim(F.get(lines, k + 1)["body"]) == "", F.get(lines, k + 2)["level"])
        announces = x["body"].rlike(ANNOUNCE) & (F.greatest(F.coalesce(following, F.lit(0)), F.coalesce(after_blank, F.lit(0))) > 0)
        return (x["level"] == 0) & ~announces

    body = F.array_join(F.transform(F.filter(lines, own), lambda x: x["body"]), "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"\n[\x20\t]*(?:\n[\x20\t]*)+\n", "\n\n"), r"^\s+|\s+$", ""))


def runs(lines: Column) -> Column:
    """array<struct<level, run>>: the lines of each run of one level without blank ones between."""
    none = F.array().cast("array<struct<level:int,run:array<string>>>")
    start = F.struct(none.alias("done"), F.lit(-1).alias("level"), F.array().cast("array<string>").alias("run"))

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["run"]) > 0, F.array_append(acc["done"], F.struct(acc["level"].alias("level"), acc["run"].alias("run")))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        blank = F.trim(x["body"]) == ""
        same = (acc["level"] == x["level"]) & ~blank
        done = F.when(same, acc["done"]).otherwise(closed(acc))
        run = F.when(blank, F.array().cast("array<string>")).when(same, F.array_append(acc["run"], x["body"])).otherwise(F.array(x["body"]))
        return F.struct(done.alias("done"), x["level"].alias("level"), run.alias("run"))

    return F.aggregate(lines, start, step, closed)


def passages(messages: DataFrame, quoted: bool) -> DataFrame:
    """(conv, turn, level, key, chars, size): paragraphs and lines of the messages, their sentences, and their windows of words; the key is a
    hash of conversation, level one up and passage. ``quoted``: those of quotes, with windows of ``WINDOW`` words or of all words if they
    are fewer (``size``, null for other passages). Else those said, one level up from these, with windows of the numbers in ``sizes``."""
    level = F.col("r.level") - 1 if quoted else F.col("r.level")
    given = once(messages, runs=runs(F.col("lines"))).select(*messages.columns, F.explode("runs").alias("r")).withColumn("level", level)
    given = given.where("level >= 0")
    kept = ["conv", "turn", "level", *([] if quoted else ["sizes"])]
    units = F.array_distinct(F.transform(F.concat(F.array(F.array_join("r.run", " ")), F.col("r.run")), normalised))
    given = once(given.select(*kept, "r"), units=units).select(*kept, F.explode("units").alias("unit"))
    given = once(given, words=F.regexp_extract_all("unit", F.lit(WORD), F.lit(0)))
    if quoted:
        given = given.withColumn("sizes", F.array(F.least(F.size("words"), F.lit(WINDOW))))

    def windows(n: Column) -> Column:
        places = F.when((n > 0) & (F.size("words") >= n), F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.struct(F.array_join(F.slice("words", k, n), " ").alias("text"), n.alias("size")))

    whole = F.transform(F.concat(F.array("unit"), F.split("unit", SENTENCE_END, -1)), lambda x: F.struct(x.alias("text"), F.lit(None).cast("int").alias("size")))
    found = given.select("conv", "turn", "level", F.explode(F.concat(whole, F.flatten(F.transform("sizes", windows)))).alias("p")).where("p.text <> ''")
    key = F.xxhash64("conv", "level", "p.text", F.col("p.size").isNull())
    return found.select("conv", "turn", "level", key.alias("key"), F.char_length("p.text").cast("long").alias("chars"), "p.size")


def _latest(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(key, turn, parent): the latest earlier turn that said the passage. Turns are searched in pieces, so that no task holds all of a
    passage that is said a million times."""
    both = asked.select("key", "turn", F.lit(True).alias("asks"), F.lit(None).cast("long").alias("said"))
    both = both.unionByName(said.select("key", "turn", F.lit(False).alias("asks"), F.col("turn").alias("said")))
    both = both.groupBy("key", "turn").agg(F.max("asks").alias("asks"), F.max("said").alias("said")).withColumn("piece", F.floor(F.col("turn") / F.lit(PIECE_TURNS)))
    near = F.max("said").over(Window.partitionBy("key", "piece").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    far = F.max("top").over(Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    tops = both.groupBy("key", "piece").agg(F.max("said").alias("top")).select("key", "piece", far.alias("far"))
    found = both.withColumn("near", near).where("asks").join(tops, ["key", "piece"])
    return found.select("key", "turn", F.coalesce("near", "far").alias("parent")).where("parent IS NOT NULL")


def _parents(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked): of the quoted passages of each message, how many were found, and the message replied to. It is the one
    that said most characters of what is quoted once in its own words; then the one that quoted most of the rest; then the latest."""
    known = messages.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", "lines", "quoting")
    asked = written(passages(known.where("quoting").drop("quoting"), quoted=True).distinct(), "quoted")
    # Only conversations in which somebody quotes are searched; joining their ids first keeps the others' passages out of the shuffle.
    sizes = asked.groupBy("conv").agg(F.collect_set("size").alias("sizes"))
    said = passages(known.drop("quoting").join(sizes, "conv"), quoted=False).select("conv", "turn", "key")
    said = written(said.join(asked.select("key").distinct(), "key", "left_semi").distinct(), "said")
    sayers = written(said.groupBy("key").agg(F.count("*").alias("n"), F.min("turn").alias("first")), "sayers")
    asked = asked.select("conv", "turn", "key", "chars", (F.col("level") == 0).alias("own"))
    own = F.sum(F.when(F.col("own"), F.col("chars")).otherwise(0)).alias("own")
    deeper = F.sum(F.when(F.col("own"), 0).otherwise(F.col("chars"))).alias("deeper")
    hot = sayers.where(F.col("n") > SAYERS).select("key")
    few = asked.join(said.select("key", F.col("turn").alias("parent")).join(hot, "key", "left_anti"), "key").where("parent < turn")
    votes = few.groupBy("conv", "turn", "parent").agg(own, deeper)
    if not hot.isEmpty():
        votes = _with_hot(asked.join(hot, "key", "left_semi"), said.join(hot, "key", "left_semi"), votes, own, deeper)
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct("own", "deeper", "parent")).alias("best"))
    found = asked.join(sayers, "key").where(F.col("first") < F.col("turn"))
    n_linked = found.groupBy("conv", "turn").agg(F.count_distinct("key").alias("n_linked"))
    return best.join(n_linked, ["conv", "turn"]).select("conv", "turn", F.col("best.parent").alias("parent"), "n_linked")


def _with_hot(asked: DataFrame, said: DataFrame, votes: DataFrame, own: Column, deeper: Column) -> DataFrame:
    """The votes of all who may be replied to, with the passages that many messages said.

    Messages that said the same of these passages are alike, but for what else they said and their turn. So a quote is compared with each
    such kind of message once. The latest earlier message of a kind stands for it, and the messages found by rarer passages get the
    vote of their kind as well.
    """
    kinds = said.groupBy("conv", "turn").agg(F.md5(F.concat_ws(",", F.sort_array(F.collect_set("key")).cast("array<string>"))).alias("kind"))
    kinds = written(kinds, "kinds")
    says = said.join(kinds, ["conv", "turn"]).select("conv", "kind", "key").distinct()
    by_kind = written(asked.join(says, ["conv", "key"]).groupBy("conv", "turn", "kind").agg(own, deeper), "votes")
    as_key = F.struct("conv", "kind").alias("key")
    latest = _latest(by_kind.select(as_key, "turn"), kinds.select(as_key, "turn"))
    latest = latest.select(F.col("key.conv").alias("conv"), "turn", F.col("key.kind").alias("kind"), "parent")
    of_kinds = by_kind.join(latest, ["conv", "turn", "kind"]).select("conv", "turn", "parent", "own", "deeper")
    more = by_kind.select("conv", "turn", "kind", F.col("own").alias("hot_own"), F.col("deeper").alias("hot_deeper"))
    rarer = votes.join(kinds.select("conv", F.col("turn").alias("parent"), "kind"), ["conv", "parent"], "left").join(more, ["conv", "turn", "kind"], "left")
    rarer = rarer.select("conv", "turn", "parent", (F.col("own") + F.coalesce("hot_own", F.lit(0))).alias("own"), (F.col("deeper") + F.coalesce("hot_deeper", F.lit(0))).alias("deeper"))
    return of_kinds.unionByName(rarer)


def _roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked, root, depth), by pointer jumping: every round doubles the way that is covered. A parent comes before its
    reply, so there are no circles."""
    now = written(parents.withColumn("root", F.col("parent")).withColumn("depth", F.lit(1).cast("long")), "replies")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        if now.join(up, ["conv", "root"], "left_semi").isEmpty():
            return now
        joined = now.join(up, ["conv", "root"], "left")
        now = written(
            joined.select("conv", "turn", "parent", "n_linked", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "replies",
        )


def link_quotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, root_turn, depth, n_quoted (quoted lines), n_linked (passages found), and
    the text without quotes.

    A message that replies to nothing is its own root, at depth 0. Reply order of a conversation is (root_turn, turn): a message comes after the
    one it replies to. Links go to earlier turns of the same conversation; of those that said as much of a quote the latest counts. A null text stays
    null and quotes nothing; rows without a conversation or turn are linked with nothing and are their own root; rows that share both are
    one message for links, and each stays a row. An empty table gives an empty result; only the four columns are read.
    """
    given = messages.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    split = once(given, lines=quoted_lines(F.coalesce("text", F.lit(""))))
    split = split.withColumn("quoting", F.coalesce("text", F.lit("")).rlike(r"(?:^|[\r\n])[\x20\t]*>"))
    links = _roots(_parents(split))
    found = split.join(links, ["conv", "turn"], "left")
    return found.select(
        F.col("conv").alias("conv_id"), "turn", "role",
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.when(F.col("text").isNull(), F.lit(None)).when(F.col("quoting"), own_text(F.col("lines"))).otherwise(F.col("text")).alias("text"),
    )


def conversations(linked: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """The nested form: conv_id, root_turn, segment and messages (turn, role, content) in order; messages that repeat are there once.

    A segment covers ``segment_turns`` turn numbers, so a row stays bounded however long its conversation is. Rows without a conversation
    or turn are in none.
    """
    segment = F.floor(F.col("turn") / F.lit(segment_turns)).alias("segment")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    known = linked.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    return known.groupBy("conv_id", "root_turn", segment).agg(F.array_sort(F.collect_set(message)).alias("messages"))
