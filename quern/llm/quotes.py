"""Quotation linking: what messages quote is traced to the messages that said it, and conversations are put in reply order.

Everything is DataFrame expressions. A message is taken apart within its row; only hashes of passages are shuffled.
Sources are found by one window per (conversation, hash) over the quoted passages and the passages equal to them, so a
line that thousands of messages share, or a conversation with a third of all messages, yields no pairs. Passages that no
message said as a unit are sought a second time, among the stretches of as many lines of the conversation's messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import remove_written, sized, written

#: What marks a quoted line, and a line that introduces a quotation.
QUOTED, INTRODUCES = r"^[ \t]*(>[ \t]*)+", r"(?i)\bwrote:[ \t]*$"

#: Turns of a conversation that one window takes.
STRETCH = 10_000


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", ""))


def _content(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, QUOTED, ""), "[ \t]+", " "))


def _at(array: Column, i: Column, otherwise: Column) -> Column:
    return F.coalesce(F.get(array, i), otherwise)


def parsed(messages: DataFrame, text_col: str) -> DataFrame:
    """``messages`` with ``__lines`` (level and content of each line, introductions of quotations left out) and ``__runs``.

    A run is a longest row of lines of one level that are not blank; its text is their contents with single spaces, its
    passage the same with line breaks, and ``n`` counts them.
    """
    raw = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n", "\n"), "\n")
    lines = F.transform(raw, lambda x: F.struct(_level(x).alias("level"), _content(x).alias("content"), x.alias("line")))
    nothing = F.struct(F.lit(-1).alias("level"), F.lit("").alias("content"), F.lit("").alias("line"))
    column = F.col("__all")
    own = F.filter(
        column, lambda x, i: ~((x["level"] == 0) & x["line"].rlike(INTRODUCES) & (_at(column, i + 1, nothing)["level"] > 0))
    )
    one = F.col("__lines")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(one)),
        lambda i: (i == F.size(one))
        | (F.get(one, i)["content"] == "")
        | (_at(one, i - 1, nothing)["content"] == "")
        | (_at(one, i - 1, nothing)["level"] != F.get(one, i)["level"]),
    )
    at = F.col("__starts")
    content = lambda r: F.transform(F.slice(one, r["s"] + 1, r["e"] - r["s"]), lambda x: x["content"])
    runs = F.transform(
        F.filter(F.transform(at, lambda s, k: F.struct(s.alias("s"), F.get(at, k + 1).alias("e"))), lambda r: r["e"].isNotNull()),
        lambda r: F.struct(
            F.get(one, r["s"])["level"].alias("level"),
            F.lower(F.array_join(content(r), " ")).alias("text"),
            F.lower(F.array_join(content(r), "\n")).alias("passage"),
            (r["e"] - r["s"]).alias("n"),
        ),
    )
    return (
        messages.withColumn("__all", lines)
        .withColumn("__lines", own)
        .withColumn("__starts", starts)
        .withColumn("__runs", F.filter(runs, lambda r: r["text"] != ""))
        .drop("__all", "__starts")
    )


def own_units(lines: Column, runs: Column) -> Column:
    """Hashes of what a message itself says: each line, each run, and all of it."""
    own = F.filter(lines, lambda x: (x["level"] == 0) & (x["content"] != ""))
    texts = F.concat(
        F.transform(own, lambda x: F.lower(x["content"])),
        F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["text"]),
        F.when(F.size(own) > 0, F.array(F.lower(F.array_join(F.transform(own, lambda x: x["content"]), " ")))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.transform(texts, F.md5))


def own_lines(lines: Column) -> Column:
    """Hashes of the lines that a message itself says, blank and quoted ones left out."""
    return F.transform(F.filter(lines, lambda x: (x["level"] == 0) & (x["content"] != "")), lambda x: F.md5(F.lower(x["content"])))


def stretches(lines: Column, wanted: Column) -> Column:
    """Hashes of stretches of ``lines`` (hashes), for each entry of ``wanted`` those of ``n`` lines that begin with the line ``first``."""
    starts = lambda w: F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(lines) - w["n"] + 1)), lambda i: F.get(lines, i - 1) == w["first"])
    return F.array_distinct(F.flatten(F.transform(wanted, lambda w: F.transform(starts(w), lambda i: F.md5(F.array_join(F.slice(lines, i, w["n"]), ""))))))


def quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Every passage that a turn quotes: ``conv``, ``turn``, ``level``, ``hash``, how often (``k``), and ``source``, the latest
    earlier turn of the conversation that said it in its own words (a line, a run of lines, or the whole message). Where none did, it is the
    latest earlier turn in whose own lines, blank ones left out, those of the passage follow one another; or null."""
    units = parsed(messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("__text")), "__text")
    units = units.where("conv is not null and turn is not null")
    quoted = units.select("conv", "turn", F.explode(F.filter("__runs", lambda r: r["level"] > 0)).alias("r"))
    quoted = quoted.select("conv", "turn", F.col("r.level").alias("level"), F.md5(F.col("r.text")).alias("hash"), F.col("r.passage").alias("passage"), F.col("r.n").alias("n"))
    each = F.transform(F.split("passage", "\n"), F.md5)
    quoted = quoted.withColumn("__each", each).withColumns({"passage": F.md5(F.array_join("__each", "")), "first": F.col("__each")[0]}).drop("__each")
    quoted = written(quoted.groupBy(*quoted.columns).agg(F.count("*").alias("k")))
    said = units.select("conv", "turn", F.explode(own_units(F.col("__lines"), F.col("__runs"))).alias("hash"))
    whole = written(_sources(quoted, said))
    missed = whole.where("source is null and n > 1").drop("source")
    sought = written(missed.groupBy("conv").agg(F.collect_set(F.struct("first", "n")).alias("wanted"), F.max("turn").alias("last")))
    n = sought.count()
    if n:
        near = units.select("conv", "turn", own_lines(F.col("__lines")).alias("own")).join(sized(sought, n), "conv").where("turn < last")
        # What a message has of the first lines is found by hashing; only those are then compared line by line.
        met = near.withColumn("met", F.array_intersect("own", F.transform("wanted", lambda w: w["first"]))).where(F.size("met") > 0)
        met = met.withColumn("wanted", F.filter("wanted", lambda w: F.array_contains("met", w["first"])))
        parts = met.select("conv", "turn", F.explode(stretches(F.col("own"), F.col("wanted"))).alias("hash"))
        found = _sources(missed.withColumns({"hash": F.col("passage"), "whole": F.col("hash")}), parts)
        found = found.withColumn("hash", F.col("whole"))
        whole = whole.where("source is not null or n = 1").unionByName(found.select(*whole.columns))
    return whole.select("conv", "turn", "level", "hash", "k", "source")


def _sources(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """``quoted`` (a stored table) with ``source``, the latest earlier turn of the conversation with the hash in ``said``."""
    sought = written(quoted.select("conv", "hash").distinct())
    said = said.join(sized(sought, sought.count()), ["conv", "hash"], "left_semi").distinct()
    both = said.select("conv", "turn", "hash", F.col("turn").alias("own")).unionByName(quoted, allowMissingColumns=True)
    return _latest_before(both).where("level is not null").select(*quoted.columns, "source")


def _latest_before(rows: DataFrame) -> DataFrame:
    """``rows`` with ``source``: the largest ``own`` of an earlier turn of the same conversation and hash.

    Turns are dealt into stretches of ``STRETCH``; a window runs within a stretch, and another over one row a stretch
    hands on what came before. So no window holds all that one passage has in a large conversation.
    """
    cut = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    totals = cut.groupBy("conv", "hash", "stretch").agg(F.max("own").alias("own"))
    earlier = Window.partitionBy("conv", "hash").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    handed = totals.select("conv", "hash", "stretch", F.max("own").over(earlier).alias("handed"))
    before = Window.partitionBy("conv", "hash", "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("near", F.max("own").over(before)).join(handed, ["conv", "hash", "stretch"]).withColumn("source", F.coalesce("near", "handed"))


def replies(quoted: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``n_quoted``, ``n_linked``, ``reply_to``: the turn that most passages of the first level come from, the latest on ties."""
    votes = quoted.groupBy("conv", "turn", "source").agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when((F.col("level") == 1) & F.col("source").isNotNull(), F.col("k"))), F.lit(0)).alias("direct")
    )
    return votes.groupBy("conv", "turn").agg(
        F.sum("n").alias("n_quoted"),
        F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
        F.max_by("source", F.when(F.col("direct") > 0, F.struct("direct", "source"))).alias("reply_to"),
    )


def threads(answers: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``thread``: the first message that replies lead back to, by pointer doubling over ``reply_to``."""
    now = written(answers.where("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("thread"), F.lit(True).alias("moved")))
    while now.where("moved").head(1):
        further = now.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("__next"))
        after = written(now.join(further, ["conv", "thread"], "left").select("conv", "turn", F.coalesce("__next", "thread").alias("thread"), F.col("__next").isNotNull().alias("moved")))
        remove_written(now)
        now = after
    return now.drop("moved")


def link_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", carry: tuple[str, ...] = ("role",)) -> DataFrame:
    """``messages`` in reply order and without quotations.

    Columns: ``conv_col``, ``turn_col``, the columns of ``carry``, ``thread`` (the turn that started it), ``reply_to``,
    ``n_quoted`` and ``n_linked`` (passages quoted, and those whose source was found) and ``text``, the lines of level 0
    without surrounding blank ones. Rows come sorted by conversation, thread and turn, so every reply follows what it
    replies to; the sort is by ranges and splits large conversations. A message that replies to none starts a thread.

    A null text counts as empty. Rows with a null conversation or turn are linked to nothing. Rows that repeat a
    conversation and turn are one message for linking, with the passages of all of them counted, and are all returned.
    An empty table gives no rows.
    """
    answers = written(replies(quotations(messages, conv_col, turn_col, text_col)))
    roots = threads(answers)
    n = answers.count()
    keyed = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.struct(F.lit(0).alias("__none"), *carry).alias("__carry"), F.col(text_col).alias("__text"))
    spoken = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    linked = keyed.join(sized(answers, n), ["conv", "turn"], "left").join(sized(roots, n), ["conv", "turn"], "left")
    rows = (
        parsed(linked, "__text")
        .select(
            F.col("conv").alias(conv_col),
            F.col("turn").alias(turn_col),
            *(F.col(f"__carry.`{c}`").alias(c) for c in carry),
            F.coalesce("thread", "turn").alias("thread"),
            "reply_to",
            F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.regexp_replace(spoken, r"^\s*\n|\s+$", "").alias("text"),
        )
    )
    return written(rows).orderBy(conv_col, "thread", turn_col)  # stored first: a sort by ranges computes its input twice
