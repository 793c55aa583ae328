"""Quotation linking: messages to the messages they quote, and conversations in reply order without quotes.

A line that begins with > marks is quoted; the number of marks is its level. Consecutive lines of one level are a passage.
Passages, and the paragraphs that messages write themselves, are normalised and hashed; a quoted passage links its message
to the latest earlier message of the conversation that wrote a paragraph of that hash. A message's parent is the message
that it quotes at the lowest level, else the message before it. Whole replies of a conversation follow their parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import materialize

QUOTED = r"^(?:[ \t]*>)+"


def normalised(text: Column) -> Column:
    """Lower case, quote marks at line beginnings and punctuation away, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?m)^(?:[ \t]*>)+", " "), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """array<struct(level, line)> of a text: the marks at the beginning of each line, and the line without them."""
    return F.transform(
        F.split(text, r"\r?\n", -1),
        lambda line: F.struct(F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", "")).alias("level"), F.regexp_replace(line, QUOTED + "[ ]?", "").alias("line")),
    )


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n, level, hash): runs of lines of one level, blank lines apart; level 0 is what the message says itself."""
    lines = messages.select("conv_id", "turn", F.posexplode(_lines(F.coalesce("text", F.lit("")))).alias("at", "x")).select("conv_id", "turn", "at", "x.level", "x.line")
    order = Window.partitionBy("conv_id", "turn").orderBy("at")
    blank = normalised(F.col("line")) == ""
    lines = lines.withColumn("new", (F.coalesce(F.lag("level").over(order), F.lit(-1)) != F.col("level")) | F.coalesce(F.lag(blank).over(order), F.lit(True)))
    lines = lines.withColumn("n", F.sum(F.col("new").cast("int")).over(order)).where(~blank)
    joined = lines.groupBy("conv_id", "turn", "n", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("passage"))
    return joined.select("conv_id", "turn", "n", "level", F.xxhash64(normalised(F.col("passage"))).alias("hash"))


def link(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> conv_id, turn, role, body, parent_turn, quotes, depth, position.

    body is the text without quoted lines, parent_turn the message replied to (null for a first one), quotes the number
    of passages that were found in earlier messages, depth the replies above, position the place (from 0) in the
    conversation read in reply order: by depth-first threads, earlier replies first. Null texts are empty messages; of
    rows with one conv_id and turn the smallest (text, role) stays; rows with a null conv_id or turn are left out, as
    they have no place. An empty table gives none; other columns are ignored.
    """
    rows = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))).alias("m"))
    rows = materialize(rows.select("conv_id", "turn", "m.role", "m.text"), "messages")
    quoting = rows.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    # only conversations in which somebody quotes need their paragraphs hashed
    asked = materialize(passages(quoting).where("level > 0"), "quoted")
    told = passages(rows.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")).where("level = 0")
    # the latest message before that says the passage, by one walk over all that say or quote it: a passage may be in every message
    said = told.select("conv_id", "hash", "turn", F.lit(None).cast("int").alias("n"), F.lit(0).alias("level"), F.col("turn").alias("said")).distinct()
    both = said.unionByName(asked.select("conv_id", "hash", "turn", F.col("n").cast("int").alias("n"), F.col("level").cast("int").alias("level"), F.lit(None).cast(asked.schema["turn"].dataType).alias("said")))
    earlier = Window.partitionBy("conv_id", "hash").orderBy(F.col("turn").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("origin", F.max("said").over(earlier)).where("level > 0 AND origin IS NOT NULL")
    found = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("origin")).alias("late"))).alias("best"), F.count(F.lit(1)).alias("quotes"))
    found = materialize(found.select("conv_id", "turn", (-F.col("best.late")).alias("quoted_turn"), "quotes"), "quote_links")
    order = Window.partitionBy("conv_id").orderBy("turn")
    linked = rows.join(found, ["conv_id", "turn"], "left").withColumn("before", F.lag("turn").over(order))
    linked = linked.withColumn("parent_turn", F.coalesce("quoted_turn", "before"))
    # messages that follow the one before them form a run; only where runs begin does the order need the links
    linked = linked.withColumn("run", F.sum(F.when((F.col("parent_turn") == F.col("before")), 0).otherwise(1)).over(order))
    inside = Window.partitionBy("conv_id", "run").orderBy("turn")
    body = F.array_join(F.transform(F.filter(_lines(F.col("text")), lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    linked = linked.select("conv_id", "turn", "role", F.trim(body).alias("body"), "parent_turn", F.coalesce("quotes", F.lit(0)).alias("quotes"), "run", (F.row_number().over(inside) - 1).alias("step"))
    linked = materialize(linked, "linked")
    # where a run begins: the run and step of its parent; a run's path is its parent's path and where it leaves it
    heads = linked.where("step = 0 AND parent_turn IS NOT NULL").select("conv_id", "run", "parent_turn")
    at = linked.select(F.col("conv_id").alias("p_conv"), F.col("turn").alias("p_turn"), F.col("run").alias("p_run"), F.col("step").alias("p_step"))
    heads = materialize(heads.join(at, (heads.conv_id == at.p_conv) & (heads.parent_turn == at.p_turn)).select("conv_id", "run", "p_run", "p_step"), "threads")
    paths = linked.select("conv_id", "run").where("run > 1").distinct().join(heads, ["conv_id", "run"], "left")
    # hops to the root by doubling: path holds (step, run) of each leaving point on the way
    paths = paths.select("conv_id", "run", F.coalesce("p_run", F.lit(1)).alias("up"), F.coalesce(F.col("p_step") + 1, F.lit(0)).cast("long").alias("depth"), F.array(F.struct(F.coalesce(F.col("p_step") + 1, F.lit(0)).cast("long").alias("leaves"), F.col("run").alias("run"))).alias("path"))
    paths = materialize(paths, "paths")
    while paths.where("up > 1").limit(1).count():
        upper = paths.select(F.col("conv_id").alias("u_conv"), F.col("run").alias("u_run"), F.col("up").alias("u_up"), F.col("depth").alias("u_depth"), F.col("path").alias("u_path"))
        step = paths.join(upper, (paths.conv_id == upper.u_conv) & (paths.up == upper.u_run), "left")
        paths = materialize(step.select("conv_id", "run", F.coalesce("u_up", F.lit(1)).alias("up"), (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"), F.when(F.col("u_path").isNull(), F.col("path")).otherwise(F.concat("u_path", "path")).alias("path")), "paths")
    none = F.array().cast("array<struct<leaves:bigint,run:bigint>>")
    placed = linked.join(paths.select("conv_id", "run", F.col("depth").alias("base"), "path"), ["conv_id", "run"], "left")
    # a message's first reply goes on with its run; so a run comes whole, then what leaves it, from its last step back
    key = F.concat(F.coalesce("path", none), F.array(F.struct(F.col("step").cast("long").alias("leaves"), F.lit(-1).cast("long").alias("run"))))
    sort_key = F.transform(key, lambda k: F.struct(F.when(k["run"] < 0, F.lit(-(2**40))).otherwise(-k["leaves"]).alias("leaves"), F.when(k["run"] < 0, k["leaves"]).otherwise(k["run"]).alias("run")))
    placed = placed.select("conv_id", "turn", "role", "body", "parent_turn", "quotes", (F.coalesce("base", F.lit(0)) + F.col("step")).cast("long").alias("depth"), sort_key.alias("key"))
    reading = Window.partitionBy("conv_id").orderBy("key", "turn")
    return placed.select("conv_id", "turn", "role", "body", "parent_turn", "quotes", "depth", (F.row_number().over(reading) - 1).cast("long").alias("position"))


def chat(messages: DataFrame) -> DataFrame:
    """link() with `formatted`: each message in a chat markup, to be read by conv_id and position."""
    return link(messages).withColumn("formatted", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("\n<|end|>\n")))


def quoted_replies(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) as a mail thread: each quotes what it answers, and what that quoted, a level deeper.

    A message answers the last odd turn before it, so that two branches leave every odd turn; turns without one, and rows
    that are null in conv_id or turn, keep their text. Rows meet by (conv_id, turn), so a long conversation is dealt out.
    """
    firsts = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("said"))
    asked = (F.col("turn") - 1 - F.pmod("turn", F.lit(2))).alias("asked")
    rows = messages.select("conv_id", "turn", "role", "text", asked)
    for k, back in ((1, F.col("asked")), (2, F.col("asked") - 2)):
        other = firsts.select(F.col("conv_id").alias("o_conv"), F.col("turn").alias("o_turn"), F.col("said").alias(f"said{k}"))
        rows = rows.join(other, (rows.conv_id == other.o_conv) & (back == other.o_turn), "left").drop("o_conv", "o_turn")

    def quote(text: Column, mark: str) -> Column:
        return F.when(text.isNotNull(), F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.concat(F.lit(mark), line)), "\n"))

    body = F.concat_ws("\n", quote(F.col("said2"), ">> "), quote(F.col("said1"), "> "), "text")
    return rows.select("conv_id", "turn", "role", F.when(F.col("said1").isNull(), F.col("text")).otherwise(body).alias("text"))
