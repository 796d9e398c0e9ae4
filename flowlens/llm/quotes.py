"""Chat formatting by quotation linking: quoted lines lead back to the messages they come from.

A line's quote level is the number of `>` before its text (white space between them allowed). A passage is one line of
text: lower case, white space squeezed, empty ones and those that only announce a quotation left out. Passages are joined
by hash to lines that an earlier message of the same conversation wrote itself. A line without such a match is also
looked for by its sentences: consecutive lines of one level are joined, as clients wrap quotations anew, and cut into
sentences, and so are the messages' own lines; both joined and line by line, sentences of LEAST_WORDS words or more.
The message that wrote most of a message's quotations of the lowest level, the latest of several, is its parent; without one, the message before.
Runs of messages whose parent is the one before are one branch; the order key lists the branches on the way to a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.tables import keep

FAR = (1 << 62)
LEAST_WORDS = 3  # of a sentence that links by itself
SENTENCE = r"(?<=[.!?…])\s+"
# How clients announce a quotation: a fixed value.
ANNOUNCE = r"(?i)^(on .{0,200} wrote|.{0,100} (wrote|writes|said)|-+ ?original message ?-+|quote from .{0,100}):?$"
PREFIX = r"^[ \t]*((>[ \t]*)*)"


def lines_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, level, body, passage) of each line of each message."""
    split = rows.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    mark = F.regexp_extract("line", PREFIX, 1)
    body = F.when(F.length(mark) > 0, F.regexp_replace("line", PREFIX, "")).otherwise(F.col("line"))
    plain = F.btrim(F.regexp_replace(F.lower("body"), r"\s+", " "))
    return (split.withColumn("level", F.length(F.regexp_replace(mark, r"[^>]", "")).cast("int")).withColumn("body", body).drop("line")
            .withColumn("passage", plain).withColumn("announces", F.col("passage").rlike(ANNOUNCE)))


def sentences_of(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, level, words, places) of the sentences of LEAST_WORDS words or more in lines of one level.

    Lines that follow each other are joined by a space; places are the lines that a sentence touches. Sentences of single
    lines are there as well. lines: (conv_id, turn, place, level, passage), passages not empty.
    """
    follows = Window.partitionBy("conv_id", "turn").orderBy("place")
    new = (F.col("place") - F.lag("place").over(follows) != 1) | (F.col("level") != F.lag("level").over(follows))
    runs = lines.withColumn("run", F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(follows))
    own = F.array_sort(F.collect_list(F.struct("place", "passage")))  # lines of one message
    joined = runs.groupBy("conv_id", "turn", "level", "run").agg(own.alias("own")).select("conv_id", "turn", "level", "own")
    single = lines.select("conv_id", "turn", "level", F.array(F.struct("place", "passage")).alias("own"))

    def spans(parts: Column, gap: int) -> Column:
        """Ends of texts that stand one after another with a gap between, as (begin, end)."""
        sizes = F.transform(parts, F.length)
        return F.transform(sizes, lambda n, i: F.struct((F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x + gap)).alias("begin"), n.alias("size")))

    both = joined.where(F.size("own") > 1).unionByName(single)
    both = both.withColumn("parts", F.split(F.array_join(F.col("own.passage"), " "), SENTENCE)).where((F.size("own") > 1) | (F.size("parts") > 1))
    both = both.withColumns({"at": spans(F.col("parts"), 1), "lines_at": spans(F.col("own.passage"), 1)})
    each = both.select("conv_id", "turn", "level", "own", "lines_at", F.inline(F.arrays_zip("parts", "at")))
    touched = F.filter(F.arrays_zip("own", "lines_at"), lambda x: (x["lines_at"]["begin"] < F.col("at.begin") + F.col("at.size")) & (x["lines_at"]["begin"] + x["lines_at"]["size"] > F.col("at.begin")))
    return each.where(F.size(F.split("parts", " ")) >= LEAST_WORDS).select("conv_id", "turn", "level", F.col("parts").alias("words"), F.transform(touched, lambda x: x["own"]["place"]).alias("places"))


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv_id, turn, parent_turn, n_quoted, n_linked, depth_quoted, branch, order_key, content) of each different row with ids.

    n_quoted: quoted passages; n_linked: those that an earlier message wrote; depth_quoted: deepest level; content: the
    text without quoted lines and without announcements right before them, white space at its ends cut. branch: the turn
    that begins the message's branch. Sorting a conversation by order_key gives each message after its parent, replies to
    one message by turn. Null texts are empty; rows without conv_id or turn are left out; rows that repeat both are one
    message if their texts are equal, else the first by text.
    """
    rows = messages.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).groupBy(F.col(conv).alias("conv_id"), F.col(turn).alias("turn")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows = keep(rows, "messages")
    lines = lines_of(rows)
    follows = Window.partitionBy("conv_id", "turn").orderBy("place")
    lines = keep(lines.withColumn("next_level", F.lead("level").over(follows)), "message-lines")
    own = lines.where((F.col("level") == 0) & (F.col("passage") != "")).select("conv_id", F.col("turn").alias("source"), F.xxhash64("passage").alias("h"), F.col("passage").alias("words"))
    # the first message that wrote a passage; later ones of the conversation only repeat it
    first = own.groupBy("conv_id", "h", "words").agg(F.min("source").alias("source"))
    quoted = lines.where((F.col("level") > 0) & (F.col("passage") != "") & ~F.col("announces")).select("conv_id", "turn", "place", "level", F.xxhash64("passage").alias("h"), F.col("passage").alias("words"))
    found = quoted.join(first, ["conv_id", "h", "words"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    # what no line matches may be a sentence of one, or stand on other lines; a quoted line alone may be a sentence too
    lone = quoted.select("conv_id", "turn", "level", "words", F.array("place").alias("places"))
    asked = sentences_of(quoted.withColumnRenamed("words", "passage")).unionByName(lone.where(F.size(F.split("words", " ")) >= LEAST_WORDS)).withColumn("h", F.xxhash64("words"))
    told = sentences_of(lines.where((F.col("level") == 0) & (F.col("passage") != ""))).select("conv_id", F.xxhash64("words").alias("h"), "words", F.col("turn").alias("by"))
    told = told.unionByName(first.select("conv_id", "h", "words", F.col("source").alias("by"))).groupBy("conv_id", "h", "words").agg(F.min("by").alias("by"))
    by_sentence = asked.join(told, ["conv_id", "h", "words"]).where("by < turn").select("conv_id", "turn", F.explode("places").alias("place"), "by").groupBy("conv_id", "turn", "place").agg(F.min("by").alias("by"))
    found = found.join(by_sentence, ["conv_id", "turn", "place"], "left").withColumn("source", F.coalesce("source", "by")).drop("by")
    counts = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"), F.max("level").alias("depth_quoted"))
    votes = found.where("source IS NOT NULL").groupBy("conv_id", "turn", "level", "source").agg(F.count("*").alias("votes"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), "votes", "source")).alias("quoted_parent"))
    contents = (lines.where((F.col("level") == 0) & ~(F.col("announces") & (F.coalesce("next_level", F.lit(0)) > 0)))
                .groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x.body), "\n").alias("content")))
    chain = keep(chained(rows.select("conv_id", "turn"), parents), "message-parents", 10000)
    keyed = chain.join(branch_keys(chain), ["conv_id", "branch"]).withColumn("order_key", F.concat("key", F.array(F.lit(0).cast("long"), F.col("turn").cast("long"))))
    trim: Column = F.btrim(F.coalesce("content", F.lit("")), F.lit(" \t\n\r"))
    return (keyed.join(counts, ["conv_id", "turn"], "left").join(contents, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "parent_turn", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
                    F.coalesce("depth_quoted", F.lit(0)).alias("depth_quoted"), "branch", "order_key", trim.alias("content")))


def chained(turns: DataFrame, parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, branch) of distinct (conv_id, turn), with (conv_id, turn, quoted_parent) of some.

    Messages are dealt into ranges of (conv_id, turn) and looked at range by range, so a large conversation is many
    tasks; the message before a range and the branch it is in come from one row a conversation and range.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(turns.repartitionByRange(n, "conv_id", "turn").withColumn("range", F.spark_partition_id()), "message-order", 10000)
    own = Window.partitionBy("conv_id", "range").orderBy("turn")
    ranges = Window.partitionBy("conv_id").orderBy("range")
    ends = dealt.groupBy("conv_id", "range").agg(F.max("turn").alias("last"))
    ends = ends.select("conv_id", "range", F.lag("last").over(ranges).alias("range_before"))
    chain = dealt.select("conv_id", "range", "turn", F.lag("turn").over(own).alias("before")).join(ends, ["conv_id", "range"])
    chain = chain.join(parents, ["conv_id", "turn"], "left").withColumn("previous", F.coalesce("before", "range_before"))
    starts = F.col("previous").isNull() | (F.coalesce("quoted_parent", "previous") != F.col("previous"))
    chain = chain.select("conv_id", "range", "turn", F.coalesce("quoted_parent", "previous").alias("parent_turn"), F.when(starts, F.col("turn")).alias("start"))
    chain = keep(chain, "message-starts", 10000)
    tops = chain.groupBy("conv_id", "range").agg(F.max("start").alias("top"))
    tops = tops.select("conv_id", "range", F.max("top").over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("branch_before"))
    return chain.join(tops, ["conv_id", "range"]).select("conv_id", "turn", "parent_turn", F.coalesce(F.max("start").over(own), "branch_before").alias("branch"))


def branch_keys(chain: DataFrame) -> DataFrame:
    """(conv_id, branch, key) of each branch: for every branch on the way, how far before the end it leaves and its first turn.

    Branches whose parent's branch has a key get theirs, round by round: as many rounds as branches are nested.
    """
    heads = chain.where("turn = branch").select("conv_id", "branch", "parent_turn")
    above = chain.select("conv_id", F.col("turn").alias("parent_turn"), F.col("branch").alias("parent_branch"))
    heads = keep(heads.join(above, ["conv_id", "parent_turn"], "left"), "branches", 10000)
    done = heads.where("parent_branch IS NULL").select("conv_id", "branch", F.array().cast("array<bigint>").alias("key"))
    rest, level = heads.where("parent_branch IS NOT NULL"), done
    while not rest.isEmpty():
        up = level.select("conv_id", F.col("branch").alias("parent_branch"), F.col("key").alias("above"))
        level = keep(rest.join(up, ["conv_id", "parent_branch"]).select("conv_id", "branch", F.concat("above", F.array(F.lit(FAR) - F.col("parent_turn"), F.col("branch").cast("long"))).alias("key")), "branch-keys", 10000)
        done = done.union(level)
        rest = rest.join(level.select("conv_id", "branch"), ["conv_id", "branch"], "left_anti")
    return done


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, messages) with messages an array of (turn, role, content) in reply order, for conversations that fit a row."""
    roles = messages.groupBy(F.col(conv).alias("conv_id"), F.col(turn).alias("turn")).agg(F.min(role).alias("role"))
    rows = linked(messages, conv, turn, text).join(roles, ["conv_id", "turn"])
    ordered = F.array_sort(F.collect_list(F.struct("order_key", "turn", "role", "content")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m.turn.alias("turn"), m.role.alias("role"), m.content.alias("content"))).alias("messages"))
