"""Chat messages linked by their quotations; DataFrame and SQL functions only.

Lines are grouped into passages of one quote level (the number of leading
``>``).  Passages of all levels, their paragraphs and their lines are normalised
and hashed.  A quoted passage points to the latest earlier message of its
conversation whose own words (level 0) have that hash; a message replies to the
message that its shallowest and longest match points to, else to the message
before it.  Conversations are the threads of these replies, each parent before
its replies, without the quoted lines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch

#: Turns of one conversation and passage that a window sees at once; blocks of turns are combined in a second step.
TURN_BLOCK = 512
QUOTE_MARK = r"^(?:[ \t]*>)+"
#: Paragraphs and lines inside a message or passage link from this many normalised characters on: a stray "no" is not a quotation.  Whole passages and messages link at any length.
LEAST_PIECE = 4


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s>]+", " ")))


def latest_before(events: DataFrame, keys: list[str], turn: str, source: str, out: str) -> DataFrame:
    """For each row the greatest ``source`` among rows of its key with a smaller ``turn``.

    ``source`` is null or equal to ``turn``.  A window sees only one block of
    turns; what precedes the block is one grouped maximum a block, so a hot
    conversation is not gathered in one task.
    """
    block = F.floor(F.col(turn) / TURN_BLOCK)
    blocked = events.withColumn("tb", block)
    within = Window.partitionBy(*keys, "tb").orderBy(turn).rangeBetween(Window.unboundedPreceding, -1)
    inside = blocked.withColumn("in_block", F.max(source).over(within))
    per_block = blocked.groupBy(*keys, "tb").agg(F.max(source).alias("top"))
    past = Window.partitionBy(*keys).orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(*keys, "tb", F.max("top").over(past).alias("before_block"))
    return inside.join(per_block, [*keys, "tb"]).withColumn(out, F.coalesce("in_block", "before_block")).drop("in_block", "before_block", "tb")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Adds ``passages`` (level, raw text of each run of one level) and ``reply`` (level 0 text) to rows with ``text``.

    A blank line belongs to the run it follows.  Runs are found by where they
    begin, so a message of any number of lines takes time in proportion.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, QUOTE_MARK, 0), r"[^>]", ""))
    parsed = F.transform(lines, lambda s: F.struct(level(s).alias("level"), F.regexp_replace(s, QUOTE_MARK + r"[ \t]?", "").alias("line")))
    upto = lambda xs: F.sequence(F.lit(0), F.size(xs) - 1)
    blank = lambda x: (x["level"] == 0) & (F.trim(x["line"]) == "")

    def runs_of(p: Column) -> Column:
        solid = F.filter(upto(p), lambda i: (i == 0) | ~blank(F.get(p, i)))
        at = lambda so, k: F.get(p, F.get(so, k))["level"]
        starts = let(solid, lambda so: F.transform(F.filter(upto(so), lambda k: (k == 0) | (at(so, k) != at(so, k - 1))), lambda k: F.get(so, k)))

        def run(st: Column, s: Column, j: Column) -> Column:
            past = F.coalesce(F.get(st, j + 1), F.size(p))
            return F.struct(F.get(p, s)["level"].alias("level"), F.array_join(F.transform(F.slice(p, s + 1, past - s), lambda x: x["line"]), "\n").alias("text"))

        return let(starts, lambda st: F.transform(st, lambda s, j: run(st, s, j)))

    has_quote = text.rlike(r"(?m)^[ \t]*>")
    runs = F.when(has_quote, let(parsed, runs_of)).otherwise(F.array(F.struct(F.lit(0).alias("level"), text.alias("text"))))
    own = F.trim(F.array_join(F.transform(F.filter(F.col("passages"), lambda p: (p["level"] == 0) & p["text"].rlike(r"\S")), lambda p: F.regexp_replace(p["text"], r"\A\s+|\s+\z", "")), "\n"))
    return messages.withColumn("passages", runs).withColumn("reply", F.when(has_quote, own).otherwise(F.trim(text)))


def _placed_pieces(passage_text: Column) -> Column:
    """Passage, paragraphs and lines as (para, line, piece), -1 for a whole; a whole passage has any length, the others are not the shortest."""
    piece = lambda para, line, text: F.struct(para.cast("int").alias("para"), line.cast("int").alias("line"), normalised(text).alias("piece"))
    whole = F.array(piece(F.lit(-1), F.lit(-1), passage_text))
    paragraphs = F.split(passage_text, r"\n[ \t>]*\n")
    parts = F.transform(paragraphs, lambda s, i: piece(i, F.lit(-1), s))
    lines = F.flatten(F.transform(paragraphs, lambda s, i: F.transform(F.split(s, "\n"), lambda x, j: piece(i, j, x))))
    size = lambda x: F.length(x["piece"])
    return F.concat(F.filter(whole, lambda x: size(x) > 0), F.filter(F.concat(parts, lines), lambda x: size(x) >= LEAST_PIECE))


def quotation_links(placed: DataFrame) -> DataFrame:
    """Rows (ckey, turn, mid, level, target, size): every quoted passage of every level with the message it comes from.

    ``placed`` has ckey, turn, mid, reply, passages.  A piece points to the
    latest earlier message that says it.  Of a passage, a paragraph counts
    where the whole matches nothing, and a line where its paragraph does not
    either.  A passage of any length matches a whole message.
    """
    quoted = placed.select("ckey", "turn", "mid", F.posexplode(F.filter("passages", lambda p: p["level"] > 0)).alias("pos", "p"))
    quoted = quoted.select("ckey", "turn", "mid", "pos", F.col("p.level").alias("level"), F.explode(_placed_pieces(F.col("p.text"))).alias("x"))
    quoted = quoted.select("ckey", F.xxhash64("x.piece").alias("h"), "turn", "mid", "pos", "level", "x.para", "x.line", F.length("x.piece").alias("size")).distinct()
    asked = quoted.select("ckey", "h", "turn").distinct().withColumn("said", F.lit(None).cast("long"))
    said = placed.select("ckey", "turn", F.explode(_placed_pieces(F.col("reply"))).alias("x"))
    said = said.select("ckey", F.xxhash64("x.piece").alias("h"), "turn", F.col("turn").alias("said")).distinct()
    said = said.join(asked.select("ckey", "h").distinct(), ["ckey", "h"], "left_semi")
    # one event a piece and turn, so that a line that all quote is no hot spot
    events = asked.unionByName(said).groupBy("ckey", "h", "turn").agg(F.max("said").alias("said"))
    found = latest_before(events, ["ckey", "h"], "turn", "said", "target").where("target is not null").select("ckey", "h", "turn", "target")
    matched = quoted.join(found, ["ckey", "h", "turn"])
    passage = Window.partitionBy("ckey", "turn", "mid", "pos")
    matched = matched.withColumn("whole", F.max(F.col("para") < 0).over(passage))
    matched = matched.withColumn("paragraph", F.max(F.col("line") < 0).over(Window.partitionBy("ckey", "turn", "mid", "pos", "para")))
    return matched.where("para < 0 or (not whole and (line < 0 or not paragraph))").select("ckey", "turn", "mid", "level", "target", "size")


def link_conversations(
    spark: SparkSession, messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per message: conversation, turn, role, thread, depth, parent_turn, link, quote_levels, reply, links.

    ``link`` is ``quote``, ``sequence`` (the turn before) or ``root``; ``thread``
    is the turn of the root reached by parents and ``depth`` the number of
    steps, so (conversation, thread, turn) is a reply order: every parent stands
    before its replies.  ``reply`` has no quoted lines.  ``links`` are all of a
    message's quotations as (level, turn, size), the shallowest and longest
    first; the parent is the first of its turn's.  Paragraphs and lines inside
    a passage link from ``LEAST_PIECE`` characters on, whole ones at any length.

    A null or empty text is an empty reply and no source of quotes.  Messages
    with a null conversation are together one conversation.  A null turn is a
    root of its own that nothing replies to.  Messages that repeat a turn keep
    their rows and share parents; a conversation may hold any share of the
    rows, since windows see bounded blocks of turns; an empty table gives an
    empty result.  Other columns are not read.
    """
    scratch = Scratch(spark, "chat")
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    base = base.withColumn("ckey", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("-")))
    parsed = parse_quotes(base).select("conv", "ckey", "turn", "role", "reply", "passages").withColumn("mid", F.xxhash64("passages"))
    parsed = scratch.keep(parsed, "parsed")

    placed = parsed.where("turn is not null")
    every = scratch.keep(quotation_links(placed), "links")
    best = F.max(F.struct((-F.col("level")).alias("level"), "size", "target")).alias("best")
    by_quote = every.groupBy("ckey", "turn").agg(best).select("ckey", "turn", F.col("best.target").alias("quote_turn"))

    # one row a turn: its parent by quotation, else the turn before
    turns = placed.select("ckey", "turn").distinct().withColumn("said", F.col("turn"))
    turns = latest_before(turns, ["ckey"], "turn", "said", "previous").drop("said")
    tree = turns.join(by_quote, ["ckey", "turn"], "left").select(
        "ckey", "turn", F.coalesce("quote_turn", "previous").alias("parent"),
        F.when(F.col("quote_turn").isNotNull(), "quote").when(F.col("previous").isNotNull(), "sequence").otherwise("root").alias("link"),
    )
    # pointer doubling: each round doubles the distance of ``up``; rows whose ``up`` is their root are done
    start = tree.select("*", F.coalesce("parent", "turn").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("at_root"))
    start = scratch.keep(start, "tree")
    rooted, pending = [start.where("at_root")], start.where("not at_root")
    while pending.limit(1).count():
        above = functools.reduce(DataFrame.unionByName, [*rooted, pending])
        above = above.select("ckey", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("at_root").alias("at_root2"))
        moved = pending.join(above, ["ckey", "up"]).select("ckey", "turn", "parent", "link", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("at_root2").alias("at_root"))
        moved = scratch.keep(moved, "tree")
        rooted.append(moved.where("at_root"))
        pending = moved.where("not at_root")
    tree = functools.reduce(DataFrame.unionByName, rooted)

    done = parsed.join(tree, ["ckey", "turn"], "left")
    each = every.groupBy("ckey", "turn", "mid", "level", "target").agg(F.max("size").alias("size"))
    each = each.groupBy("ckey", "turn", "mid").agg(F.sort_array(F.collect_list(F.struct("level", (-F.col("size")).alias("least"), (-F.col("target")).alias("target")))).alias("found"))
    done = done.join(each, ["ckey", "turn", "mid"], "left")
    link = lambda x: F.struct(x["level"].cast("long").alias("level"), (-x["target"]).alias("turn"), (-x["least"]).cast("long").alias("size"))
    links = F.coalesce(F.transform("found", link), F.expr("cast(array() as array<struct<level:bigint,turn:bigint,size:bigint>>)")).alias("links")
    return done.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.coalesce("up", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("parent").alias("parent_turn"), F.coalesce("link", F.lit("root")).alias("link"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("quote_levels"), "reply", links,
    )


def format_threads(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", segment: int = 256) -> DataFrame:
    """Reply-ordered conversations: per (conversation, thread, segment of ``segment`` turns) the chat text of its messages.

    ``reply_tree`` tells of each message, in the same order, its turn, parent,
    kind of link, depth, quote levels and number of quotations; ``n_links`` is
    their sum.  Segments bound the size of a row; concatenated in the order of
    (segment, first_turn, part) they are the thread.  Where turns repeat so
    often that a segment has more than four times its turns, each turn has its
    own rows, of about ``segment`` messages each.  A message without a turn is
    a thread of its own.
    """
    spark = linked.sparkSession
    line = F.concat(F.lit("<|"), F.coalesce(role_col, F.lit("unknown")), F.lit("|>\n"), "reply")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    item = F.concat_ws(":", F.concat(known(turn_col), F.lit("<"), known("parent_turn")), "link", F.col("depth").cast("string"), F.col("quote_levels").cast("string"), F.size("links").cast("string"))
    lines = linked.select(
        F.col(conv_col).alias("conv"), "thread", F.col(turn_col).alias("turn"), F.floor(F.col(turn_col) / segment).alias("segment"), line.alias("line"), item.alias("item"),
        F.size("links").cast("long").alias("links"), F.monotonically_increasing_id().alias("row"),
    )
    lines = Scratch(spark, "threads").keep(lines, "lines")
    out = ["first_turn", "part", "chat", "reply_tree", "n_messages", "n_links"]
    alone = lines.where("turn is null").select(
        "conv", "thread", "segment", F.col("turn").alias("first_turn"), F.lit(0).cast("long").alias("part"), F.col("line").alias("chat"), F.col("item").alias("reply_tree"),
        F.lit(1).cast("long").alias("n_messages"), F.col("links").alias("n_links"),
    )
    placed = lines.where("turn is not null")
    at = ["conv", "thread", "segment"]
    per_turn = placed.groupBy(*at, "turn").agg(F.count(F.lit(1)).alias("n"))
    crowded = per_turn.groupBy(*at).agg(F.sum("n").alias("all")).where(F.col("all") > 4 * segment).drop("all")
    same = F.lit(True)
    for c in at:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    dealt = per_turn.alias("l").join(crowded.alias("r"), same, "left_semi").select(*at, "turn", F.ceil(F.col("n") / segment).alias("parts"))
    placed = placed.alias("l").join(dealt.alias("r"), same & (F.col("l.turn") == F.col("r.turn")), "left")
    placed = placed.select("l.*", F.when(F.col("parts").isNotNull(), F.col("l.turn")).alias("own_turn"), F.coalesce(F.pmod(F.xxhash64("l.row"), F.col("parts")), F.lit(0)).cast("long").alias("part"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "line", "item"))).alias("ordered")
    chats = placed.groupBy(*at, "own_turn", "part").agg(F.min("turn").alias("first_turn"), ordered, F.count(F.lit(1)).alias("n_messages"), F.sum("links").alias("n_links"))
    chats = chats.withColumn("chat", F.array_join(F.transform("ordered", lambda m: m["line"]), "\n")).withColumn("reply_tree", F.array_join(F.transform("ordered", lambda m: m["item"]), " "))
    return chats.select(*at, *out).unionByName(alone).withColumnRenamed("conv", conv_col)
