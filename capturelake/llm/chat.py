"""Chat formatting by quotation linking, in DataFrame functions only.

A message's lines have a quote level, the number of ``>`` in front.  A run of lines of one level is a passage.  Passages
and single lines are normalised (lower case, letters and digits only) and hashed.  What stands at level n + 1 in a message
is looked up among what stood at level n in the same conversation; the *original* of a hash is the first message that has
it.  A message answers the original that holds most of what it quotes (in characters; the later one of equals) at the
lowest level at which it quotes something known, and one that quotes nothing known answers the message before it.

The answers form a tree per conversation; ``position`` numbers it so that each message stands after the one it answers:
a first answer continues its thread, other answers branch off right behind the message they answer.  Threads are chains of
segments (runs of messages that each answer the one before); chains and branches are resolved by pointer doubling, so the
rounds grow with the logarithm of a thread's segments, and a table without quotes needs none.

Originals are minima that are aggregated before they are joined.  Order within a conversation comes from one sort by ranges
of all rows; counts and last values go on from range to range (``_running``), so a conversation that has a third of all messages
is spread over a third of the tasks.

Defined results: null text is empty; a null turn comes first; null conversations are one conversation; rows that repeat a
turn follow each other by role and text, nulls first; a message of quotes only has an empty body; a long text is read whole,
but its lines are one row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

QUOTE = r"^((?:[ \t]*>)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(mid, part, level, text): runs of lines of one quote level; messages (mid, text)."""
    lines = messages.select("mid", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")).alias("line", "raw"))
    mark = F.regexp_extract("raw", QUOTE, 1)
    level = (F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).cast("int")
    body = F.when(level > 0, F.ltrim(F.substring(F.col("raw"), F.length(mark) + 1, F.length("raw")))).otherwise(F.col("raw"))
    lines = lines.select("mid", "line", level.alias("level"), body.alias("body"))
    own = Window.partitionBy("mid").orderBy("line")
    turn = F.when(F.coalesce(F.lag("level").over(own) != F.col("level"), F.lit(True)), 1).otherwise(0)
    runs = lines.withColumn("turn", turn).withColumn("part", F.sum("turn").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n")
    return runs.groupBy("mid", "part", "level").agg(joined.alias("text"))


def _units(parts: DataFrame) -> DataFrame:
    """(mid, level, hash, weight): each passage and each of its lines, in normal form."""
    whole = parts.select("mid", "level", normalised(F.col("text")).alias("norm"))
    lines = parts.select("mid", "level", F.explode(F.split("text", "\n")).alias("line")).select("mid", "level", normalised(F.col("line")).alias("norm"))
    found = whole.unionByName(lines).where("norm <> ''")
    return found.select("mid", "level", F.md5("norm").alias("hash"), F.length("norm").alias("weight")).distinct()


def _doubled(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, top, path): each node's last ancestor and what lies on the way; links (node, up, path), up null at a top."""
    now, step = scratch.save(links, f"{name}-0"), 0
    while now.where("up IS NOT NULL").limit(1).count():
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("top").alias("top2"))
        jump = now.join(above, "up", "left").select("node", F.col("up2").alias("up"), F.when(F.col("up").isNull(), F.col("top")).when(F.col("up2").isNull(), F.col("top2")).alias("top"), F.concat(F.coalesce("path2", F.array().cast(now.schema["path"].dataType)), "path").alias("path"))
        step += 1
        now = scratch.save(jump, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return now.select("node", "top", "path")


def _ranges(scratch: Scratch, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (conv, ...) with ``at``, which ascends with ``order`` within a conversation, and the number of its ``range``.

    One sort by ranges orders all rows, so a conversation that holds a third of them fills a third of the ranges.
    """
    by = [F.col("conv").asc_nulls_first(), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return scratch.save(placed.withColumn("range", F.shiftright("at", 33)), name)


def _running(rows: DataFrame, inside: dict[str, Column], own: dict[str, Column]) -> DataFrame:
    """``rows`` (conv, range, ...) with running values of a conversation that go on from range to range.

    ``inside`` are running values within a range, ``own`` is what a range hands to the later ones: a number to add, if the
    name is "place", or else the value where ``inside`` has none; later ranges have the larger values.  A conversation has one
    row for each of its ranges where these are handed on.
    """
    sums = rows.groupBy("conv", "range").agg(*(c.alias(f"own_{n}") for n, c in own.items()))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    handed = {n: (F.sum if n == "place" else F.max)(f"own_{n}").over(earlier) for n in own}
    before = sums.select(F.col("conv").alias("_conv"), F.col("range").alias("_range"), *(c.alias(f"_{n}") for n, c in handed.items()))
    joined = rows.withColumns({f"in_{n}": c for n, c in inside.items()}).join(before, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range")))
    made = {n: F.col(f"in_{n}") + F.coalesce(f"_{n}", F.lit(0)) if n == "place" else F.coalesce(f"in_{n}", f"_{n}") for n in inside}
    return joined.withColumns(made).select(*rows.columns, *made)


def quoted_mail(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as a mail archive: messages that quote earlier ones in front of their text.

    By a hash of conversation and turn, a quarter of the messages quote, line by line at level 1, the message of two turns
    before, and a quarter the one of four turns before at level 2 (a quote within a quote).  Where there is none, or the
    message or the earlier one has no text, a message stays as it is.  Of several earlier ones the smallest text counts.
    """
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    digest = F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    kind = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 4
    gap = F.when(kind == 0, 2).when(kind == 1, 4)
    asked = rows.withColumn("kind", kind).withColumn("of", F.when(F.col("text").isNotNull(), F.col("turn") - gap))
    earlier = rows.where("trim(text) <> ''").groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min("text").alias("original"))
    joined = asked.join(earlier, (F.col("conv_id") == F.col("c")) & (F.col("of") == F.col("t")), "left")
    mark = F.when(F.col("kind") == 0, "> ").otherwise(">> ")
    lines = F.concat(mark, F.replace(F.col("original"), F.lit("\n"), F.concat(F.lit("\n"), mark)))
    return joined.select("conv_id", "turn", "role", F.when(F.col("original").isNull(), F.col("text")).otherwise(F.concat(lines, F.lit("\n"), F.col("text"))).alias("text"))


def reply_order(conversations: DataFrame, turn_format: str = "<|%s|>\n%s<|end|>\n") -> DataFrame:
    """conv_id, turn, role, reply_to, linked, position, body, formatted for every row of ``conversations``.

    reply_to is the turn that a message answers (null for a conversation's first), linked whether a quote says so.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # a conversation's order: turn, then role and text; rows that are equal in all are alike
    rows = _ranges(scratch, rows, [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()], "messages")
    rows = rows.withColumnRenamed("at", "mid")
    quoting = rows.where(F.coalesce(F.col("text").rlike(r"(?m)" + QUOTE), F.lit(False)))
    talking = quoting.select("conv").distinct()
    parts = scratch.save(passages(rows.join(talking, rows.conv.eqNullSafe(talking.conv), "left_semi")), "passages")
    # mid ascends with the order, so it tells earlier from later; a null conversation is one of its own
    named = rows.select("mid", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("")).alias("conv"))
    units = _units(parts).join(named, "mid")
    originals = units.groupBy("conv", "level", "hash").agg(F.min("mid").alias("first"))
    asked = units.where("level >= 1").select("conv", (F.col("level") - 1).alias("level"), "hash", "weight", "mid")
    votes = asked.join(originals, ["conv", "level", "hash"]).where("first < mid").groupBy("mid", "level", "first").agg(F.sum("weight").alias("weight"))
    linked = scratch.save(votes.groupBy("mid").agg(F.max_by("first", F.struct(-F.col("level"), "weight", "first")).alias("linked")), "linked")

    slim = rows.join(linked, "mid", "left").select("mid", "conv", "range", "turn", "linked")
    inside = Window.partitionBy("conv", "range").orderBy("mid")
    placed = _running(slim, {"place": F.row_number().over(inside).cast("long"), "previous": F.lag("mid").over(inside)}, {"place": F.count("*"), "previous": F.max("mid")})
    placed = placed.withColumn("parent", F.coalesce("linked", "previous"))
    # a message continues the one before it unless it is linked to another one
    start = F.when(F.col("previous").isNull() | (F.col("parent") != F.col("previous")), F.col("mid"))
    seen = F.last("start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    tree = scratch.save(_running(placed.withColumn("start", start), {"segment": seen}, {"segment": F.max("start")}).drop("start", "range"), "tree")

    # heads of segments that answer some message; the first of them continues the thread unless the next message does
    heads = tree.where((F.col("mid") == F.col("segment")) & F.col("parent").isNotNull()).select("mid", "parent", "place")
    if heads.limit(1).count():
        continued = tree.where(F.col("parent") == F.col("previous")).select(F.col("parent").alias("mid")).distinct()
        firsts = heads.join(continued, heads.parent == continued.mid, "left_anti").groupBy("parent").agg(F.min_by("mid", "place").alias("first"))
        of = tree.select(F.col("mid").alias("parent"), F.col("segment").alias("up"), F.col("place").alias("parent_place"))
        steps = heads.join(of, "parent").join(firsts, "parent", "left").withColumn("goes_on", F.coalesce(F.col("mid") == F.col("first"), F.lit(False)))
        # a continuing segment adds nothing to the path; a branch adds the message it answers and its own first place
        added = F.when(F.col("goes_on"), F.array().cast("array<bigint>")).otherwise(F.array(F.col("parent_place"), F.col("place")))
        nodes = steps.select(F.col("mid").alias("node"), "up", F.lit(None).cast("bigint").alias("top"), added.alias("path"))
        roots = tree.where((F.col("mid") == F.col("segment")) & F.col("parent").isNull()).select(F.col("mid").alias("node"), F.lit(None).cast("bigint").alias("up"), F.col("mid").alias("top"), F.array().cast("array<bigint>").alias("path"))
        paths = _doubled(scratch, nodes.unionByName(roots), "paths").select(F.col("node").alias("segment"), "path")
        keyed = tree.join(paths, "segment").select("mid", "conv", F.concat("path", F.array("place")).alias("key"))
        inside = Window.partitionBy("conv", "range").orderBy("at")
        position = _running(_ranges(scratch, keyed, [F.col("key").asc()], "keyed"), {"place": F.row_number().over(inside).cast("long")}, {"place": F.count("*")})
        position = position.select("mid", F.col("place").alias("position"))
    else:
        position = tree.select("mid", F.col("place").alias("position"))

    bodies = parts.where("level = 0").groupBy("mid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("body"))
    quoted = parts.select("mid").distinct().join(bodies, "mid", "left").select("mid", F.coalesce("body", F.lit("")).alias("body"))
    turns = tree.select(F.col("mid").alias("parent"), F.col("turn").alias("reply_to"))
    out = rows.drop("range").join(tree.select("mid", "parent", "linked"), "mid").join(position, "mid").join(turns, "parent", "left").join(quoted, "mid", "left")
    body = F.trim(F.coalesce("body", "text", F.lit("")))
    return out.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        "reply_to",
        F.col("linked").isNotNull().alias("linked"),
        "position",
        body.alias("body"),
        F.format_string(turn_format, F.coalesce("role", F.lit("user")), body).alias("formatted"),
    )
