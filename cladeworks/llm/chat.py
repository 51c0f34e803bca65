"""Chat formatting on a prefix tree of conversations.

Conversations that begin with the same turns share the nodes of those turns.
The packed output is one stream of characters in depth-first order in which
each node stands once. A node carries the position id of its first character
(the number of characters before it on its own path, so that every branch
counts on from its parent) and the stretches of the stream that its ancestors
occupy, merged where they touch: with them a character attends to its
ancestors and to the earlier characters of its own node, and to no sibling.

A turn is written ``### role: text </turn>\\n``. A backslash goes before each
backslash, ``#`` and ``<`` of a text (in roles also before ``:``), so the
strings that mark turns cannot occur inside one, and removing one backslash
restores every text. The text of each assistant turn is under the loss mask.

Scale: a node is known by the exclusive or of its turns' 128-bit keys, which a
running window gives without gathering a conversation. Depth-first order is
the order of the conversations' turn keys: a range partitioning of short key
strings. Offsets are running sums inside ranges plus the totals of the ranges
before them. Nodes that a third of all conversations share cost one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.plans.lineage import materialise

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"


def _escape(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{also}])", r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its node, formatted segment, and the characters before it on its path."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    path = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(path) - 1)
    head = F.concat(F.lit(OPEN), _escape(F.col("role"), ":"), F.lit(MIDDLE))
    body = _escape(F.col("text"))
    rows = rows.select(
        "conv_id", "depth", "role", F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        F.when(F.col("role") == "assistant", F.struct(F.length(head).alias("from"), (F.length(head) + F.length(body)).alias("to"))).alias("loss"),
        F.xxhash64("depth", "role", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "role", "depth").alias("k2"),
    )
    run = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("segment").cast("long")
    return rows.select(
        "conv_id", "depth", "role", "segment", "loss", "k1", size.alias("size"), F.bit_xor("k1").over(run).alias("n1"), F.bit_xor("k2").over(run).alias("n2"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("position"),
    )


def _order(rows: DataFrame) -> DataFrame:
    """``(conv_id, range, place)``: depth-first order of the conversations, by range and place inside it."""
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "k1"))), lambda t: F.lpad(F.hex(t["k1"]), 16, "0")), "")
    paths = rows.groupBy("conv_id").agg(keys.alias("path"))
    ranged = materialise(paths.repartitionByRange("path", "conv_id").withColumn("range", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("range").orderBy("path", "conv_id"))
    return ranged.select("conv_id", "range", (F.shiftleft(F.col("range").cast("long"), 40) + place).alias("place"))


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, members)`` of the packed output.

    nodes: ``start, stop`` (its stretch of the stream), ``parent`` (start of
    the parent, null for a first turn), ``depth``, ``role``, ``segment``,
    ``position`` (position id of its first character), ``loss_start,
    loss_stop`` (null outside assistant turns) and ``attention``, the merged
    stretches of its ancestors. members: ``conv_id, depth, start``, the path
    of every conversation.

    Turns go by turn number, then role, then text, nulls first; repeated rows
    are repeated turns. A null role or text is empty. Rows without a conv_id
    take no part. Other columns are ignored; an empty table gives empty
    results.
    """
    rows = materialise(turns(conversations))
    order = _order(rows)
    slim = rows.select("conv_id", "depth", "n1", "n2", "size").join(order, "conv_id")
    first = slim.groupBy("depth", "n1", "n2").agg(F.min("place").alias("owner"), F.max("size").alias("size"))
    first = first.withColumn("range", F.shiftright("owner", 40))
    before = Window.partitionBy("range").orderBy("owner", "depth").rowsBetween(Window.unboundedPreceding, -1)
    inside = materialise(first.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")))
    totals = inside.groupBy("range").agg(F.sum("size").alias("total"))  # one row per range partition
    base = totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = inside.join(base, "range").select("depth", "n1", "n2", "owner", (F.col("base") + F.col("offset")).alias("start"), (F.col("base") + F.col("offset") + F.col("size")).alias("stop"))
    members = materialise(slim.join(placed, ["depth", "n1", "n2"]).select("conv_id", "depth", "start", "stop", (F.col("place") == F.col("owner")).alias("owns")))

    path = Window.partitionBy("conv_id").orderBy("depth")
    walked = members.select("*", F.lag("start").over(path).alias("parent"), F.coalesce(F.col("start") != F.lag("stop").over(path), F.lit(True)).alias("jump"))
    walked = walked.withColumn("run", F.sum(F.col("jump").cast("int")).over(path.rowsBetween(Window.unboundedPreceding, 0)))
    runs = walked.groupBy("conv_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    owned = walked.where("owns").select("conv_id", "depth", "start", "stop", "parent").join(runs, "conv_id").join(
        rows.select("conv_id", "depth", "role", "segment", "position", "loss"), ["conv_id", "depth"]
    )
    attention = F.expr("transform(filter(runs, r -> r.start < start), r -> struct(r.start as start, least(r.stop, start) as stop))")
    nodes = owned.select(
        "start", "stop", "parent", "depth", "role", "segment", "position",
        (F.col("start") + F.col("loss.from")).alias("loss_start"), (F.col("start") + F.col("loss.to")).alias("loss_stop"), attention.alias("attention"),
    )
    return nodes, members.select("conv_id", "depth", "start")


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Every conversation as read from the packed output alone: ``(conv_id, turns array<struct<depth, role, text, loss, size>>)``.

    Role and text come from the marks of the segment, loss from the loss
    stretch; both without their backslashes.
    """
    inner = F.expr(f"substring(segment, {len(OPEN) + 1}, length(segment) - {len(OPEN) + len(CLOSE)})")
    role = F.regexp_extract("inner", r"(?s)^((?:[^\\:]++|\\.)*+): ", 1)
    rows = nodes.select("start", "segment", inner.alias("inner"), "loss_start", "loss_stop").withColumn("role", role)
    text = F.expr(f"substring(inner, length(role) + {len(MIDDLE) + 1})")
    loss = F.expr("substring(segment, cast(loss_start - start + 1 as int), cast(loss_stop - loss_start as int))")
    parsed = rows.select("start", _unescape(F.col("role")).alias("role"), _unescape(text).alias("text"), F.coalesce(_unescape(loss), F.lit("")).alias("loss"), F.length("segment").alias("size"))
    joined = members.join(parsed, "start")
    return joined.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text", "loss", "size"))).alias("turns"))


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the packed output: turn, loss and size digests."""
    back = read_back(*prefix_tree(conversations))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.expr("aggregate(turns, 0L, (a, t) -> a + t.size)").alias("formatted_chars"),
    )
