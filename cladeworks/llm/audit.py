"""How document filters overlap, for every order in which they could run.

Five filters judge whole texts (a null text is empty; words are the maximal runs without a blank, a tab or a line
break, case-sensitive). A document fails A with fewer than 200 words, B if fewer than half of its words are distinct,
C if more than 3 % of its code points are A-Z, D if it holds one of ``#$%&*|``, and E if a document with a smaller id
has the very same text.

Each filter has a stored table of the ids that fail it, and so have the two labels. Survivors of a prefix are ids
left by left-anti joins with the tables of its filters, removals are failing ids left by the same joins, redundant
ids are failing ids found by a left-semi join with the tables of the prefix, and label losses are removals that a
left-semi join finds among the labelled ids. What a prefix leaves doesn't depend on the order of its filters, so 32
sets of filters stand for all prefixes of the 120 orders, and rows that are alike in id, language and text are one id
with a count. Ids are dealt once; the sets are spread inside the tasks.

Defined results: an empty table gives no rows; a null id never fails E and has no label; an id with several label rows
has a label if any row gives it; rows that repeat an id count one by one.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.plans.lineage import materialise

FILTERS = "ABCDE"
BITS = {f: 1 << i for i, f in enumerate(FILTERS)}


def _digest(value: Column) -> Column:
    """The first 128 bits of the SHA-256 digest."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def profiles(docs: DataFrame) -> DataFrame:
    """``(doc, doc_id, part, text_key, fails, n)``: ids with the bits of the filters A to D that they fail, and their number of rows.

    ``doc`` stands for id, language and text; ``text_key`` for the text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("w"))
    conditions = {
        "A": F.size("w") < 200,
        "B": 100 * F.size(F.array_distinct("w")) < 50 * F.size("w"),
        "C": 100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")) > 3 * F.length("t"),
        "D": F.col("t").rlike("[#$%&*|]"),
    }
    fails = sum((F.when(c, BITS[f]).otherwise(0) for f, c in conditions.items()), F.lit(0))
    rows = rows.select("doc_id", "part", _digest(F.col("t")).alias("text_key"), fails.alias("fails"))
    doc = _digest(F.concat(F.hex("text_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("part")))
    return rows.select(doc.alias("doc"), "*").groupBy("doc", "doc_id", "part", "text_key", "fails").agg(F.count(F.lit(1)).alias("n"))


def id_tables(docs: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Stored tables ``(doc, part, n)``: all ids, those that fail each filter, and those with each label."""
    ids = materialise(profiles(docs))
    tables = {"all": ids}
    for f in "ABCD":
        tables[f] = ids.where(F.col("fails").bitwiseAND(BITS[f]) != 0)
    known = ids.where("doc_id is not null")
    first = known.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    tables["E"] = known.join(first, ["text_key", "doc_id"], "left_anti")
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        tables[name] = known.join(labels.where(F.col(column) == 1).select("doc_id").distinct(), "doc_id", "left_semi")
    stored = {name: t.select("doc", "part", "n") for name, t in tables.items()}
    return {name: t if name == "all" else materialise(t) for name, t in stored.items()}


def _without(rows: DataFrame, tables: dict[str, DataFrame], own: str | None = None) -> DataFrame:
    """``rows`` for every set of filters (bits in ``prefix``) that removes none of them; never with the filter named in column ``own``.

    Before the join with a filter's table, a row is spread to the sets without and with the filter; the join takes those with it.
    """
    rows = rows.withColumn("prefix", F.lit(0))
    for f, bit in BITS.items():
        both = F.array("prefix", F.col("prefix") + bit)
        rows = rows.withColumn("prefix", F.explode(both if own is None else F.when(F.col(own) == f, F.array("prefix")).otherwise(both)))
        failing = tables[f].select(F.col("doc").alias("failing")).hint("shuffle_hash")
        rows = rows.join(failing, (F.col("doc") == F.col("failing")) & (F.col("prefix") >= bit), "left_anti")
    return rows


def survivors(tables: dict[str, DataFrame]) -> DataFrame:
    """``(part, prefix, kept)`` for each set of filters."""
    return _without(tables["all"].repartition("doc"), tables).groupBy("part", "prefix").agg(F.sum("n").alias("kept"))


def _failing(tables: dict[str, DataFrame]) -> DataFrame:
    """``(doc, part, n, filter)``: the tables of the filters, one below the other."""
    named = [tables[f].select("doc", "part", "n", F.lit(f).alias("filter")) for f in FILTERS]
    return reduce(DataFrame.union, named)


def _bit(name: str) -> Column:
    """The bit of the filter in column ``name``."""
    return sum((F.when(F.col(name) == f, bit).otherwise(0) for f, bit in BITS.items()), F.lit(0))


def removals(tables: dict[str, DataFrame]) -> DataFrame:
    """``(part, filter, prefix, removed, good_lost, toxic_lost)`` for each filter after each set of the others."""
    failing = _failing(tables)
    kinds = failing.withColumn("kind", F.lit("removed"))
    for label in ("good", "toxic"):
        labelled = tables[label].select("doc").hint("shuffle_hash")
        kinds = kinds.union(failing.join(labelled, "doc", "left_semi").select("doc", "part", "n", "filter", F.lit(label).alias("kind")))
    left = _without(kinds.repartition("doc"), tables, "filter")
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long"))
    return left.groupBy("part", "filter", "prefix").agg(count("removed").alias("removed"), count("good").alias("good_lost"), count("toxic").alias("toxic_lost"))


def redundancies(tables: dict[str, DataFrame]) -> DataFrame:
    """``(part, filter, prefix, redundant)``: failing ids that the filters of the set before took."""
    earlier = _failing(tables).select(F.col("doc").alias("other"), _bit("filter").alias("bit")).hint("shuffle_hash")
    every = _failing(tables).repartition("doc").withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(31)))).where(F.col("prefix").bitwiseAND(_bit("filter")) == 0)
    again = every.join(earlier, (F.col("doc") == F.col("other")) & (F.col("prefix").bitwiseAND(F.col("bit")) != 0), "left_semi")
    return again.groupBy("part", "filter", "prefix").agg(F.sum("n").alias("redundant"))


def orders(parts: DataFrame) -> DataFrame:
    """``(part, filter_order, step, filter, prefix, after)`` for each part, order of the five filters and step."""
    every = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = parts.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    upto = lambda step: sum((F.when(F.instr("filter_order", f) <= step, bit).otherwise(0) for f, bit in BITS.items()), F.lit(0))
    return rows.select("part", "filter_order", "step", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)).alias("filter"), upto(F.col("step") - 1).alias("prefix"), upto(F.col("step")).alias("after"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The full report: a row for each part, order and step, with zeros."""
    tables = id_tables(docs, labels)
    kept, gone, again = (materialise(count(tables)) for count in (survivors, removals, redundancies))
    parts = kept.where("prefix = 0").select("part")
    alone = gone.where(F.col("prefix") + _bit("filter") == sum(BITS.values())).select("part", "filter", F.col("removed").alias("unique_fails"))
    rows = orders(parts).join(gone, ["part", "filter", "prefix"], "left").join(again, ["part", "filter", "prefix"], "left").join(alone, ["part", "filter"], "left")
    rows = rows.join(kept.select("part", F.col("prefix").alias("after"), "kept"), ["part", "after"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    shapley = F.sum(count("removed")).over(Window.partitionBy("part", "filter"))
    return rows.select("part", "filter_order", "step", *[count(c).alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")], shapley.alias("shapley"))
