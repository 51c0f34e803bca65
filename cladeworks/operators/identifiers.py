"""Resolution of identifiers: lookups in order, names inside free text, and lists of ids for one sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.plans.lineage import materialise


def first_of_list(ids: Column, sep: str = ";") -> Column:
    """The first id of a list in one cell."""
    return F.trim(F.split_part(ids, F.lit(sep), F.lit(1)))


def known(value: Column) -> Column:
    """The value, or null where it is missing, empty, ``NA`` or ``-``."""
    return F.when(~F.trim(value).isin("", "NA", "-"), F.trim(value))


def first_ids(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``(name, id)``: of several rows of a key (the first of a list) the one that comes first; ties to the smaller id."""
    rows = table.select(known(first_of_list(F.col(key))).alias("name"), known(F.col(value)).alias("id"), F.col(order).alias("_order")).where("name is not null and id is not null")
    return rows.groupBy("name").agg(F.min(F.struct("_order", "id")).alias("m")).select("name", "m.id")


def resolve_chain(rows: DataFrame, own: str, lookups: list[tuple[str, DataFrame]]) -> DataFrame:
    """``rows`` with ``id`` and ``via``: a row's own id, or what the lookup of its first known key gives.

    ``lookups`` are (column, table ``(name, id)``) in order. The first column that is known decides: where its table lacks the name the id is null
    and ``via`` still names the column; ``via`` is null if nothing is known.
    """
    out, decided = rows.withColumn("_own", known(F.col(own))), F.col("_own").isNotNull()
    found, via = F.col("_own"), F.when(decided, F.lit(own))
    for i, (column, table) in enumerate(lookups):
        asked = F.when(~decided, known(first_of_list(F.col(column))))
        out = out.withColumn(f"_key{i}", asked).join(table.select(F.col("name").alias(f"_key{i}"), F.col("id").alias(f"_id{i}")), f"_key{i}", "left")
        found, via = F.coalesce(found, f"_id{i}"), F.coalesce(via, F.when(F.col(f"_key{i}").isNotNull(), F.lit(column)))
        decided = decided | known(first_of_list(F.col(column))).isNotNull()
    return out.select(*rows.columns, found.alias("id"), via.alias("via"))


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct substrings of the given lengths."""
    own = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[own(n) for n in sizes])))


def names_in_lines(names: DataFrame, lines: DataFrame, size: int = 6) -> DataFrame:
    """``(name, row_idx)``: every line that contains a name, from ``names (name)`` and ``lines (row_idx, line)``.

    A name asks for the lines that hold its rarest substring of ``size`` characters (a shorter name, for itself), and ``contains`` decides. Only
    substrings of names are counted, equal lines are searched once. Empty and null names are in no line.
    """
    names = materialise(names.select("name").where("name <> ''").distinct())
    texts = materialise(lines.where("line is not null").groupBy("line").agg(F.min("row_idx").alias("_first")))
    asked = materialise(names.select("name", F.explode(_grams(F.col("name"), [size])).alias("gram")).union(names.where(F.length("name") < size).select("name", "name")))
    wanted = asked.select("gram").distinct()
    held = texts.select("line", F.explode(_grams(F.col("line"), list(range(1, size + 1)))).alias("gram")).join(wanted, "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("name", "g.gram")
    rarest = materialise(rarest)
    places = texts.select("line", F.explode(_grams(F.col("line"), list(range(1, size + 1)))).alias("gram")).join(rarest.select("gram").distinct(), "gram", "left_semi")
    hits = rarest.join(places, "gram").where(F.contains("line", "name")).select("name", "line")
    return hits.join(lines.select("row_idx", "line"), "line").select("name", "row_idx")


def first_line(names: DataFrame, lines: DataFrame) -> DataFrame:
    """``(name, row_idx)``: the first line that contains each name, null if none does."""
    found = names_in_lines(names, lines).groupBy("name").agg(F.min("row_idx").alias("row_idx"))
    return names.select("name").distinct().join(found, "name", "left")


def standard_names(names: DataFrame, lines: DataFrame, exclude: DataFrame, standard: str) -> DataFrame:
    """``(name, id, status)`` of every distinct name.

    ``kept``: it holds the pattern ``standard`` already; ``excluded``: it is in ``exclude (name)``; both keep their name. ``renamed``: ``lines
    (row_idx, line, id)`` has an id in the first line that contains it; ``repeat``: an earlier name, kept names before all, has that id;
    ``unmatched``: no line contains it. Names come in their own order.
    """
    every = names.select("name").where("name is not null").distinct().join(exclude.select("name").distinct().withColumn("_out", F.lit(True)), "name", "left")
    kept = every.where(F.col("name").rlike(standard)).select("name", F.col("name").alias("id"), F.lit("kept").alias("status"))
    rest = materialise(every.where(~F.col("name").rlike(standard)))
    out = rest.where("_out").select("name", F.col("name").alias("id"), F.lit("excluded").alias("status"))
    asked = first_line(rest.where("_out is null").select("name"), lines.select("row_idx", "line"))
    found = asked.join(lines.groupBy("row_idx").agg(F.min("id").alias("id")), "row_idx", "left").select("name", "row_idx", "id")
    taken = kept.select("id", F.lit(True).alias("_taken"))
    ranked = found.where("row_idx is not null").join(taken, "id", "left")
    first = ranked.groupBy(F.col("id").alias("_id")).agg(F.min("name").alias("_first"))
    status = F.when(F.col("_taken") | (F.col("name") != F.col("_first")), "repeat").otherwise("renamed")
    renamed = ranked.join(first, F.col("id").eqNullSafe(F.col("_id"))).select("name", "id", F.coalesce(status, F.lit("renamed")).alias("status"))
    lost = found.where("row_idx is null").select("name", "id", F.lit("unmatched").alias("status"))
    return reduce(DataFrame.union, [kept, out, renamed, lost])


def listed_members(groups: DataFrame, listed: DataFrame, sep: str = ";") -> DataFrame:
    """``(grp, member, kept)``: of each list of two or more ids the last one that is ``listed (id)`` is kept; lists without any give no rows."""
    rows = groups.where(F.contains("members", F.lit(sep))).select("grp", F.posexplode(F.split("members", sep, -1)).alias("place", "member")).withColumn("member", F.trim("member"))
    known_ids = listed.select(F.col("id").alias("member")).distinct().withColumn("_in", F.lit(True))
    rows = rows.join(known_ids, "member", "left")
    chosen = F.max_by("member", F.when(F.col("_in"), F.col("place"))).over(Window.partitionBy("grp"))
    return rows.withColumn("_kept", F.when(F.max("_in").over(Window.partitionBy("grp")), chosen)).where("_kept is not null").select("grp", "member", (F.col("member") == F.col("_kept")).alias("kept"))
