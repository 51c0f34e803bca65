"""Consequences of variants in genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions import sequence as sq
from cladeworks.operators.features import encode
from cladeworks.operators.genome import Chunks, gene_chunks, reference_chunks, with_bases  # noqa: F401
from cladeworks.plans.lineage import materialise


def snp_consequences(snps: DataFrame, chunks: Chunks) -> DataFrame:
    """``(sample_id, gene, aa_pos, aa_ref, aa_alt)`` from ``(sample_id, gene, start_pos, end_pos, strand, pos, alt)``.

    All changed bases of a codon count together; codons that stay the same
    amino acid go. Of several bases at one position the greatest counts.
    """
    codon = sq.feature_position(F.col("pos"), F.col("start_pos"), F.col("end_pos"), F.col("strand"), F.lit("Gene"))
    rows = snps.withColumn("aa_pos", codon).withColumn("at", sq.codon_start(F.col("aa_pos"), F.col("start_pos"), F.col("end_pos"), F.col("strand")))
    alt = lambda i: F.max(F.when(F.col("pos") - F.col("at") == i, F.col("alt"))).alias(f"a{i}")
    codons = rows.groupBy("sample_id", "gene", "strand", "aa_pos", "at").agg(alt(0), alt(1), alt(2))
    codons = with_bases(codons, F.col("at"), F.lit(3), chunks, "ref")
    new = F.concat(*[F.coalesce(f"a{i}", F.substring("ref", i + 1, 1)) for i in range(3)])
    along = lambda c: F.when(F.col("strand") == 1, c).otherwise(sq.reverse_complement(c))
    out = codons.select("sample_id", "gene", "aa_pos", sq.amino_acid(along(F.col("ref"))).alias("aa_ref"), sq.amino_acid(along(new)).alias("aa_alt"))
    return out.where("aa_ref <> aa_alt")


def early_stops(consequences: DataFrame, lengths: DataFrame, share: float = 0.9) -> DataFrame:
    """``(sample_id, gene, stop)``: the first stop that lies before ``share`` of the gene's codons."""
    stops = consequences.where("aa_alt = '*'").join(lengths, "gene").where(F.col("aa_pos") < share * F.col("codons"))
    return stops.groupBy("sample_id", "gene").agg(F.min("aa_pos").alias("stop"))


def frameshifts(calls: DataFrame) -> DataFrame:
    """``(sample_id, gene, shift)``: genes whose inserted minus deleted bases are no multiple of three."""
    change = F.when(F.col("vtype") == "ins", F.length("alt")).when(F.col("vtype") == "del", -1).otherwise(0)
    return calls.groupBy("sample_id", "gene").agg(F.pmod(F.sum(change), F.lit(3)).cast("long").alias("shift")).where("shift <> 0")


def repaired_genes(genes: DataFrame, chunks: Chunks) -> DataFrame:
    """``(name, fixed_start, fixed_end)`` of genes whose length is no multiple of three and who stop at a codon beside their end.

    The end along the strand moves back to the last whole codon if that is a stop, else on to the next codon if that is; genes with neither
    keep their bounds and have nulls.
    """
    odd = genes.withColumn("m", ((F.col("end_pos") - F.col("start_pos") + 1) % 3).cast("int")).where("m <> 0 and end_pos - start_pos >= 2")
    first = F.when(F.col("strand") == 1, F.col("end_pos") - F.col("m") - 2).otherwise(F.col("start_pos") + F.col("m") - 3)
    rows = with_bases(odd.withColumn("first", first), F.col("first"), F.lit(6), chunks, "tail")
    tail = F.when(F.col("strand") == 1, F.col("tail")).otherwise(sq.reverse_complement(F.col("tail")))
    stop = lambda i: sq.amino_acid(F.substring(tail, i, 3)) == "*"
    shift = F.when(stop(1), -F.col("m")).when(stop(4), 3 - F.col("m"))
    rows = rows.withColumn("shift", shift)
    moved = lambda plus, own, by: F.when(F.col("shift").isNotNull(), F.when((F.col("strand") == 1) == F.lit(plus), own + by).otherwise(own))
    return rows.select("name", moved(False, F.col("start_pos"), -F.col("shift")).alias("fixed_start"), moved(True, F.col("end_pos"), F.col("shift")).alias("fixed_end"))


def decompose(pairs: DataFrame) -> DataFrame:
    """``(key, off, ref, alt, vtype)`` from ``(key, ref, alt)``: common suffix, then prefix taken off; the rest as single changes, leftmost.

    Distinct pairs are taken apart once and joined back.
    """
    distinct = pairs.select("ref", "alt").distinct()
    cut = distinct.withColumn("s", sq.common_suffix(F.col("ref"), F.col("alt")))
    cut = cut.withColumn("r", F.expr("left(ref, length(ref) - s)")).withColumn("a", F.expr("left(alt, length(alt) - s)"))
    cut = cut.withColumn("p", sq.common_prefix(F.col("r"), F.col("a")))
    cut = cut.select("ref", "alt", "p", F.expr("substring(r, p + 1)").alias("r"), F.expr("substring(a, p + 1)").alias("a"))
    both = F.least(F.length("r"), F.length("a"))
    at = lambda c, i: F.substring(c, i, F.lit(1))
    event = "struct<off:int,ref:string,alt:string,vtype:string>"
    same = F.when(both > 0, F.filter(F.transform(F.sequence(F.lit(1), both), lambda i: F.struct((F.col("p") + i - 1).cast("int").alias("off"), at(F.col("r"), i).alias("ref"), at(F.col("a"), i).alias("alt"), F.lit("snp").alias("vtype"))), lambda e: e["ref"] != e["alt"])).otherwise(F.array().cast(f"array<{event}>"))
    gone = F.when(F.length("r") > both, F.transform(F.sequence(both + 1, F.length("r")), lambda i: F.struct((F.col("p") + i - 1).cast("int").alias("off"), at(F.col("r"), i).alias("ref"), F.lit("").alias("alt"), F.lit("del").alias("vtype")))).otherwise(F.array().cast(f"array<{event}>"))
    more = F.when(F.length("a") > both, F.array(F.struct((F.col("p") + both).cast("int").alias("off"), F.lit("").alias("ref"), F.expr("substring(a, least(length(r), length(a)) + 1)").alias("alt"), F.lit("ins").alias("vtype")))).otherwise(F.array().cast(f"array<{event}>"))
    events = cut.select("ref", "alt", F.explode(F.concat(same, gone, more)).alias("e")).select(F.col("ref").alias("_ref"), F.col("alt").alias("_alt"), "e.*")
    return pairs.join(events, (pairs["ref"] == events["_ref"]) & (pairs["alt"] == events["_alt"])).select("key", "off", events["ref"], events["alt"], "vtype")


def wide_rows(cells: DataFrame, places: DataFrame, rows: DataFrame, row: str, place: str, width: int = 256, group: int = 1024) -> DataFrame:
    """``(row, block, line)``: the lines of a wide table in stretches of ``width`` places, for a sink that writes them one behind the other.

    ``places (place, value)`` are all places with what stands there by default, one character each, ``cells (row, place, value)`` what differs,
    ``rows (row)`` the rows. Places are numbered in their order; no list is longer than a stretch, or than a stretch of ``group`` rows.

    The table has as many lines as rows times stretches, so no line is shuffled: rows stand in groups, what is shuffled is one line of defaults for
    each stretch and group with the cells that differ there, and lines are made from it inside the tasks. A row without such a cell takes the defaults
    as they are.
    """
    codes = materialise(encode(places.select(F.col(place).alias("feature"))).select(F.col("feature").alias(place), F.floor(F.col("code") / width).alias("block"), (F.col("code") % width).cast("int").alias("at")))
    listed = F.sort_array(F.collect_list(F.struct("at", "value")))
    usual = places.join(codes, place).groupBy("block").agg(F.array_join(F.transform(listed, lambda s: s["value"]), "").alias("_usual"))
    numbered = materialise(encode(rows.select(F.col(row).alias("feature"))).select(F.col("feature").alias(row), F.floor(F.col("code") / group).alias("_group")))
    members = numbered.groupBy("_group").agg(F.collect_list(row).alias("_members"))
    named = cells.where(F.col("value").isNotNull()).join(codes, place).join(numbered, row)
    own = named.groupBy("block", "_group").agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), "at", "value"))).alias("_own"))
    grid = usual.withColumn("_last", numbered.agg(F.max("_group")).scalar()).where("_last is not null").select("block", "_usual", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_group"))
    # Cells stand in the order of rows, so the first ones of the rows part them; those of a row are put in one by one.
    starts = F.expr("filter(sequence(0, size(_own) - 1), i -> i = 0 or _own[i].r <> _own[i - 1].r)")
    both = materialise(grid.join(own, ["block", "_group"], "left").withColumn("_starts", F.when(F.col("_own").isNotNull(), starts)))  # read twice
    made = """transform(_starts, (a, i) -> named_struct('r', _own[a].r, 'line',
     aggregate(slice(_own, a + 1, coalesce(get(_starts, i + 1), size(_own)) - a), _usual, (l, c) -> overlay(l placing c.value from c.at + 1 for 1))))"""
    changed = both.where("_own is not null").select("block", F.explode(F.expr(made)).alias("_c")).select(F.col("_c.r").alias(row), "block", F.col("_c.line").alias("line"))
    firsts = F.transform(F.coalesce("_starts", F.array().cast("array<int>")), lambda a: F.get(F.col("_own"), a)["r"])
    rest = both.withColumn("_r", firsts).select("_group", "block", "_usual", "_r").join(members, "_group").select("block", "_usual", F.array_except("_members", "_r").alias("_rest"))
    same = rest.select(F.explode("_rest").alias(row), "block", F.col("_usual").alias("line"))
    return changed.union(same)


def site_rows(cells: DataFrame, by: list[str], place: str = "pos", width: int = 256) -> DataFrame:
    """``(*by, block, row)``: a character per site of a stretch of ``width`` places, in order, ``-`` where a row has none.

    ``cells`` has ``by``, ``place`` and ``base``; the first of ``by`` names the row, the others the alignment. Sites are those that any
    row has; a stretch in which a row has no base is left out. No list is longer than ``width``.
    """
    block = F.floor(F.col(place) / width).cast("long").alias("block")
    sites = cells.select(*by[1:], block, F.col(place).alias("at")).distinct().groupBy(*by[1:], "block").agg(F.array_sort(F.collect_set("at")).alias("sites"))
    own = cells.groupBy(*by, block).agg(F.map_from_entries(F.collect_list(F.struct(F.col(place), "base"))).alias("own"))
    row = F.transform("sites", lambda at: F.coalesce(F.element_at("own", at), F.lit("-")))
    return own.join(sites, [*by[1:], "block"]).select(*by, "block", F.array_join(row, "").alias("row"))


def interleave(codes: DataFrame, n: int) -> DataFrame:
    """``(pos, split, place)`` from ``(pos, code)``, sites numbered in order: columns dealt in turn to ``n`` alignments."""
    return codes.select("pos", (F.col("code") % n).cast("int").alias("split"), F.floor(F.col("code") / n).cast("long").alias("place"))
