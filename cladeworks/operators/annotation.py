"""From called variants to annotated ones: ``(sample_id, ftype, gene, gpos, ref, alt, vtype)``.

Calls go one of three ways. Coding genes that have only single-base changes in a sample give changed amino acids. Coding
genes with an insertion or deletion are rebuilt and translated, and the difference of the proteins gives the rows. All
other calls, in RNA, upstream, in pseudogenes or outside any feature, keep their bases. A gene that lost its start or
stop, or is shorter than 90 % of what it was, has one row ``FS`` in place of all others, without a position.

``-`` stands for no bases; positions are amino acids in coding genes and count along the strand elsewhere. What lies
outside any feature is ``non_cds``, gene ``-``, counted on the reverse strand of the whole reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.functions import sequence as sq
from cladeworks.operators import islands
from cladeworks.operators.consequence import early_stops, snp_consequences
from cladeworks.operators.genome import reference_chunks, reference_length, with_bases
from cladeworks.plans.lineage import materialise

ROW = ("sample_id", "ftype", "gene", "gpos", "ref", "alt", "vtype")
_FEATURE = ("ftype", "gene", "start_pos", "end_pos", "strand")


def _along(seq: Column) -> Column:
    return F.when(F.col("strand") == 1, seq).otherwise(sq.reverse_complement(seq))


def protein_changes(proteins: DataFrame) -> DataFrame:
    """One row for each change from ``old`` to ``new``: the shared end and then the shared start come off; what is left is compared place by place.

    ``(…, gpos, ref, alt, vtype)``: replaced amino acids one by one, what is left over as one deletion or insertion.
    """
    keep = [c for c in proteins.columns if c not in ("old", "new")]
    cut = proteins.where("old <> new").withColumn("s", sq.common_suffix(F.col("old"), F.col("new")))
    cut = cut.select(*keep, F.expr("left(old, length(old) - s)").alias("old"), F.expr("left(new, length(new) - s)").alias("new"))
    cut = cut.withColumn("p", sq.common_prefix(F.col("old"), F.col("new")))
    cut = cut.select(*keep, "p", F.expr("substring(old, p + 1)").alias("r"), F.expr("substring(new, p + 1)").alias("a"))
    event = "struct<gpos:int,ref:string,alt:string,vtype:string>"
    rows = F.expr(f"""concat(
     if(least(length(r), length(a)) = 0, cast(array() as array<{event}>), filter(transform(sequence(1, least(length(r), length(a))),
      i -> named_struct('gpos', p + i, 'ref', substring(r, i, 1), 'alt', substring(a, i, 1), 'vtype', 'snp')), e -> e.ref <> e.alt)),
     if(length(r) > length(a), array(named_struct('gpos', p + length(a) + 1, 'ref', substring(r, length(a) + 1), 'alt', '-', 'vtype', 'del')), cast(array() as array<{event}>)),
     if(length(a) > length(r), array(named_struct('gpos', p + length(r) + 1, 'ref', '-', 'alt', substring(a, length(r) + 1), 'vtype', 'ins')), cast(array() as array<{event}>)))""")
    return cut.select(*keep, F.explode(rows).alias("e")).select(*keep, F.col("e.gpos").cast("long").alias("gpos"), "e.ref", "e.alt", "e.vtype")


#: Of several changes of one base the deletion counts, else the greatest base; insertions stand before their base.
_KEPT = "filter(edits, (e, i) -> e.kind = 0 or i = size(edits) - 1 or edits[i + 1].off <> e.off)"
_PIECES = """transform(edits, (e, i) -> concat(substring(ref, if(i = 0, 0, edits[i - 1].off - if(edits[i - 1].kind = 0, 1, 0)) + 1,
 e.off - 1 - if(i = 0, 0, edits[i - 1].off - if(edits[i - 1].kind = 0, 1, 0))), e.alt))"""
_TAIL = "substring(ref, edits[size(edits) - 1].off - if(edits[size(edits) - 1].kind = 0, 1, 0) + 1)"


def changed_genes(calls: DataFrame) -> DataFrame:
    """``(sample_id, gene, start_pos, end_pos, strand, edits)``: the sorted changes of each gene of a sample that has an insertion or deletion."""
    kind = F.when(F.col("vtype") == "ins", 0).when(F.col("vtype") == "del", 2).otherwise(1)
    edit = F.struct((F.col("pos") - F.col("start_pos") + 1).cast("int").alias("off"), kind.alias("kind"), F.when(F.col("vtype") == "del", "").otherwise(F.col("alt")).alias("alt"))
    own = calls.groupBy("sample_id", "gene", "start_pos", "end_pos", "strand").agg(F.array_sort(F.collect_set(edit)).alias("edits"), F.max((F.col("vtype") != "snp").cast("int")).alias("indel"))
    return own.where("indel = 1").drop("indel")


def indel_consequences(calls: DataFrame, reference: DataFrame) -> DataFrame:
    """``(sample_id, gene, gpos, ref, alt, vtype)`` of coding genes with an insertion or deletion; FS rows have no position.

    ``calls (sample_id, gene, start_pos, end_pos, strand, pos, alt, vtype)``. Each distinct set of changes of a gene is worked out once: the
    reference is cut between the sorted changes and their bases are put in, in one pass. A length that is no multiple of three is filled up from
    beyond the end of the gene (on the minus strand, before its start). Genes whose own length is no multiple of three, and genes beyond the
    reference, have no row. The protein starts at the first M or first amino acid of the old one before the first stop, and ends there.
    """
    own = materialise(changed_genes(calls))
    size, flank = F.col("end_pos") - F.col("start_pos") + 1, F.least(F.lit(2), F.col("start_pos") - 1)
    distinct = own.drop("sample_id").distinct().where(size % 3 == 0).withColumn("flank", flank.cast("int")).withColumn("size", size.cast("int"))
    found = with_bases(distinct, F.col("start_pos") - F.col("flank"), F.col("size") + F.col("flank") + 2, reference_chunks(reference, 1 << 16, 1 << 15), "window", least=F.col("size") + F.col("flank"))
    found = found.withColumn("ref", F.expr("substring(window, flank + 1, size)")).withColumn("edits_", F.col("edits")).withColumn("edits", F.expr(_KEPT))
    built = found.withColumn("seq", F.concat(F.array_join(F.expr(_PIECES), ""), F.expr(_TAIL)))
    fill = F.expr("(3 - length(seq) % 3) % 3")
    built = built.withColumn("fill", fill).withColumn("seq", F.when(F.col("strand") == 1, F.concat("seq", F.expr("substring(window, flank + size + 1, fill)"))).otherwise(F.concat(F.expr("right(left(window, flank), fill)"), "seq")))
    made = built.select("gene", "start_pos", F.col("edits_").alias("edits"), sq.protein(_along(F.col("ref"))).alias("old"), sq.protein(_along(F.col("seq"))).alias("new"))
    made = made.withColumn("stop", F.instr("new", "*")).withColumn("head", F.expr("left(new, stop)"))
    place = lambda x: F.nullif(F.instr(F.col("head"), x), F.lit(0))
    made = materialise(made.withColumn("start", F.least(place(F.expr("left(old, 1)")), place(F.lit("M")))))
    broken = F.col("start").isNull() | (10 * (F.col("stop") - F.col("start")) < 9 * F.length("old"))
    whole = made.where(~broken).select("gene", "start_pos", "edits", F.expr("left(old, length(old) - 1)").alias("old"), F.expr("substring(new, start, stop - start)").alias("new"))
    lost = made.where(broken).select("gene", "start_pos", "edits", F.lit(None).cast("long").alias("gpos"), F.lit("-").alias("ref"), F.lit("-").alias("alt"), F.lit("FS").alias("vtype"))
    return own.select("sample_id", "gene", "start_pos", "edits").join(protein_changes(whole).union(lost), ["gene", "start_pos", "edits"]).select("sample_id", "gene", "gpos", "ref", "alt", "vtype")


def snp_rows(calls: DataFrame, reference: DataFrame) -> DataFrame:
    """As ``indel_consequences``, for genes with single-base changes only: an early stop replaces the gene's other rows by FS."""
    changed = materialise(snp_consequences(calls, reference_chunks(reference)))
    lengths = calls.select("gene", F.floor((F.col("end_pos") - F.col("start_pos") + 1) / 3).alias("codons")).distinct()
    broken = early_stops(changed, lengths).select("sample_id", "gene")
    whole = changed.join(broken, ["sample_id", "gene"], "left_anti").select("sample_id", "gene", F.col("aa_pos").alias("gpos"), F.col("aa_ref").alias("ref"), F.col("aa_alt").alias("alt"), F.lit("snp").alias("vtype"))
    return whole.union(broken.select("sample_id", "gene", F.lit(None).cast("long"), F.lit("-"), F.lit("-"), F.lit("FS")))


def noncoding_rows(calls: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of calls outside coding genes; adjacent deleted bases are one row."""
    rows = calls.select("sample_id", *_FEATURE, "pos", "alt", "vtype").distinct()
    bases = with_bases(rows.select("pos").distinct(), F.col("pos"), F.lit(1), reference_chunks(reference), "base")
    rows = materialise(rows.join(bases, "pos"))
    inside = F.when(F.col("strand") == 1, F.col("at") - F.col("start_pos") + 1).otherwise(F.col("end_pos") - F.col("at") + 1)
    before = F.when(F.col("strand") == 1, F.col("at") - F.col("end_pos") - 1).otherwise(F.col("start_pos") - F.col("at") - 1)
    gpos = F.when(F.col("ftype") == "upstream", before).otherwise(inside).alias("gpos")
    key = ["sample_id", "ftype", "gene"]
    gone = rows.where("vtype = 'del'")
    runs = islands.merge_adjacent(gone, [*key, "start_pos", "end_pos", "strand"], first="first_pos")
    held = islands.split_runs(runs.withColumn("run", F.col("first_pos")).withColumn("n", F.col("length")), "first_pos").join(gone.select(*key, "pos", "base").distinct(), [*key, "pos"])
    merged = held.groupBy("sample_id", *_FEATURE, "run", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("bases"))
    merged = merged.withColumn("at", F.when(F.col("strand") == 1, F.col("run")).otherwise(F.col("run") + F.col("n") - 1))
    gone = merged.select(*key, gpos, _along(F.col("bases")).alias("ref"), F.lit("-").alias("alt"), F.lit("del").alias("vtype"))
    rest = rows.where("vtype <> 'del'").withColumn("at", F.col("pos"))
    return gone.union(rest.select(*key, gpos, F.when(F.col("vtype") == "ins", "-").otherwise(_along(F.col("base"))), _along(F.col("alt")), "vtype"))


def annotate(calls: DataFrame, located: DataFrame, reference: DataFrame) -> DataFrame:
    """All annotated rows, each once.

    ``calls (sample_id, pos, alt, vtype)`` are all calls, ``located`` the same with the columns of their feature ``(ftype, gene, start_pos,
    end_pos, strand, is_pseudogene)``.
    """
    rows = materialise(located.select("sample_id", *_FEATURE, F.coalesce("is_pseudogene", F.lit(False)).alias("is_pseudogene"), "pos", "alt", "vtype"))
    coding = rows.where("ftype = 'Gene' and not is_pseudogene")
    shifted = coding.where("vtype <> 'snp'").select("sample_id", "gene").distinct()
    single = snp_rows(coding.join(shifted, ["sample_id", "gene"], "left_anti"), reference)
    whole = indel_consequences(coding.join(shifted, ["sample_id", "gene"], "left_semi"), reference)
    genes = single.union(whole).select("sample_id", F.lit("Gene").alias("ftype"), "gene", "gpos", "ref", "alt", "vtype")
    outside = calls.join(located.select("pos").distinct(), "pos", "left_anti")
    one = F.lit(1).cast("long")
    outside = outside.select("sample_id", F.lit("non_cds").alias("ftype"), F.lit("-").alias("gene"), one.alias("start_pos"), reference_length(reference).alias("end_pos"), F.lit(-1).alias("strand"), "pos", "alt", "vtype")
    other = rows.where("ftype <> 'Gene' or is_pseudogene").drop("is_pseudogene").unionByName(outside)
    return genes.union(noncoding_rows(other, reference).select(*ROW)).distinct()


def vocabulary(rows: DataFrame) -> DataFrame:
    """The distinct annotated variants of all samples."""
    return rows.select(*ROW[1:]).distinct()


def with_distance(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Annotated rows with the ``distance`` of replaced amino acids, from ``table (ref, alt, distance)``; null for all other rows.

    The table has a row for each pair of an alphabet (400), whatever the size of the data.
    """
    near = table.select(F.col("ref").alias("_ref"), F.col("alt").alias("_alt"), "distance")
    replaced = (F.col("ftype") == "Gene") & (F.col("vtype") == "snp") & (F.col("ref") == F.col("_ref")) & (F.col("alt") == F.col("_alt"))
    return rows.join(F.broadcast(near), replaced, "left").drop("_ref", "_alt")


def distance_features(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``(sample_id, ftype, gene, kind, gpos, value)`` from annotated rows, those outside any feature left out.

    ``site``: the distance of a replaced amino acid. ``dist``: for a coding gene the root of the sum of squares, an inserted or deleted amino acid
    counting as much as the greatest distance; for other features the number of changed bases. ``del``: first position and length of a deletion of
    two or more. A coding gene with a stop in place of an amino acid, or the other way round, or without a protein, is only ``broken``.
    """
    far = table.agg(F.max("distance")).scalar()
    inside = rows.where("ftype <> 'non_cds'")
    lost = inside.where("ftype = 'Gene' and (vtype = 'FS' or vtype = 'snp' and (ref = '*' or alt = '*'))").select("sample_id", "gene").distinct()
    broken = lost.select("sample_id", F.lit("Gene").alias("ftype"), "gene", F.lit("broken").alias("kind"), F.lit(None).cast("long").alias("gpos"), F.lit(1.0).alias("value"))
    whole = inside.join(lost.withColumn("ftype", F.lit("Gene")), ["sample_id", "ftype", "gene"], "left_anti")
    size = F.when(F.col("vtype") == "ins", F.length("alt")).when(F.col("vtype") == "del", F.length("ref")).otherwise(1)
    coding = F.col("ftype") == "Gene"
    cost = F.when(~coding, size).when(F.col("distance").isNotNull(), F.col("distance") * F.col("distance")).otherwise(size * far * far)
    priced = materialise(with_distance(whole, table).withColumn("cost", cost.cast("double")).withColumn("size", size))
    total = priced.groupBy("sample_id", "ftype", "gene").agg(F.sum("cost").alias("cost"))
    total = total.select("sample_id", "ftype", "gene", F.lit("dist"), F.lit(None).cast("long"), F.when(coding, F.sqrt("cost")).otherwise(F.col("cost")))
    sites = priced.where("distance is not null").select("sample_id", "ftype", "gene", F.lit("site"), "gpos", "distance")
    gone = priced.where("vtype = 'del' and size > 1").select("sample_id", "ftype", "gene", F.lit("del"), "gpos", F.col("size").cast("double"))
    return broken.union(total).union(sites).union(gone)


def broken_genes(rows: DataFrame) -> DataFrame:
    """``(sample_id, gene)`` of annotated rows: genes without a protein, with a stop put in or taken away, or with an insertion or deletion upstream."""
    inside = (F.col("ftype") == "Gene") & ((F.col("vtype") == "FS") | ((F.col("vtype") == "snp") & ((F.col("alt") == "*") | (F.col("ref") == "*"))))
    before = (F.col("ftype") == "upstream") & F.col("vtype").isin("ins", "del")
    return rows.where(inside | before).select("sample_id", "gene").distinct()
