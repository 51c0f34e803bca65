"""A reference sequence in pieces, lookups of its bases, and walks of aligned reads along it.

A reference is a table ``(at, seq)``: pieces of bases with the number of bases before each; one row ``(seq)`` is a
reference in one piece. No row ever holds more than a piece or a chunk.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.plans.lineage import discard, materialise


class Chunks(NamedTuple):
    """A reference cut into stretches of ``width`` bases that each also hold the first ``overlap`` bases of the next.

    ``parts (_chunk, start, bases)`` are what the pieces of the reference give to each chunk.
    """

    parts: DataFrame
    width: int

    def asked(self, rows: DataFrame) -> DataFrame:
        """``(_chunk, _bases)`` of the chunks that ``rows (_chunk)`` ask for, and a few more.

        A map of 2^16 bits marks the chunks that are asked for, by their number modulo 2^16, so that of a long reference only what is looked up
        is shuffled.
        """
        bit = F.col("_chunk") % (1 << 16)
        bits = rows.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(_chunk % {1 << 16} % 64 as int))")).alias("b"))
        marks = bits.where("w is not null").agg(F.map_from_entries(F.collect_list(F.struct("w", "b")))).scalar()
        near = self.parts.where(F.getbit(F.coalesce(F.element_at(marks, F.shiftright(bit, 6)), F.lit(0).cast("long")), (bit % 64).cast("int")) == 1)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "bases"))), lambda x: x["bases"]), "")
        return near.groupBy("_chunk").agg(joined.alias("_bases"))


def laid_out(pieces: DataFrame, order: str) -> DataFrame:
    """``(at, seq)`` from pieces ``(order, seq)`` laid one behind the other; equal ``order`` by ``seq``.

    Ranges of the order add up inside themselves and are shifted by the sizes of the ranges before, so no task sees all pieces.
    """
    written = materialise(pieces.select(F.col(order).alias("_order"), "seq", F.length("seq").cast("long").alias("_n")))  # ranges are found by a pass of their own
    dealt = materialise(written.repartitionByRange("_order").withColumn("_range", F.spark_partition_id()))
    inside = F.sum("_n").over(Window.partitionBy("_range").orderBy("_order", "seq").rowsBetween(Window.unboundedPreceding, -1))
    discard(written)
    sizes = dealt.groupBy("_range").agg(F.sum("_n").alias("_size"))  # one row per range
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("long")
    rows = dealt.withColumn("_inside", F.coalesce(inside, zero)).join(sizes.select("_range", F.coalesce(before, zero).alias("_before")), "_range")
    return rows.select((F.col("_before") + F.col("_inside")).alias("at"), "seq")


def reference_length(reference: DataFrame) -> Column:
    """The number of bases, as a scalar."""
    return reference.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long")).scalar()


def reference_chunks(reference: DataFrame, width: int = 4096, overlap: int = 64) -> Chunks:
    """Looking bases up in a chunk costs the chunk's size, not the genome's; a lookup may ask for ``overlap`` + 1 bases."""
    at = F.col("at").cast("long") if "at" in reference.columns else F.lit(0).cast("long")
    parts = reference.select(at.alias("at"), F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("i", "bases"))
    parts = parts.select((F.col("at") + F.col("i").cast("long") * width).alias("at"), "bases", F.length("bases").alias("n"))
    first, last = F.greatest(F.floor((F.col("at") - overlap) / width), F.lit(0)), F.floor((F.col("at") + F.col("n") - 1) / width)
    rows = parts.withColumn("_chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    start = F.greatest(F.col("at"), F.col("_chunk") * width)
    end = F.least(F.col("at") + F.col("n"), (F.col("_chunk") + 1) * width + overlap)
    rows = rows.select("_chunk", start.alias("start"), F.substring("bases", (start - F.col("at") + 1).cast("int"), (end - start).cast("int")).alias("bases")).where("bases <> ''")
    return Chunks(rows, width)


def gene_chunks(reference: DataFrame) -> Chunks:
    """Chunks for whole genes, up to 32 768 bases."""
    return reference_chunks(reference, 1 << 16, 1 << 15)


def with_bases(df: DataFrame, pos: Column, size: Column, chunks: Chunks, name: str, least: Column | None = None) -> DataFrame:
    """Column ``name``: ``size`` reference bases from ``pos`` (from 1); rows beyond the reference go, or keep at ``least`` so many."""
    rows = df.withColumn("_at", pos.cast("long")).withColumn("_chunk", F.floor((F.col("_at") - 1) / chunks.width).cast("long")).where("_at >= 1")
    found = F.substring("_bases", (F.col("_at") - F.col("_chunk") * chunks.width).cast("int"), size.cast("int"))
    rows = materialise(rows)  # read twice: for the chunks to look up, and to look up in them
    joined = rows.join(chunks.asked(rows), "_chunk").withColumn(name, found)
    # Written, so that whatever is made of the bases cuts them out of their chunk once.
    return materialise(joined.drop("_at", "_chunk", "_bases")).where(F.length(name) >= (size if least is None else least))


_STEPS = """aggregate(arrays_zip(n, op), named_struct('r', start_pos, 'q', 1, 'out', cast(array() as array<struct<r:bigint,q:int,n:int,op:string>>)),
 (a, x) -> named_struct('r', a.r + if(x.op in ('M', '=', 'X', 'D', 'N'), int(x.n), 0), 'q', a.q + if(x.op in ('M', '=', 'X', 'I', 'S'), int(x.n), 0),
 'out', if(x.op in ('M', '=', 'X', 'D', 'I') and int(x.n) > 0, concat(a.out, array(named_struct('r', a.r, 'q', a.q, 'n', int(x.n), 'op', x.op))), a.out)), a -> a.out)"""


def read_steps(reads: DataFrame) -> DataFrame:
    """``(*ids, r, q, n, op)``: the steps of each alignment that can hold events, with their place on the reference and in the read.

    ``reads`` has ``start_pos``, ``cigar``, ``seq`` and ids. One aggregate for each read walks its CIGAR: M, = and X advance both, D and N the
    reference, I and S the read; hard clips and padding are not in the read. Reads without alignment or sequence (``*``) have no steps.
    """
    rows = reads.where("cigar rlike '^([0-9]+[MIDNSHP=X])+$' and seq <> '*' and start_pos >= 1").withColumn("start_pos", F.col("start_pos").cast("long"))
    rows = rows.withColumn("n", F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))).withColumn("op", F.regexp_extract_all("cigar", F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)))
    ids = [c for c in reads.columns if c not in ("start_pos", "cigar", "seq", "end_pos")]
    return rows.select(*ids, F.upper("seq").alias("seq"), F.explode(F.expr(_STEPS)).alias("s")).select(*ids, "seq", "s.*")


def reads_to_events(reads: DataFrame, chunks: Chunks, salts: int = 8) -> DataFrame:
    """``(*ids, pos, ref, alt, vtype)``: where aligned reads differ from the reference.

    A base that differs gives a snp, a deleted base a del with an empty alt, an insertion one row with an empty ref at the base behind it.
    Steps are cut where chunks end, so that reads may span any number of chunks; stretches that agree leave no row, and only blocks of 64 bases
    that differ are looked at base by base. Bases beyond the reference give nothing. Chunks are copied ``salts`` times, so that the reads of one
    crowded place go to several tasks.
    """
    steps = read_steps(reads)
    ids = [c for c in steps.columns if c not in ("seq", "r", "q", "n", "op")]
    text = lambda c: F.lit(c).alias
    more = steps.where("op = 'I'").select(*ids, F.col("r").alias("pos"), text("")("ref"), F.expr("substring(seq, q, n)").alias("alt"), text("ins")("vtype"))
    width = chunks.width
    over = steps.where("op <> 'I'").withColumn("_chunk", F.explode(F.expr(f"sequence((r - 1) div {width}, (r + n - 2) div {width})")))
    start, end = F.greatest(F.col("r"), F.col("_chunk") * width + 1), F.least(F.col("r") + F.col("n"), (F.col("_chunk") + 1) * width + 1)
    cut = over.select(*ids, "_chunk", "op", start.alias("pos"), (end - start).cast("int").alias("n"), F.when(F.col("op") != "D", F.substring("seq", (F.col("q") + start - F.col("r")).cast("int"), (end - start).cast("int"))).alias("own"))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64(*ids, "pos"), F.lit(salts)).cast("int"))
    copies = chunks.asked(cut).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ref = F.substring("_bases", (F.col("pos") - F.col("_chunk") * width).cast("int"), F.col("n"))
    both = cut.join(copies, ["_chunk", "_salt"]).select(*ids, "op", "pos", "own", ref.alias("bases")).where("bases <> '' and (op = 'D' or own <> bases)")
    places = F.expr("""if(op = 'D', sequence(1, length(bases)), flatten(transform(filter(sequence(1, length(bases), 64), b -> substring(bases, b, 64) <> substring(own, b, 64)),
     b -> filter(sequence(b, least(b + 63, length(bases), length(own))), i -> substring(bases, i, 1) <> substring(own, i, 1)))))""")
    rows = both.select(*ids, "op", "pos", "own", "bases", F.explode(places).alias("i"))
    alt = F.when(F.col("op") == "D", "").otherwise(F.expr("substring(own, i, 1)"))
    changed = rows.select(*ids, (F.col("pos") + F.col("i") - 1).alias("pos"), F.expr("substring(bases, i, 1)").alias("ref"), alt.alias("alt"), F.when(F.col("op") == "D", "del").otherwise("snp").alias("vtype"))
    return changed.union(more)
