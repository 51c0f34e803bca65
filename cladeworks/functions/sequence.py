"""Nucleotide and protein expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, amino acids of the codons AAA, AAC, AAG, AAT, ACA ... TTT.
GENETIC_CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"


def reverse_complement(seq: Column) -> Column:
    """Gaps stay gaps."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def amino_acid(codon: Column) -> Column:
    """Null unless the codon is three of A, C, G, T."""
    place = lambda i: F.instr(F.lit("ACGT"), F.substring(codon, i, 1)) - 1
    index = 16 * place(1) + 4 * place(2) + place(3)
    return F.when(codon.rlike("^[ACGT]{3}$"), F.substring(F.lit(GENETIC_CODE), index + 1, F.lit(1)))


def protein(seq: Column) -> Column:
    """Amino acids of the whole codons of a sequence, to its end."""
    codons = F.when(F.length(seq) >= 3, F.transform(F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3)), lambda i: amino_acid(F.substring(seq, i, F.lit(3)))))
    return F.coalesce(F.array_join(codons, "", "X"), F.lit(""))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of characters that two strings have in common at the start."""
    differ = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, F.least(differ - 1, F.length(a), F.length(b))).otherwise(F.least(F.length(a), F.length(b))).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def feature_position(pos: Column, start: Column, end: Column, strand: Column, ftype: Column) -> Column:
    """Genome position to a position in its feature: upstream rows count down to the gene, RNA rows count bases, genes count codons."""
    plus = strand == 1
    return (
        F.when(ftype == "upstream", F.when(plus, pos - end - 1).otherwise(start - pos - 1))
        .when(ftype == "Gene", F.when(plus, F.floor((pos - start) / 3) + 1).otherwise(F.floor((end - pos) / 3) + 1))
        .otherwise(F.when(plus, pos - start + 1).otherwise(end - pos + 1))
    )


def codon_start(codon: Column, start: Column, end: Column, strand: Column) -> Column:
    """The first genome position of a codon, counted from 1 along the strand."""
    return F.when(strand == 1, start + 3 * (codon - 1)).otherwise(end - 3 * codon + 1)


def anchor(pos: Column, start: Column) -> Column:
    """The position of the first base of the codon that holds ``pos``."""
    return pos - F.pmod(pos - start, F.lit(3))
