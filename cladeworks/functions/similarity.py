"""Amino-acid similarity as a table, and the distances between its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The BLOSUM62 matrix, each row up to the diagonal.
BLOSUM62 = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def entries(triangle: str = BLOSUM62) -> list[tuple[str, str, int]]:
    """``(a, b, score)`` of both halves of a triangle of text lines."""
    lines = [line.split() for line in triangle.strip().splitlines()]
    names = [line[0] for line in lines]
    half = [(line[0], names[i], int(score)) for line in lines for i, score in enumerate(line[1:])]
    return sorted({*half, *((b, a, score) for a, b, score in half)})


def similarity(spark: SparkSession, triangle: str = BLOSUM62) -> DataFrame:
    """``(a, b, score)``."""
    return spark.createDataFrame(entries(triangle), "a string, b string, score int")


def distances(similar: DataFrame) -> DataFrame:
    """``(ref, alt, distance)``: the Euclidean distance between the rows of two letters, for all pairs of the alphabet."""
    other = similar.select(F.col("a").alias("alt"), "b", F.col("score").alias("score_b"))
    gap = F.col("score") - F.col("score_b")
    return similar.join(other, "b").groupBy(F.col("a").alias("ref"), "alt").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))
