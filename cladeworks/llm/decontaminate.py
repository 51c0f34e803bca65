"""Benchmark passages in training texts by spaced-seed hashing, in DataFrame operations only.

A seed is the hash of five words at the positions of a fixed mask; the words
between are ignored. The three masks are chosen so that every aligned window
of 8 to 13 words of which at most a fifth differ contains some mask with all
five words equal: substitutions cannot hide a passage. Every position of every
training text is hashed, as is every position of every benchmark item; equal
hashes give an alignment (document, item, offset), and each alignment is then
verified word by word. A document holds a passage of an item if some window of
13 aligned words (the whole item if it is shorter) agrees in 4/5 or more. Items
of fewer than 8 words, too short for the masks, are found by a hash of all
their words and count only if every word is equal.

Scale: the texts are scanned once for seeds and once for the few documents
with hits. Seeds are tested against a bitmap of fixed size before any join, so
what is shuffled is the hits. The seed table is broadcast only if it has at
most ``BROADCAST_SEEDS`` rows; beyond that the hits are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.common import bit_array, bit_is_set
from cladeworks.plans.lineage import materialise

#: The word positions of the three masks.
MASKS = ((0, 1, 2, 4, 5), (0, 3, 5, 6, 7), (0, 2, 3, 7, 8))
#: Words of the window, and from which an item may differ in a fifth.
WINDOW, LEAST_WORDS = 13, 8
NUM, DEN = 4, 5
BITMAP_WORDS = 1 << 15
BROADCAST_SEEDS = 500_000


def words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _seeds(table: DataFrame, key: str, short: list[int], whole: bool) -> DataFrame:
    """``(key, pos, seed)`` for each mask at each position of ``table (key, words)``, and for each run of ``short`` words.

    ``whole``: such a run must be all of the words.
    """
    at = table.select(key, "words", F.posexplode("words").alias("pos", "_w"))
    size = F.size("words")
    hashes = [F.when(F.col("pos") + mask[-1] < size, F.xxhash64(F.lit(m), *[F.get("words", F.col("pos") + o) for o in mask])) for m, mask in enumerate(MASKS)]
    for n in short:
        fits = (size == n) & (F.col("pos") == 0) if whole else F.col("pos") + n <= size
        hashes.append(F.when(fits, F.xxhash64(F.lit(-n), *[F.get("words", F.col("pos") + o) for o in range(n)])))
    return at.select(key, "pos", F.explode(F.array(*hashes)).alias("seed")).where("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_window, n_equal)``: one row per document and item that share a passage.

    n_equal of the n_window aligned words of the best window are equal. Items
    of fewer than 8 words must be there word for word. Items without words,
    null texts and rows with a null id take no part. Rows that repeat an id count as one
    document; the best window over all of them is reported. Items that share
    an id are told apart by text and reported under that id. Other columns
    are ignored; empty tables give an empty result.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = materialise(
        benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("words"))
        .where(F.size("words") > 0).distinct().withColumn("item", F.xxhash64("item_id", "words"))
    )
    short = sorted(r["n"] for r in items.where(F.size("words") < LEAST_WORDS).select(F.size("words").alias("n")).distinct().collect())  # 7 at most
    seeds = materialise(_seeds(items, "item", short, True).withColumnRenamed("pos", "item_pos"))
    small = seeds.count() <= BROADCAST_SEEDS
    bounded = F.broadcast if small else lambda df: df
    hits = _seeds(docs.select("doc_id", words("text").alias("words")), "doc_id", short, False)
    hits = hits.where(bit_is_set(bit_array(seeds, "seed", BITMAP_WORDS), F.col("seed"), BITMAP_WORDS))
    aligned = materialise(hits.join(bounded(seeds), "seed").select("doc_id", "item", (F.col("pos") - F.col("item_pos")).alias("offset")).distinct())
    some = docs.where(bit_is_set(bit_array(aligned, "doc_id", BITMAP_WORDS), F.col("doc_id"), BITMAP_WORDS)).select("doc_id", words("text").alias("doc_words"))
    both = some.join(aligned, "doc_id").join(bounded(items), "item")
    equal = F.transform("words", lambda w, j: F.coalesce((F.get("doc_words", F.col("offset") + j) == w).cast("int"), F.lit(0)))
    both = both.select("doc_id", "item_id", F.least(F.size("words"), F.lit(WINDOW)).alias("n_window"), equal.alias("equal"))
    sums = F.expr("transform(sequence(1, size(equal) - n_window + 1), s -> aggregate(slice(equal, s, n_window), 0, (a, x) -> a + x))")
    found = both.withColumn("n_equal", F.array_max(sums)).where(f"n_equal = n_window or n_window >= {LEAST_WORDS} and {DEN} * n_equal >= {NUM} * n_window")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", "n_window")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_window").cast("long").alias("n_window"), F.col("b.n_equal").cast("long").alias("n_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage; columns unchanged, rows with a null id stay."""
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].cast("long") == bad["_bad"], "left_anti")
