"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits. With radius r, each bit position gets a nonzero
vector of r+1 bits; for every nonzero vector v of r+1 bits, mask v keeps the
positions whose vector has odd inner product with v. Any r differing positions
leave some mask untouched (r vectors in r+1 dimensions have a common
orthogonal v), so each pair within the radius meets in at least one of the
2**(r+1) - 1 tables: nothing is missed.

Scale: documents collapse to distinct fingerprints first, so groups of exact
copies cost one row. A table's bucket with two fingerprints is verified from
its minimum and maximum. A larger bucket is never paired off: each member
names itself and its one-bit neighbours in the unmasked positions as centres;
two members share a centre exactly if they differ in one or two bits, so all
members of a centre join its smallest one. That is linear in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm import neardup
from cladeworks.llm.common import fresh, slices
from cladeworks.llm.linededup import REF
from cladeworks.plans.components import connected_components
from cladeworks.plans.lineage import materialise

BITS, RADIUS = 64, 2


def masks() -> list[int]:
    """The covering masks for radius 2, as unsigned 64-bit numbers."""
    size = 1 << (RADIUS + 1)
    vector = [1 + i % (size - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, words_per_shingle: int) -> list[int]:
    """Hashes of the word shingles of a text in their order, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return []
    k = min(n, words_per_shingle)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """SimHash of the word shingles of a text; 0 if it has no words."""
    return _votes(np.array(shingle_hashes(text, words_per_shingle), np.uint64))


def _votes(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 if there are none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: one row per row of ``docs``; null and empty texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = [_signed(fingerprint(t, shingle)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """``(src, dst)`` fingerprint pairs that connect all fingerprints within the radius.

    ``distinct`` has one row per fingerprint (``fp``). Every emitted pair
    differs in one or two bits; every pair within the radius is connected
    through emitted pairs.
    """
    tables = [(v, m) for v, m in enumerate(masks())]
    rows = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in tables])).alias("t")
    ).select("fp", "t.v", "t.key")
    buckets = rows.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    buckets = materialise(buckets)
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= RADIUS).select(F.col("hi").alias("src"), F.col("lo").alias("dst"))
    flips = F.lit(None).cast("array<bigint>")
    for v, m in tables:
        free = [0] + [_signed(1 << b) for b in range(BITS) if not m >> b & 1]
        flips = F.when(F.col("v") == v, F.array(*[F.lit(x).cast("long") for x in free])).otherwise(flips)
    members = rows.join(buckets.where("n > 2").select("v", "key"), ["v", "key"], "left_semi")
    centred = members.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    centred = materialise(centred.distinct())
    stars = centred.groupBy("centre").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("centre", "lo")
    starred = centred.join(stars, "centre").where("fp <> lo").select(F.col("fp").alias("src"), F.col("lo").alias("dst"))
    return pairs.union(starred).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per row of ``docs``.

    component_id is the smallest id that is reachable through fingerprints
    that differ in two bits or fewer. Texts that are null, empty or blank have
    fingerprint 0 and are linked like any other. Repeated rows and repeated ids
    each keep their row. A null id is never a component_id unless the whole
    component has null ids. An empty table gives an empty result; other
    columns are ignored.
    """
    fps = materialise(fingerprints(docs, shingle, id_col, text_col))
    classes = _classes(materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    return fps.join(classes, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def _classes(distinct: DataFrame) -> DataFrame:
    """``(fp, least, first)`` for ``distinct (fp, least)``, one row per fingerprint: first is the smallest ``least`` of those that are reachable."""
    nodes = connected_components(links(distinct.select("fp")))
    named = nodes.join(distinct, nodes["node"] == distinct["fp"]).select("fp", "root", "least")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    moved = named.join(least, "root").select("fp", "component")
    return distinct.join(moved, "fp", "left").select("fp", "least", F.coalesce("component", "least").alias("first"))


def _group_pairs(firsts: DataFrame) -> DataFrame:
    """``(b_*, a_*)``: each set with the earliest one of its fingerprint and the earliest one of its SimHash group, where these are others.

    ``firsts`` is ``(*REF, n, even, fp)``, one row per distinct set.
    """
    row = (*REF, "n", "even")
    classes = _classes(materialise(firsts.groupBy("fp").agg(F.min(F.struct(*row)).alias("least"))))
    earlier = classes.select("fp", F.explode(F.array_distinct(F.array("least", "first"))).alias("a"))
    pairs = firsts.join(earlier, "fp").select(*[F.col(c).alias(f"b_{c}") for c in row], *[F.col(f"a.{c}").alias(f"a_{c}") for c in row])
    return pairs.where(F.struct(*[f"a_{c}" for c in REF]) < F.struct(*[f"b_{c}" for c in REF]))


def keep_one_per_group(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that resemble no row with a smaller id; columns unchanged.

    Rows resemble each other if the sets of their shingles have a Jaccard
    similarity of 0.8 or more. Each row is first compared with the earliest
    ones of its fingerprint and of its SimHash group; what that doesn't
    explain, as fingerprints within the radius reach only nearer texts, is
    compared exactly with all earlier rows (``neardup``). Rows that share an
    id but not the text are judged apart; of rows with equal id and text one
    stays. Rows with a null id cannot be named by a decision and stay.
    """
    key = [fresh(docs, "_doc_id"), fresh(docs, "_tag")]
    keyed = docs.where(F.col(id_col).isNotNull()).withColumns({key[0]: F.col(id_col).cast("long"), key[1]: F.xxhash64(F.col(text_col).cast("string"))})
    keyed = _once(keyed, key)
    rows = keyed.select(F.col(key[0]).alias("doc_id"), F.col(key[1]).alias("tag"), F.col(text_col).cast("string").alias("text"))
    gone = neardup.resembling_earlier(rows, lambda text: np.array(shingle_hashes(text, shingle), np.uint64), lambda hashes: _signed(_votes(hashes)), _group_pairs)
    kept = keyed.join(gone.toDF(*key), key, "left_anti").select(docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def _once(keyed: DataFrame, key: list[str]) -> DataFrame:
    """One row of those with an equal key; only repeated ones are shuffled, so that other texts stay where they are."""
    again = materialise(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key))
    if again.isEmpty():
        return keyed
    return keyed.join(again, key, "left_anti").unionByName(keyed.join(again, key, "left_semi").dropDuplicates(key).select(keyed.columns))
