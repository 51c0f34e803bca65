"""How the sources of a language differ in their words, priced exactly from joint tables of count levels.

A term keeps its count in every (language, source) group. What two groups have in common is all in their joint table:
how many terms have count level a in the one and b in the other. The tables of all groups come from one-hot columns,
one for each group and level, multiplied by their transpose: tasks take blocks of terms, build the 0/1 matrix of the
columns that the block has, and multiply tile by tile in single precision, which is exact for sums below 2^24. Levels
of zero aren't columns: their cells are what the margins leave. A table is then priced level by level.

Terms are runs of letters A-Z and of characters beyond ASCII, only A-Z lower-cased. A language keeps the terms in at
least three of its rows of documents. A group with N occurrences of the V kept terms gives a term with c of them
p = 1 + floor(10^9 (c + 1) / (N + V)); f(p, q) = floor((p - q)^2 / q).

Defined results: null text, language and source are empty strings; rows that repeat count one by one; a group without
terms is compared like any other, at 0 if its language keeps no term; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.plans.lineage import materialise

#: What no term holds becomes a blank, A-Z become a-z; bytes of characters beyond ASCII stay.
_TERMS = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))
_PIECE = 1 << 20
_COUNTS = "lang string, term string, n_docs long, sources array<string>, counts array<long>"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of bounded size."""
    text, at = text.translate(_TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """``_COUNTS`` of the terms of each language, with what was counted since the last rows; sent on when ``most`` counts are held."""
    counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    rows: dict[str, Counter] = defaultdict(Counter)

    def held() -> Iterator[pa.RecordBatch]:
        for lang, by_source in counts.items():
            named = [(source, c) for source, c in by_source.items() if c]
            index = np.repeat(np.arange(len(named), dtype=np.int32), [len(c) for _, c in named])
            terms = pa.array(chain.from_iterable(c for _, c in named), pa.binary())
            own = pa.table({"term": terms, "source": pa.array(index).cast(pa.int32()), "count": pa.array(chain.from_iterable(c.values() for _, c in named), pa.int64())})
            one = own.group_by("term", use_threads=False).aggregate([("source", "list"), ("count", "list")]).combine_chunks()
            if one.num_rows:
                term, lists = one["term"].chunk(0), one["source_list"].chunk(0)
                sources = pa.array([s for s, _ in named], pa.string()).take(lists.values)
                n_docs = pa.array(map(rows[lang].__getitem__, term.to_pylist()), pa.int64())
                columns = [pa.array([lang] * len(term), pa.string()), term.cast(pa.string()), n_docs, pa.ListArray.from_arrays(lists.offsets, sources), one["count_list"].chunk(0)]
                yield from pa.Table.from_arrays(columns, ["lang", "term", "n_docs", "sources", "counts"]).to_batches(max_chunksize=10_000)
        counts.clear()
        rows.clear()

    size = 0
    for batch in batches:
        langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(0).cast(pa.binary())):
            own, seen = counts[lang][source], set()
            size -= len(own)
            for piece in _terms(text.as_py()):
                own.update(piece)
                seen.update(piece)
            rows[lang].update(seen)
            size += len(own)
            if size > most:
                yield from held()
                size = 0
    yield from held()


def kept_terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """``(lang, term, total, groups)``: terms in at least ``least`` rows of their language, with their count in each source that has them.

    Lists of a term are as long as its sources and the tasks that counted it; rare terms go before their lists are added up.
    """
    text = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = text.mapInArrow(_count, _COUNTS).groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.flatten(F.collect_list(F.arrays_zip("sources", "counts"))).alias("held"))
    counts = found.where(F.col("n_docs") >= least).select("lang", "term", F.inline("held")).groupBy("lang", "term", "sources").agg(F.sum("counts").alias("count"))
    return counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.collect_list(F.struct(F.col("sources").alias("source"), "count")).alias("groups"))


def group_sizes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(lang, source, size, v, lang_size)``: occurrences of kept terms in each group and language, and the number of terms."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = terms.select("lang", F.inline("groups")).groupBy("lang", "source").agg(F.sum("count").alias("size"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    zero = F.lit(0).cast("long")
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("size", "v", "lang_size")])


def _products(batches: Iterator[pa.RecordBatch], columns: int = 512, terms: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cells ``(lang, source_a, source_b, a, b, n)`` of levels above zero, source_a < source_b, from blocks of terms.

    A block ends before it has more than ``columns`` columns (unless one term has more) or ``terms`` terms.
    """

    def multiply(lang: str, index: dict[tuple[str, int], int], block: list[list[int]]) -> Iterator[pa.RecordBatch]:
        keys = sorted(index)
        place = np.empty(len(keys), np.int64)
        place[[index[k] for k in keys]] = np.arange(len(keys))
        hot = np.zeros((len(block), len(keys)), np.float32)
        hot[np.repeat(np.arange(len(block)), [len(r) for r in block]), place[np.concatenate([np.asarray(r, np.int64) for r in block])]] = 1
        source, group = np.unique([k[0] for k in keys], return_inverse=True)
        level = np.array([k[1] for k in keys], np.int64)
        for i in range(0, len(keys), columns):
            for j in range(i, len(keys), columns):
                joint = hot[:, i : i + columns].T @ hot[:, j : j + columns]
                a, b = np.nonzero(joint)
                n = joint[a, b].astype(np.int64)
                a, b = a + i, b + j
                pair = group[a] < group[b]
                a, b, n = a[pair], b[pair], n[pair]
                if len(n):
                    named = [pa.array(source[group[x]], pa.string()) for x in (a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *named, pa.array(level[a]), pa.array(level[b]), pa.array(n)], ["lang", "source_a", "source_b", "a", "b", "n"])

    lang, index, block = None, {}, []
    for batch in batches:
        for at, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = [(g["source"], g["count"]) for g in groups if g["count"] > 0]
            fresh = [k for k in keys if k not in index]
            if block and (at != lang or len(index) + len(fresh) > columns or len(block) >= terms):
                yield from multiply(lang, index, block)
                index, block, fresh = {}, [], keys
            lang = at
            for k in fresh:
                index[k] = len(index)
            if keys:
                block.append([index[k] for k in keys])
    if block:
        yield from multiply(lang, index, block)


def joint_tables(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, source_a, source_b, a, b, n)`` for each two groups of a language, source_a < source_b: terms at count levels a and b, zero included.

    Terms go to the tasks sorted by their totals, so that blocks of rare terms share few columns.
    """
    cells = "lang string, source_a string, source_b string, a long, b long, n long"
    products = terms.repartition("lang", "term").sortWithinPartitions("lang", "total").select("lang", "groups").mapInArrow(_products, cells)
    products = products.groupBy("lang", "source_a", "source_b", "a", "b").agg(F.sum("n").alias("n"))
    pairs = sizes.select("lang", F.col("source").alias("source_a"), "v").join(sizes.select("lang", F.col("source").alias("source_b")), "lang").where("source_a < source_b")
    levels = terms.select("lang", F.inline("groups")).where("count > 0").groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("n"))
    zero, cell = F.lit(0).cast("long"), lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.alias("n"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    # Signed rows: a cell above zero leaves its margins, a margin leaves the cell of terms that neither group has.
    rows = products.select("lang", "source_a", "source_b", F.inline(F.array(cell(a, b, n), cell(a, zero, -n), cell(zero, b, -n), cell(zero, zero, n))))
    for side, level in (("source_a", (F.col("count"), zero)), ("source_b", (zero, F.col("count")))):
        margin = pairs.join(levels.withColumnRenamed("source", side), ["lang", side])
        rows = rows.unionByName(margin.select("lang", "source_a", "source_b", F.inline(F.array(cell(*level, n), cell(zero, zero, -n)))))
    rows = rows.unionByName(pairs.select("lang", "source_a", "source_b", zero.alias("a"), zero.alias("b"), F.col("v").alias("n")))
    return rows.groupBy("lang", "source_a", "source_b", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")


def share(count: Column, size: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (size + v)), by thousands, so that no product leaves a long."""
    whole = F.greatest(size + v, F.lit(1))
    div = lambda x: F.call_function("div", x, whole)
    done, rest = div(count + 1), (count + 1) % whole
    for _ in range(3):
        done, rest = done * 1000 + div(rest * 1000), (rest * 1000) % whole
    return done + 1


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_values(tables: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the price of each group against each other source of its language, 0 without terms."""
    side = lambda x: sizes.select("lang", F.col("source").alias(f"source_{x}"), F.col("size").alias(f"size_{x}"), "v")
    pairs = side("a").join(side("b").drop("v"), "lang").where("source_a < source_b")
    p, q = (share(F.col(x), F.col(f"size_{x}"), F.col("v")) for x in "ab")
    cells = pairs.join(tables, ["lang", "source_a", "source_b"], "left").select("lang", "source_a", "source_b", "n", p.alias("p"), q.alias("q"))
    both = cells.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("n") * price(F.col("p"), F.col("q"))).alias("ab"), F.sum(F.col("n") * price(F.col("q"), F.col("p"))).alias("ba"))
    way = lambda x, y, v: F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.coalesce(v, F.lit(0).cast("long")).alias("value"))
    return both.select("lang", F.inline(F.array(way("source_a", "source_b", "ab"), way("source_b", "source_a", "ba"))))


def term_values(terms: DataFrame, sizes: DataFrame, salts: int = 16) -> DataFrame:
    """``(lang, source, item, value)`` of the terms that a group has and that are likelier there than in its language."""
    rows = terms.select("lang", "term", "total", F.inline("groups")).where("count > 0").withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    rows = rows.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "source", "salt"])
    p, q = share(F.col("count"), F.col("size"), F.col("v")), share(F.col("total"), F.col("lang_size"), F.col("v"))
    return rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, ranks: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources by their price, and a group's ``ranks`` dearest terms."""
    terms = materialise(kept_terms(docs))
    sizes = materialise(group_sizes(docs, terms))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    pairs = pair_values(joint_tables(terms, sizes), sizes).select("*", rank)
    single = term_values(terms, sizes).select("*", rank).where(F.col("rank") <= ranks)
    return pairs.select(*columns("pair")).union(single.select(*columns("term")))
