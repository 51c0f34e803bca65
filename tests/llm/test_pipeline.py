"""The whole pipeline on a small corpus against its stages written plainly."""

import gc
import hashlib
import random
import re
import time
import weakref

import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from cladeworks.llm import langid, pieces, simhash
from cladeworks.plans.lineage import materialise
from tests.llm import test_decontaminate, test_linededup, test_simhash

SYLLABLES = {"aa": ["ka", "ro", "mi", "the"], "bb": ["ün", "ich", "sch", "der"]}


def corpus(tmp_path, spark):
    rng = random.Random(11)
    line = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(i, line("aa", 20)) for i in range(4)]
    shared = line("aa", 12)
    rows = []
    for i in range(160):
        lang = rng.choice(["aa", "bb"])
        text = [line(lang, rng.randint(3, 25)) for _ in range(rng.randint(1, 5))]
        if i % 9 == 0:
            text.insert(0, shared)
        if i % 20 == 3:
            text.append(items[i % 4][1])
        rows.append((i, "\n".join(text), lang, f"s{i % 3}", 0))
    rows += [(200, rows[5][1], "aa", "s", 0), (201, rows[6][1] + " extra", "bb", "s", 0), (202, None, "aa", "s", 0), (203, "123 ...", None, None, None), (204, "", "aa", "s", 0), (None, rows[8][1], "aa", "s", 0)]
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, items = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    named = {r["doc_id"]: r["rejected"] for r in langid.identify(docs).where("doc_id is not null").collect()}
    left = [r for r in rows if r[0] is None or not named[r[0]]]
    assert {r[0] for r in rows} - {r[0] for r in left} >= {202, 203, 204}
    gone = test_linededup.brute(left)
    left = [(i, t if i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), *rest) for i, t, *rest in left]
    known = sorted((r for r in left if r[0] is not None), key=lambda r: r[0])
    roots = test_simhash.brute_components([test_simhash.brute_fingerprint(t, 5) for _, t, *_ in known])
    left = [r for k, r in enumerate(known) if roots[k] == k] + [r for r in left if r[0] is None]
    bad = {i for i, *_ in test_decontaminate.brute(left, items)}
    left = [r for r in left if r[0] not in bad]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = sorted((i or -1, tuple(library.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in left)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"] or -1, tuple(r["ids"]), r["decoded_sha256"]) for r in got.collect()) == want
    assert len(want) < len(rows) and bad and gone


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


def test_no_letters_means_no_language():
    assert not langid._LETTER.search("123 _ ...") and langid._LETTER.search("1 é")
    assert re.fullmatch("[0-9a-f]{16}", f"{simhash.fingerprint('a b c', 3):016x}")


def test_long_texts_reach_python_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(60).coalesce(1).selectExpr("id as doc_id", "repeat('word ', 100000) as text")
    corpus_pipeline.encode(spark, docs, "")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    assert 1 << 20 < max(r["n"] for r in docs.mapInArrow(sizes, "n long").collect()) < 6 << 20


def test_written_steps_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    kept = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 7


def test_written_steps_leave_nothing_of_theirs_in_the_driver(spark):
    beans = spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    collections = lambda: sum(beans.apply(i).getCollectionCount() for i in range(beans.size()))
    frames = [spark.range(3)]
    held, before = weakref.ref(frames[0]), collections()
    frames.append(frames)  # a cycle, which only a collection lets go
    gc.disable()
    try:
        del frames
        materialise(spark.range(5))
        assert held() is None and collections() > before
    finally:
        gc.enable()
