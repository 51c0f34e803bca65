import base64
import random
import zlib

from pyspark.sql import functions as F

from cladeworks.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int, rejected string"
SYLLABLES = {"aa": ["ka", "ro", "mi", "the"], "bb": ["ün", "ich", "sch", "der"], "cc": ["ción", "ñe", "los", "que"]}


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 80)))
        rows.append((i, text, lang, 1, "x"))
    return rows


def test_held_out_accuracy_and_folds(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    held = [(got[i]["lang_pred"], lang) for i, _, lang, *_ in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edges(spark):
    rng = random.Random(9)
    long_text = " ".join("".join(rng.choice(SYLLABLES["aa"]) for _ in range(rng.randint(1, 3))) for _ in range(30_000))
    rows = corpus() + [(1000, None, "aa", 1, "x"), (1001, "", "bb", 1, "x"), (1002, "123 !?", "cc", 1, "x"), (None, "karomi", None, 1, "x"),
                       (1003, long_text, None, 1, "x"), (1004, "ЖЩЮЯ ЫЭ ЖЩ " * 50, None, 1, "x"), (0, corpus()[0][1], "aa", 1, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(frame).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1000, 1001, 1002))
    assert by[None]["lang_pred"] == "aa" and by[None]["held_out"] is False
    assert by[1003]["lang_pred"] == "aa" and not by[1003]["rejected"]
    assert by[1004]["lang_pred"] in SYLLABLES and by[1004]["rejected"]
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not set(ids) & {1000, 1001, 1002, 1004}
    assert len(ids) >= len(rows) - 7
    assert langid.identify(frame.where(F.lit(False))).count() == 0
    unlabelled = langid.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_junk_is_rejected_though_some_is_in_the_training_rows(spark):
    rng = random.Random(4)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    base = lambda n: base64.b64encode(rng.randbytes(5 * n)).decode()
    finnish = "talo kissa koira olen ollut kaupunki metsä yö päivä kuinka huomenta tämä suomen kieli helppo ihminen juoksee nopeasti kotiin koska sataa vettä".split()
    polish = "dom pies jestem byłem miasto jezioro las dzień jak dobry rano język polski łatwy człowiek biegnie szybko ponieważ pada deszcz wszystko gdzie źródło".split()
    listed = lambda words: lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = corpus(1000)
    rows += [(2000 + i, make(rng.choice([40, 200])), rng.choice(sorted(SYLLABLES)), 1, "x") for i, make in enumerate([letters, base] * 10)]
    rows += [(3000 + 10 * k + i, make(n), None, 1, "x") for k, make in enumerate([letters, base, listed(finnish), listed(polish)]) for i, n in enumerate([40, 200, 1000])]
    kept = {r["doc_id"] for r in langid.keep_identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not [i for i in kept if i >= 2000]
    assert len([i for i in kept if i < 1000]) >= 990
