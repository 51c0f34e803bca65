import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from cladeworks.llm import pieces

ALPHABET = [*"aeinrtsh  \n\t▁éß日本①x.,-<s>0", "  ", "   ", "the", " and", "\U0001f600", "\0"]
EDGES = [None, "", " ", "a" * 5000, " " * 70, "x" * 33 + " " * 40, "<s></s><unk>", "word " * 20_000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return EDGES + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]


def test_ids_equal_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.Encoder(pieces.load()).encode(texts)
    assert [g.tolist() for g in got] == [library.encode(t) if t else [] for t in texts]


def test_round_trip_through_spark(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (0, None, "x")], "doc_id long, text string, ids string")
    back = pieces.decode(pieces.encode(frame)).collect()
    assert len(back) == len(texts) + 2
    for r in back:
        if r["doc_id"]:
            assert r["text"] == (texts[r["doc_id"]] or "").replace("▁", " ")
    digest = pieces.encode_and_decode(frame)
    assert digest.columns == ["doc_id", "ids", "n_tokens", "n_chars", "decoded_sha256"]
    assert digest.where("n_tokens <> size(ids)").count() == 0
    assert pieces.encode_and_decode(frame.where(F.lit(False))).count() == 0
