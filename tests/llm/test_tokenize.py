import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import tokenize as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(T.DEFAULT_TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = ["", None, " ", "  a  b \n c", " x", " ", "a 　b", "I'll  be", "<|endoftext|> a", "日本語のテキスト。" * 30, "a" * 5000, "été naïve ½ ² ١٢", "x\x1cy", "👩‍👩‍👧 ok", "é "]


def test_like_the_library(reference):
    coder = T.BytePairCoder()
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab 'stre\n\tй語1,.") for _ in range(rng.randrange(40))) for _ in range(800)]
    ids, offsets = coder.encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == reference(texts)
    assert coder.count_batch(texts) == np.diff(offsets).tolist()


def test_long_words_by_heap(reference):
    coder, rng = T.BytePairCoder(), random.Random(2)
    for word in ("a" * 3000, "".join(rng.choice("etaoinsh") for _ in range(4000)), "the" * 900):
        assert list(coder._heaped(word.encode())) == reference([word])[0]


def test_full_cache(reference, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", 3)
    coder = T.BytePairCoder()
    for _ in range(2):
        ids, offsets = coder.encode_batch(TEXTS)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == reference(TEXTS)


def test_table(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "again", "x")], "doc_id LONG, text STRING, key STRING")
    rows = T.encode(df).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in rows) == sorted([*enumerate(reference(TEXTS)), (1, reference(["again"])[0])])
    assert T.encode(df.where(F.lit(False))).count() == 0
