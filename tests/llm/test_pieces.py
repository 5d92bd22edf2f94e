import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import pieces as P


def check(text, limit, overlap):
    words, cut = P.WORD.findall(text or ""), P.cut_text(text, limit, overlap)
    own, before = [], None
    for k, (a, o, b, n) in enumerate(cut):
        piece = P.WORD.findall(text[a:b])
        assert len(piece) == n <= limit
        mine = P.WORD.findall(text[o:b])
        if k:
            assert piece[: n - len(mine)] == before[-overlap:] if overlap else n == len(mine)
        own += mine
        before = piece
    assert own == words
    assert (len(cut) > 1) == (len(words) > limit)


@given(st.lists(st.sampled_from(["a", "b.", "C", "\n\n", " ", "　", "D!", "mr.", "\n"]), max_size=200).map(" ".join), st.integers(2, 30))
@settings(max_examples=150, deadline=None)
def test_pieces(text, limit):
    check(text, limit, limit // 3)


def test_natural_boundaries():
    text = "\n\n".join(["word " * 39 + "end."] * 30)
    for a, o, b, _ in P.cut_text(text):
        assert text[b - 4 : b] == "end." and (o == 0 or text[o - 2 : o] == "\n\n")
    check("x " * 100_000, 512, 64)


def test_table(spark):
    df = spark.createDataFrame([(1, "a " * 600, 9), (2, None, 9), (3, " ", 9), (4, "b", 9), (1, "a " * 600, 9)], "id LONG, text STRING, piece_no INT")
    rows = P.cut(df.drop("piece_no"), ["id"]).collect()
    assert sorted((r["id"], r["piece_no"], r["n_words"]) for r in rows) == [(1, 1, 512), (1, 1, 512), (1, 2, 152), (1, 2, 152), (4, 1, 1)]
    assert P.cut(df.where(F.lit(False)).drop("piece_no"), ["id"]).count() == 0
    with pytest.raises(ValueError):
        P.cut(df, ["id"], limit=64, overlap=64)
