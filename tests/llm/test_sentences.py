import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import sentences as S


@pytest.fixture(scope="module")
def model(spark, data):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").select("text").collect()]
    return S.frozen(S.fit(texts))


CASES = [
    ["According to Mr. Keddemzit, the plan of Rinduf Corp. and two funds holds.", "In 2014 it fell by 0.5% to $.2 per unit."],
    ["The hearing was set for 9:30 a.m. on May 3.", "Nobody came."],
    ["“Is this final?” – “Yes.”", "That was the whole exchange with Mr. Pilgek."],
    ["He asked: “Is it so? We do not know.” and left.", "(See Note 6 for the terms.)", "For the reasons given above, it stayed."],
    ["Herr Dr. Buxmon erklärte: „Wir sind zufrieden. Mehr ist nicht geplant.“", "Die Rückzahlung wurde bis zum 3. Quartal 2014 gestundet."],
    ["« Faut-il davantage de capital ? » a demandé un prêteur.", "La direction hésite… puis renonce à la cession."],
    ["El Sr. Rommepvod afirmó: «Estamos tranquilos. No hace falta más capital».", "La deuda en EE. UU. es grande."],
]


@pytest.mark.parametrize("units", CASES)
def test_units(model, units):
    for gap in (" ", "\n"):
        text = gap.join(units)
        assert [text[a:b] for a, b in S.units(text, model)] == units


def test_unspaced_scripts(model):
    units = ["这会影响净资产价值吗？", "“不会。”她回答说。", "利率为基准利率加9.8%，下限为5.6%。", "“能按时还款吗？”一位分析师问道。"]
    assert ["".join(units)[a:b] for a, b in S.units("".join(units), model)] == units
    thai = ["กำไรของผู้กู้ลดลงในปี2022", "ค่าธรรมเนียมประมาณ40,179ดอลลาร์", "ผู้บริหารคาดว่าตลาดจะฟื้นตัวในปีหน้า"]
    assert [" ".join(thai)[a:b] for a, b in S.units(" ".join(thai), model)] == thai


def test_layout(model):
    text = "　Item 7. Management's Discussion\n \n– loans to Sefdan: 51.8%\n\n\nOne line\nbroken in two. Another one.  "
    assert [text[a:b] for a, b in S.units(text, model)] == ["Item 7. Management's Discussion", "– loans to Sefdan: 51.8%", "One line\nbroken in two.", "Another one."]


def test_units_hold_every_character(model, spark, data):
    for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").collect():
        text, seen = r["text"], 0
        for a, b in S.units(text, model):
            assert a < b and not text[a].isspace() and not text[b - 1].isspace() and not text[seen:a].strip()
            seen = b
        assert not text[seen:].strip()


def test_table(spark, model):
    df = spark.createDataFrame([(1, "One is here. Two is there.", 5), (2, None, 5), (3, " \n ", 5), (4, "", 5), (1, "One is here. Two is there.", 5), (5, "word " * 50_000, 5)], "doc_id LONG, text STRING, sent_start INT").drop("sent_start")
    got = [tuple(r) for r in S.sentences(df).collect()]
    assert sorted(got) == [(1, 0, 12), (1, 0, 12), (1, 13, 26), (1, 13, 26), (5, 0, 249_999)]
    assert S.sentences(df.where(F.lit(False))).count() == 0
    assert len(S.sample(df, "doc_id", "text", 2)) == 2


def test_line_breaks_of_two_characters(model):
    text = "One line\r\nbroken in two of them.\r\n\r\nHeading"
    assert [text[a:b] for a, b in S.units(text, model)] == ["One line\r\nbroken in two of them.", "Heading"]


def test_unpunctuated_japanese(model):
    units = ["担保には在庫、売掛金、不動産などが含まれる", "当社のBDCは2社に投資している。", "担保には在庫、売掛金、不動産などが含まれる", "「本当ですか？はい、本当です。」と述べた。"]
    for gap in (" ", "　"):
        text = gap.join(units)
        assert [text[a:b] for a, b in S.units(text, model)] == units


@pytest.mark.parametrize("text", ["第7項　リスク要因", "第十二章 风险因素", "该笔贷款由 Sefdan 公司于 2014 年提供。"])
def test_a_space_beside_han_is_no_boundary_by_itself(model, text):
    assert [text[a:b] for a, b in S.units(text, model)] == [text]


def test_all_texts_teach(spark, monkeypatch):
    """The model of a table is that of all its texts, however many there are and however they are parted."""
    kinds = ["Fees of Abcd. Xen rose by 3. Next it fell.\n\nThe end. It was so.", "See Qrs. Five of them. The Qrs. Act holds.\n\nAbcd. held it.", "利息を払う。 次の行 です\n\n担保には在庫、売掛金、不動産などが含まれる", "„Gut. Ja.“ sagte er... Dann (So.) ging es."]
    texts = [kinds[i % 4] if i < 4100 else f"Late Vwx. Number {i} came.\n\nVwx. stayed." for i in range(4400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    want = S.frozen(S.fit(texts))
    for parts in (1, 5):
        got = S.frozen(S.fit_table(df.repartition(parts), "text"))
        assert {**got.ends} == {**want.ends} and got.starts == want.starts and got.goes_on == want.goes_on and got.base == want.base
    monkeypatch.setattr(S, "sample", lambda *_: pytest.fail("a sample is drawn"))
    assert S.sentences(df).count() == sum(len(S.units(t, want)) for t in texts)


def test_each_text_is_read_once(spark, model):
    """Learning and segmenting share one pass over the texts."""
    texts, read = ["One is here. Two is there.", "Fees of Abcd. Xen rose by 3.\n\nIt fell."] * 20, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3).mapInPandas(counted, "doc_id LONG, text STRING")
    want = S.frozen(S.fit(texts))
    got = S.sentences(df).collect()
    assert read.value == len(texts)
    assert sorted(map(tuple, got)) == sorted((i, *u) for i, t in enumerate(texts) for u in S.units(t, want))
