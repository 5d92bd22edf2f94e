"""Operators on small inputs: HTML to rows, corpus, search, sites, joins and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analytics, corpus, mentions, quality, relational, schedule, search, site
from ledgerloom.plans.schedule_queries import FIXTURE
from ledgerloom.sources import files, html
from ledgerloom.streaming import events as E


def row_html(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def test_schedule_from_html(spark):
    docs = spark.createDataFrame([("a", FIXTURE), ("none", "<p>x</p>"), ("null", None)], "doc_id STRING, html STRING")
    rows = schedule.assemble(html.scan_tables(docs, ["doc_id"])).orderBy("row_no").collect()
    assert [(r["doc_id"], r["row_no"], r["principal_amount"], r["fair_value"], r["rate_spread_pct"]) for r in rows] == [("a", 1, "1000", "1050", "7.75"), ("a", 2, "500", "520", "7.5"), ("a", 3, "200", "205", "8.0")]
    assert {(r["company_name"], r["industry"], r["investment_category"]) for r in rows} == {("Acme Corp", "Manufacturing", "Control")}


def loop_islands(signs, gap=2):
    out, group, header, last = [], 0, None, None
    for i, is_header, has_data in signs:
        if is_header:
            group, header, last = group + 1, i, i
            out.append((group, header, i))
        elif group and has_data and last is not None and i - last <= gap:
            last = i
            out.append((group, header, i))
        elif group and has_data:
            last = None
    return out


def test_islands_like_a_loop(spark):
    rng = random.Random(5)
    signs = [(i, rng.random() < 0.1, rng.random() < 0.45) for i in range(300)]
    df = spark.createDataFrame([("d", *s) for s in signs], "doc_id STRING, table_idx INT, is_header BOOLEAN, has_data BOOLEAN")
    got = [(r["group_no"], r["header"], r["table_idx"]) for r in schedule.islands(df).orderBy("table_idx").collect()]
    assert got == loop_islands(signs)


def test_html_repairs():
    assert html.table_rows("<table><tr><td>a<td>b <b>c</b><tr><th>d</table>") == [(0, 0, ["a", "bc"], "abc"), (0, 1, ["d"], "d")]
    assert html.page_text("<body><nav>n</nav><main><p>a</p> b<script>x</script></main><footer>f</footer></body>") == "a\nb"
    assert html.links('<nav><a href="/x">X &amp; Y</a></nav>') == [(0, "X & Y", "/x")]
    assert html.people('<div class="team-member"><h3>Ann Lee</h3><p>CEO</p><p>Ann has led the firm for years.</p></div>') == [(0, "Ann Lee", "CEO", "Ann has led the firm for years.")]
    assert html.document_text("<p>a</p><table><tr><td>t</table><p>b\xa0c</p>", "\n", [0]) == "a\nb c"


def plain_chunks(text, target=512, overlap=64):
    paras, at = [], 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        raw = text[at : m.start() if m else len(text)]
        if raw.strip():
            words = raw.split()
            if len(words) > target:
                seek = 0
                for i in range(0, len(words), target):
                    piece = " ".join(words[i : i + target])
                    found = raw.strip().find(words[i], seek)
                    found = found if found >= 0 else seek
                    paras.append((at + found, piece, len(words[i : i + target])))
                    seek = found + len(piece)
            else:
                paras.append((at, raw.strip(), len(words)))
        at = m.end() if m else at
    out, cur, tok = [], [], 0
    for p in paras:
        if p[2] >= target and cur:
            out.append(cur)
            cur, tok = [], 0
        cur, tok = [*cur, p], tok + p[2]
        if tok >= target:
            out.append(cur)
            tail, n = [], 0
            for q in reversed(cur):
                if n >= overlap:
                    break
                tail, n = [q, *tail], n + q[2]
            cur, tok = (tail, n) if len(tail) < len(cur) else ([], 0)
    if cur:
        out.append(cur)
    return [("\n\n".join(p[1] for p in c), c[0][0], c[-1][0] + len(c[-1][1])) for c in out]


def test_chunks_like_a_loop(spark):
    rng = random.Random(8)
    texts = ["\n\n".join(" ".join(f"w{rng.randrange(9999)}" for _ in range(rng.choice([3, 40, 90, 200, 700, 1300]))) for _ in range(rng.randrange(1, 9))) for _ in range(25)] + ["", "  \n\n ", "one"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None])], "id LONG, text STRING, char_start INT")
    got = {}
    for r in corpus.chunks(df, ["id"]).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append((r["text"], r["char_start"], r["char_end"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_chunks(t), i
    assert len(texts) not in got


def test_sections(spark):
    text = "Cover\nItem 1. Business.\nold\nItem 2. Other\nx\nItem 1. Business.\nWe lend.\nItem 1A. Risk Factors.\nRisky."
    df = spark.createDataFrame([("d", text), ("plain", "just text"), ("null", None)], "doc_id STRING, text STRING")
    got = {(r["doc_id"], r["item"]): (r["title"], r["text"], r["char_start"]) for r in corpus.sections(df).collect()}
    assert got[("d", "1")][1] == "Item 1. Business.\nWe lend." and got[("d", "1")][2] == text.rindex("Item 1. ")
    assert got[("d", "FRONT")][1].startswith("Cover") and "old" in got[("d", "FRONT")][1]
    assert got[("plain", "FRONT")][1] == "just text" and ("null", "FRONT") not in got


def test_mentions(spark):
    text = "schedule of investments " + "Acme did. " + "x" * 600 + " risk of ACME  again"
    df = spark.createDataFrame([("d", text), ("none", "nothing"), ("null", None)], "doc_id STRING, text STRING")
    got = mentions.mentions(df, "acme", ["doc_id"]).orderBy("position").collect()
    assert [r["likely_section"] for r in got] == ["schedule_of_investments", "risk_factors"] and got[0]["position"] == 24
    assert mentions.outside_schedule(mentions.mentions(df, "acme", ["doc_id"])).count() == 1


def test_search_is_exact(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(vectors, "id LONG, vector ARRAY<DOUBLE>")
    queries = df.where("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.nearest(df, queries, 4, "id").collect()}
    for q, v in vectors[:5]:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if w is not None))[:4]
        assert [got[(q, k)] for k in range(1, 5)] == [i for _, i in best]
    with pytest.raises(Exception, match="too many queries"):
        search.nearest(df, queries, 4, "id", most_queries=2).collect()


def test_answers(spark):
    chunk = spark.createDataFrame([(1, "[a | Item 1 (B) | chars 0-9]", "We lend\nmoney.")], "rank INT, citation STRING, text STRING")
    quoted = search.answer(chunk, "What?", "abc").first()
    assert "We lend money. [1]" in quoted["text"] and not quoted["refused"] and quoted["citations"] == ["[a | Item 1 (B) | chars 0-9]"]
    asked = []
    said = search.answer(chunk, "What?", "abc", lambda p: asked.append(p) or "Loans [1].").first()
    assert said["llm_used"] and said["text"].startswith("Loans [1].") and "=== QUESTION ===\nWhat?" in asked[0]
    none = search.answer(chunk.where(F.lit(False)), "What?", "abc", lambda p: asked.append(p) or "x").first()
    assert none["refused"] and "ABC" in none["text"] and len(asked) == 1


def test_sites(spark):
    page = '<nav><a href="/about">About</a><a href="/about">Again</a><a href="https://b.example/">B</a><a href="/services">Work</a></nav><div class="team"><h3>Ann Lee</h3><p>President</p></div><h2>Pumps</h2><h2>Contact us</h2>'
    pages = spark.createDataFrame([("s", "https://a.example", page, 200), ("t", "https://c.example", None, 404)], "site STRING, base_url STRING, html STRING, status_code INT")
    links = site.menu_links(pages, ["site"])
    assert [(r["url"]) for r in links.orderBy("ord").collect()] == ["https://a.example/about", "https://a.example/services"]
    front = {(r["site"], r["url"]): r["type"] for r in site.frontier(links, pages, ["site"]).collect()}
    assert front[("s", "https://a.example/services/")] == "products" and ("t", "https://c.example/about-us/") in front
    assert site.products(pages, ["site"]).first()["products"] == ["Ann Lee", "Pumps"]
    leaders = site.leaders(pages, ["site"], ["site"])
    assert [(r["rank"], r["name"], r["tier"]) for r in site.executives(leaders, 3, ["ord"]).collect()] == [(1, "Ann Lee", 1)]
    assert {r["site"]: r["error"] for r in site.page_table(pages, ["site"]).collect()} == {"s": None, "t": "HTTP 404"}


def schedule_rows(spark, rows):
    names = ["company_name", "industry", "investment_category", "investment_type", "fair_value", "cost"]
    return spark.createDataFrame([("f", i, *r) for i, r in enumerate(rows, 1)], "filing_id STRING, row_no INT, " + ", ".join(f"{n} STRING" for n in names))


def test_ranking_and_ties(spark):
    df = schedule_rows(spark, [("A", "i", "c", "x", "10", "1"), ("B", "i", "c", "y", "10", "1"), ("A", "j", "c", "w", "—", "2"), (None, None, None, None, None, None)])
    top = analytics.top(analytics.company_totals(df, []), 3).orderBy("rank").collect()
    assert [(r["company_name"], r["total_fair_value"], r["investment_types"], r["industry"]) for r in top] == [("A", 10.0, "w; x", "i"), ("B", 10.0, "y", "i"), (None, 0.0, "", None)]
    empty = analytics.concentration(analytics.company_totals(df.where(F.lit(False)), ["filing_id"]), ["filing_id"], 10)
    assert empty.count() == 0
    with pytest.raises(Exception):
        analytics.company_totals(df.withColumn("fair_value", F.lit("12x")), [], exact=True).collect()


def test_rules(spark):
    many = [("Big", "i", "c", "x", "100", "1")] * 51
    df = schedule_rows(spark, [*many, (" ", "i", "c", "x", "1", "1"), ("i", "", "c", "x", "1", "1"), ("Big", "i", "d", "x", "bad", "1")])
    docs = spark.createDataFrame([("f",), ("empty",)], "filing_id STRING")
    issues = quality.report(df, ["filing_id"], docs)
    got = {r["code"]: (r["filing_id"], r["rows"]) for r in issues.collect()}
    assert set(got) == {c for c, _ in quality.RULES} - {"UNKNOWN_ROWS_PRESENT"}
    assert got["BLANK_COMPANY"] == ("f", [52]) and got["COMPANY_IS_INDUSTRY"] == ("f", [53]) and got["BLANK_INDUSTRY"] == ("f", [53]) and got["EMPTY_SCHEDULE"] == ("empty", [])
    assert {r["filing_id"]: r["ok"] for r in quality.verdicts(docs, issues, ["filing_id"]).collect()} == {"f": False, "empty": False}


def test_joins(spark):
    left = spark.createDataFrame([("a", 5, "l1"), ("a", None, "l2"), (None, 5, "l3"), ("b", 1, "l4")], "k STRING, t INT, v STRING")
    right = spark.createDataFrame([("a", 5, "r1", 1), ("a", 5, "r2", 2), ("a", 4, "r0", 9), ("b", 2, "r9", 1)], "k STRING, t INT, w STRING, n INT")
    got = {r["v"]: r["w"] for r in relational.as_of(left, right, ["k"], "t", ["w"], "n").collect()}
    assert got == {"l1": "r2", "l2": None, "l3": None, "l4": None}
    points = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (None,)], "x DOUBLE")
    ranges = spark.createDataFrame([(0.0, 10.0), (5.0, 25.0), (3.0, 3.0)], "lo DOUBLE, hi DOUBLE")
    assert sorted((r["x"], r["lo"]) for r in relational.in_ranges(points, ranges, "x", "lo", "hi", 7).collect()) == [(0.0, 0.0), (9.99, 0.0), (9.99, 5.0), (10.0, 5.0)]


def test_streams_like_batches(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    batch.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "events"))
    stream = E.stream_of(spark, str(tmp_path / "events"))
    got = E.drain(E.by_window(stream, "1 day"), "t_days", "complete", str(tmp_path / "c1"))
    want = E.by_window(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    carried = {r["event_id"]: r["last_ts"] for r in E.drain(E.last_seen(E.stream_of(spark, str(tmp_path / "events")), "signup"), "t_last", "append", str(tmp_path / "c2")).collect()}
    wanted = schedule.fill_down(batch.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], ["event_id"], {"x": F.when(F.col("event_type") == "signup", F.col("ts"))})
    assert carried == {r["event_id"]: r["x"] for r in wanted.collect()}


def test_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "abc.yaml").write_text('name: A B C\ncik: "0001"\nnotes:\n')
    assert tuple(files.profile(spark, str(tmp_path / "p"), "AbC").first()) == ("ABC", "A B C", "0001", None)
    with pytest.raises(ValueError, match="ABC"):
        files.profile(spark, str(tmp_path / "p"), "zz")
    made = []
    for _ in range(2):
        files.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or spark.range(3))
    assert len(made) == 1
    df = spark.createDataFrame([('A "x", B\nC', *[""] * 16)], ", ".join(f"`{c}` STRING" for c in files.SCHEDULE_COLUMNS))
    files.write_csv(df, str(tmp_path / "s"))
    assert files.read_schedule(spark, str(tmp_path / "s")).first()["company_name"] == 'A "x", B\nC'
    assert files.paths("raw", "data", "ABC", "In Duct!")["deepdive"] == "data/in_duct_filing_data.json"


def test_profile_with_a_block_of_text():
    from ledgerloom.sources.files import parse_profile

    assert parse_profile('name: Acme\ncik: "0001"\ncode: 007\nnotes: >\n  two\n  lines\nempty:\n') == {"name": "Acme", "cik": "0001", "code": "007", "notes": "two lines", "empty": None}


def test_people_in_cards_and_in_lines():
    from ledgerloom.sources.html import people

    card = '<div class="Team-card"><h3>Ann Lee</h3><p>Chief Executive</p><p>She founded the company long ago.</p></div><div class="staff"><h3>X</h3></div>'
    assert people(card) == [(0, "Ann Lee", "Chief Executive", "She founded the company long ago.")]
    assert people("<p>Ann Mary Lee | Director</p><p>no name here</p>") == [(0, "Ann Mary Lee", "Director", "")]
    assert people(None) == []


def test_empty_index_raises(spark):
    import pytest

    from ledgerloom.operators import search

    with pytest.raises(ValueError):
        search.index(spark.createDataFrame([], "chunk_id LONG, text STRING"))
