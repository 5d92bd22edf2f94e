import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import mainbody as M

SCHEMA = "page_id LONG, website STRING, company_name STRING, title STRING, status_code INT, clean_text STRING, path STRING, k STRING, h INT, n INT"
#: An invented language: what its sites say, and the words of its prose.
MENU, FOOTER, CONSENT = ["Tirro", "Vasko", "Nemmu", "Oldra"], ["© 2019 {}. Sokku vanderi tol.", "Hemmi Sokku", "Rullen 555-01{:02d}", "Ossa lu tirrom"], ["Vi sokku aldem", "Nerru", "Ottar"]
WIDGETS = [["Dallu tem »"], ["Ruskan tem?", "Ja", "Nu"], ["Prosku…"]]
HEADINGS = ["Vot lurra", "Kandra", "Sem vollo"]
WORDS = "lurra vollo kandrem osti tulle varo semmu dorra hilde nokk ullum fesser brande".split()


def invented(host: str, n: int, seed: int):
    """(page_id, host, company, title, status, text) of pages with their body's line numbers."""
    rng = random.Random(seed)
    name = lambda: rng.choice("BDFGKL") + "".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3))
    prose = lambda: " ".join(f"{name()} {' '.join(rng.choices(WORDS, k=9))} {rng.randint(2, 99)}." for _ in range(rng.randint(1, 3)))
    company = name()
    titles = [f"Nol {name()} vest {name()}" for _ in range(n)]
    for i in range(n):
        lines = [*(CONSENT if rng.random() < 0.5 else []), *MENU]
        main = [len(lines)]
        lines.append(titles[i])

        def own(line):
            main.append(len(lines))
            lines.append(line)

        for _ in range(rng.randint(3, 5)):
            if rng.random() < 0.5:
                own(rng.choice(HEADINGS))
            own(prose())
            for _ in range(rng.choice([0, 0, 3, 4])):
                own(f"{rng.randint(3, 99)} osti {name()} vella")
            if rng.random() < 0.2:
                lines += rng.choice(WIDGETS)
        if rng.random() < 0.5:
            lines += ["Semna lu", *rng.sample(titles[:i] + titles[i + 1 :], 3)]
        lines += [FOOTER[0].format(company), FOOTER[1], FOOTER[2].format(seed), FOOTER[3]]
        yield (seed * 1000 + i, host, company, f"{titles[i]} - {company}" if rng.random() < 0.9 else None, 200, "\n".join(lines)), [m + 1 for m in main]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def sites():
    return [x for s in range(1, 13) for x in invented(f"site{s}", 30, s)]


def test_a_language_nobody_listed(spark, sites):
    want = {(p[0], n) for p, lines in sites for n in lines}
    got = {tuple(r) for r in M.main_lines(frame(spark, [p for p, _ in sites])).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(want & got) >= 0.97 * len(got)


def test_buckets_and_joins_change_nothing(spark, sites, monkeypatch):
    pages = frame(spark, [p for p, _ in sites[:120]])
    want = {tuple(r) for r in M.main_lines(pages).collect()}
    monkeypatch.setattr(M, "BUCKET_PAGES", 7)
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in M.main_lines(pages).collect()} == want


def test_rows_without_body_and_repeated_rows(spark, sites):
    page = sites[0][0]
    rows = [page, page, (-1, None, None, None, None, page[5]), (-2, "h", "c", "t", 404, "Tirro\nNot here\nOttar"), (-3, "h", "c", "t", 200, None), (-4, "h", "c", "t", 200, ""), (-5, "h", "c", "t", 200, " \n\n")]
    got = {}
    for r in M.main_lines(frame(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r["line_no"])
    assert sorted(got) == [-1, page[0]]
    lines = sorted(got[page[0]])
    assert lines[::2] == lines[1::2] and len(set(lines)) * 2 == len(lines)
    text = M.main_text(frame(spark, rows[2:3])).first()["main_text"]
    assert set(text.split("\n")) <= set(page[5].split("\n"))
    assert M.main_lines(frame(spark, rows).where(F.lit(False))).count() == 0


def test_repeated_sentence_is_the_sites(spark):
    own = "We ship pump number {} on the day it is ordered, whatever the weather may be."
    rows = [(i, "h", "C", f"Page {i} - C", 200, f"Page {i}\n{own.format(i)}\nCall the desk of this town before you travel to us.") for i in range(8)]
    got = {(r["page_id"], r["line_no"]) for r in M.main_lines(frame(spark, rows)).collect()}
    assert got == {(i, n) for i in range(8) for n in (1, 2)}


def test_hash_is_that_of_spark(spark):
    for text in ("", "Kandra 12", "“Ünïcode” 字"):
        assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == M.hashed(text)
    assert xxhash.xxh64_intdigest(b"a", 1) != xxhash.xxh64_intdigest(b"a", 42)
