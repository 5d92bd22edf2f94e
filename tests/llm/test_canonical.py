import random

import pytest

from ledgerloom.llm import canonical as C
from ledgerloom.llm.automaton import Levels, Trie

ENTRIES = [(1, "Landscape Maintenance"), (2, "Medical Devices"), (3, "Pet Care"), (4, "Payroll Software"), (5, "Metal Fabrication"), (6, "Education and Training")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_exact():
    rng = random.Random(7)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(120)})
    trie = Trie()
    for w in words:
        trie.add(w, w)
    assert sorted(trie.paths()) == sorted(words)
    for _ in range(150):
        q, k = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))), rng.randrange(4)
        assert trie.search(q, k) == {w: distance(q, w) for w in words if distance(q, w) <= k}


def test_levels_give_what_the_trie_gives():
    rng = random.Random(5)
    trie = Trie()
    for i in range(200):
        trie.add("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))), i, rng.choice([None, 2, 3]))
    queries = ["".join(rng.choice("abcde") for _ in range(rng.randrange(0, 10))) for _ in range(300)] + ["ab" * 40]
    for k in range(4):
        for swaps in (False, True):
            assert Levels(trie).search(queries, k, swaps) == [trie.search(q, k, swaps) for q in queries]


@pytest.mark.parametrize(
    "text,value",
    [
        ("landscape maintenance", 1), (" Lqndscape Maintenance*", 1), ("maintenance, landscape", 1), ("Lndscp Mntnnc", 1), ("LANDSCAPE/MAINTENACE", 1), ("Landscape Maint. (12 units) (a)", 1), ("Devices, Medicl", 2), ("Mdcl-Device", 2),
        ("Pet Craes", 3), ("Pyrll S0ftware sector", 4), ("Payroll SW - US", 4), ("HR pay processing software", 4), ("Metal Fabric", 5), ("Educ. + Training", 6), ("n/a", 0), ("TBD", 0), ("Uranium Mining", 0), ("??", 0), ("x" * 5000, 0), ("Choral Music", 0),
    ],
)
def test_values(text, value):
    m = C.Matcher(ENTRIES)
    meant, likely, near = m.match_all([text])[0]
    assert (meant or likely) == value and m.match(text) == (meant, likely, near)
    assert meant == 0 or meant in dict(near)


def test_all_entries_in_reach_and_ties():
    m = C.Matcher([(1, "abcdefgh"), (2, "abcdefgx"), (3, "zzzzzzzz")])
    meant, _, near = m.match("abcdefgy")
    assert meant == 0 and dict(near) == {1: 1, 2: 1}
    assert m.match("abcdefgh")[0] == 1 and dict(m.match("abcdefgh")[2]) == {1: 0, 2: 1}


def test_known_aliases_are_paths():
    m = C.Matcher(ENTRIES, [("grass cutting", 1)])
    assert m.match("Grass Cuting")[0] == 1 and C.Matcher(ENTRIES).match("Grass Cuting")[0] == 0


def test_table(spark):
    reference = spark.createDataFrame([(i, "industry", n) for i, n in ENTRIES] + [(7, "investment_type", "First Lien Debt"), (8, "investment_type", None)], "value_id INT, field_name STRING, canonical STRING")
    rows = [(1, "Pet Cares", "1L TL"), (2, "Pet Care", "First Lien Debt"), (3, None, " 　"), (4, "Escrow", "first lien dbt"), (4, "Escrow", "first lien dbt"), (5, "", "Pet Care")]
    df = spark.createDataFrame([(*r, 0, None) for r in rows], "inv_id LONG, industry STRING, investment_type STRING, value_id INT, company_name STRING")
    got = sorted((r["inv_id"], r["field_name"], r["value_id"]) for r in C.free_entries(df, reference).collect())
    assert got == sorted([(1, "industry", 3), (1, "investment_type", 7), (4, "industry", 0), (4, "industry", 0), (4, "investment_type", 7), (4, "investment_type", 7), (5, "investment_type", 0)])
    assert C.free_entries(df.limit(0), reference).count() == 0
    assert C.free_entries(df, reference.limit(0)).where("value_id <> 0").count() == 0


@pytest.mark.parametrize("n_bytes", [1 << 20, -1])
def test_aliases_are_learnt_from_carriers(spark, monkeypatch, n_bytes):
    """A name that companies of one entry use is learnt; one that companies of all entries use is not."""
    monkeypatch.setattr(C, "BROADCAST_BYTES", n_bytes)
    reference = spark.createDataFrame([(i, "industry", n) for i, n in ENTRIES], "value_id INT, field_name STRING, canonical STRING")
    rows = [(c, ENTRIES[c % 6][1]) for c in range(60) for _ in range(3)]
    rows += [(c, "Lawn and grounds upkeep") for c in range(0, 60, 6)] + [(c, "Falconry") for c in range(12)] + [(0, "LAWN and grounds upkep (a)"), (None, "Lawn and grounds upkeep")]
    df = spark.createDataFrame([(i, v, f"company {c}" if c is not None else None) for i, (c, v) in enumerate(rows)], "inv_id LONG, industry STRING, company_name STRING")
    got = {(r["value"], r["value_id"]) for r in C.free_entries(df, reference, fields=("industry",)).collect()}
    assert got == {("Lawn and grounds upkeep", 1), ("Falconry", 0), ("LAWN and grounds upkep (a)", 1)}


@pytest.mark.parametrize("most", [2, 100_000])
def test_misspelt_aliases_are_found_however_many_are_learnt(spark, monkeypatch, most):
    """The answers are the same where more aliases are learnt than the reference list may have entries."""
    monkeypatch.setattr(C, "MOST_ENTRIES", most)
    monkeypatch.setattr(C, "ALIASES_IN_TRIE", min(most, 20_000), raising=False)
    reference = spark.createDataFrame([(i, "industry", n) for i, n in ENTRIES[:2]], "value_id INT, field_name STRING, canonical STRING")
    rows = [(c, ENTRIES[c % 2][1]) for c in range(40) for _ in range(3)]
    rows += [(c, v) for k, v in enumerate(("Lawn and grounds upkeep", "Stethoscopes", "Hedge trimming")) for c in range(k % 2, 40, 2)] + [(0, "Lawn and gruonds upkep"), (1, "stetoscopes (a)"), (2, "Hegde trimming - US"), (3, "Falconry")]
    df = spark.createDataFrame([(i, v, f"company {c}") for i, (c, v) in enumerate(rows)], "inv_id LONG, industry STRING, company_name STRING")
    got = {(r["value"], r["value_id"]) for r in C.free_entries(df, reference, fields=("industry",)).collect()}
    assert got == {("Lawn and grounds upkeep", 1), ("Stethoscopes", 2), ("Hedge trimming", 1), ("Lawn and gruonds upkep", 1), ("stetoscopes (a)", 2), ("Hegde trimming - US", 1), ("Falconry", 0)}


def test_slices_give_what_one_search_gives(spark):
    """Values whose entries are tied, or that are aliases only in another form, against one trie of entries and aliases."""
    entries = [(1, "abcdefgh"), (2, "abcdefgx"), (3, "zzzzzzzz")]
    names = [("abcdefgy", 3), ("klmnopqr", 1), ("klmnopqs", 2), ("uvwxyzab cd", 3), ("abcdefgh qq", 3)]
    texts = ["abcdefgy", "abcdefgw", "klmnopqt", "klmnopqr - US", "uvwxyzab cdx (a)", "abcdefgq - qq", "abcdefgh, qqq", "klmnopqs (b) - nn", "nothing"]
    want = {t: C.Matcher(entries, names).match(t) for t in texts}
    distinct = spark.createDataFrame([("f", t) for t in texts], "f STRING, v STRING")
    learnt = spark.createDataFrame([("f", k, i) for k, i in names], "f STRING, key STRING, value_id INT")
    open_ = C.searched(distinct, {"f": entries}, {}).where("value_id = 0")
    for most in (1, 2, 100):
        for r in C.taught(open_, learnt, most).collect():
            assert (r["value_id"], r["likely"], tuple((x["value_id"], x["distance"]) for x in r["near"])) == want[r["v"]], r["v"]
