"""Problem 1: freely entered values mapped to the entries of a reference list.

All reference entries of a field lie in one trie: whole, with their words in turned order, and with their aliases. A second trie holds
the words of the entries with alias paths of their own: consonants, any beginning, ordinals as numbers and initials of neighbouring
words. A value and its words are searched with a Levenshtein automaton; every entry within a distance that depends on the length is
returned, and the one of least distance is meant. Where no entry is in reach, the one whose words the value has for the largest part is
meant, if that is enough; any other value, and one with two entries at the same distance, is unmatched.

Aliases are an input, and are learnt from the data besides: a value that no path reaches is another name of an entry if the companies
that carry it carry, in their other rows, mostly that entry.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.automaton import Levels, Trie
from ledgerloom.session import cut, widely

#: Ordinals as filers write them.
ORDINALS = {"first": ["1st", "1"], "second": ["2nd", "2"], "third": ["3rd", "3"], "fourth": ["4th", "4"]}
VOWELS = re.compile(r"(?<=.)[aeiou]")
#: What stands behind an entry in brackets, behind a dash, or as a mark of a footnote.
BRACKETED = re.compile(r"\s*\([^()]*\)\s*[*;.:†‡]*$")
DASHED = re.compile(r"(?:\s+[-–]\s+|,\s*|\s*[-–]\s*)[^-–,()]{1,12}$")
#: The share of an entry's words, by how much they tell, that a value must have to mean it.
COVERAGE = 0.4
#: A learnt alias: so many companies at least, and this share of them with one entry.
LEAST_COMPANIES, LEAST_SHARE, EVIDENCE = 3, 0.6, 9.0
MOST_ENTRIES = 100_000
#: A trie holds about so many learnt aliases; more are searched in slices.
ALIASES_IN_TRIE = 20_000
#: Answers of up to so many bytes are sent to every task.
BROADCAST_BYTES = 64 << 20


def plain(text: str) -> str:
    """Lower case without accents, with single spaces."""
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", t).strip()


def bared(text: str) -> list[str]:
    """The plain text, and what is left of it without brackets at its end, then without a short part behind a dash or comma."""
    t = plain(text)
    out = [t]
    while True:
        u = BRACKETED.sub("", out[-1]).strip(" *;.:†‡")
        if not u or u == out[-1]:
            break
        out.append(u)
    u = DASHED.sub("", out[-1]).strip()
    return out + [u] * (u not in ("", out[-1]))


def key_of(text: str) -> str:
    """What two writings of the same value have in common: the words without brackets at the end."""
    t = plain(text)
    while (u := BRACKETED.sub("", t).strip(" *;.:†‡")) and u != t:
        t = u
    return " ".join(words_of(t))


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.replace("'", "").replace("&", " and ").replace("+", " and "))


def reach(length: int) -> int:
    """The distance that a value of so many characters may have."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 11 else 3


def word_reach(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


class Matcher:
    """The tries of one field's reference entries. aliases: (name, value_id) of other names."""

    def __init__(self, entries: list[tuple[int, str]], aliases: list[tuple[str, int]] = ()):
        self.whole, self.words = Trie(), Trie()
        self.exact: dict[str, set[int]] = {}
        self.entries: dict[int, list[str]] = {}
        having: dict[str, set[int]] = {}
        for value, name in entries:
            words = words_of(plain(name))
            if not words:
                continue
            self.entries[value] = words
            for order in {tuple(words), tuple(words[1:] + words[:1]), tuple(words[-1:] + words[:-1])}:
                self.whole.add("".join(order), value, len("".join(order)) - len(order[-1]) + 2 if len(order) > 1 else None)
            if len(bare := "".join(VOWELS.sub("", w) for w in words)) > 5:
                self.whole.add(bare, value)
            for w in words:
                having.setdefault(w, set()).add(value)
        for name, value in (*((name, value) for value, name in entries), *aliases):
            whole = "".join(words_of(plain(name)))
            self.exact.setdefault(whole, set()).add(value)
            self.whole.add(whole, value)
        self.having = having
        n = len(self.entries)
        self.weight = {w: math.log((n + 1) / len(v)) * (len(w) > 3) for w, v in having.items()}
        self.by_letter: dict[str, list[str]] = {}
        for w in having:
            self.words.add(w, w, 3)
            if len(w) >= 4 and len(bare := VOWELS.sub("", w)) >= 3:
                self.words.add(bare, w, 3)
            for other in ORDINALS.get(w, []):
                self.words.add(other, w)
            self.by_letter.setdefault(w[0], []).append(w)
        # initials of neighbouring words stand for all of them, unless two runs of words have the same
        initials: dict[str, set[tuple[str, ...]]] = {}
        for words in self.entries.values():
            for a in range(len(words) - 1):
                for b in range(a + 2, len(words) + 1):
                    run = tuple(words[a:b])
                    initials.setdefault("".join(w[0] for w in run), set()).add(run)
                    for other in ORDINALS.get(run[0], []):
                        initials.setdefault(other[0] + "".join(w[0] for w in run[1:]), set()).add(run)
        self.initials = {i: next(iter(runs)) for i, runs in initials.items() if len(runs) == 1}
        self.all_whole, self.all_words = Levels(self.whole), Levels(self.words)
        self.whole_found: dict[str, dict[int, float]] = {}
        self.word_found: dict[str, dict[str, float]] = {}

    def match_all(self, texts: list[str]) -> list[tuple[int, int, tuple[tuple[int, float], ...]]]:
        """match of each text; their words, and then the texts themselves, are searched together."""
        if len(self.whole_found) + len(self.word_found) > 400_000:
            self.whole_found, self.word_found = {}, {}
        tokens: dict[str, None] = {}
        wholes: dict[str, None] = {}
        for text in texts:
            for t in bared(text):
                words = words_of(t)
                tokens.update(dict.fromkeys((*words, *map("".join, zip(words, words[1:])))))
            wholes.update(dict.fromkeys("".join(words_of(t)) for t in self.forms(text)[:1]))
        for found, levels, asked, most in ((self.word_found, self.all_words, tokens, word_reach), (self.whole_found, self.all_whole, wholes, reach)):
            by_most: dict[int, list[str]] = {}
            for q in asked:
                if q not in found:
                    by_most.setdefault(most(len(q)), []).append(q)
            for k, queries in by_most.items():
                found.update(zip(queries, levels.search(queries, k, swaps=True)))
        return [self.match(t) for t in texts]

    @staticmethod
    def forms(text: str) -> list[str]:
        """The writings of a value that are searched, one after the other: without brackets at the end, then without what a dash adds."""
        forms = bared(text)
        return [t for i, t in enumerate(forms) if i + 1 == len(forms) or not BRACKETED.search(t)]

    def within(self, text: str) -> dict[int, float]:
        """All entries within the distance of a value, with their distances: edits of the whole, or of its words.

        Brackets at the end are left out first, and what stands behind a dash only where nothing is in reach with it.
        """
        out: dict[int, float] = {}
        for _, found in self.by_form(text):
            for value, cost in found.items():
                out[value] = min(cost, out.get(value, 1e9))
        return out

    def by_form(self, text: str) -> list[tuple[int, dict[int, float]]]:
        """(the number of a form, the entries in its reach with their distances): -1 for what any form is exactly, and the first form; else the first form that has any."""
        exact = {value: 0.0 for t in bared(text) for value in self.exact.get("".join(words_of(t)), ())}
        got = [(-1, exact)] if exact else []
        for i, t in enumerate(self.forms(text)):
            words = words_of(t)
            out: dict[int, float] = {}
            whole = "".join(words)
            most = reach(len(whole))
            if whole not in self.whole_found:
                self.whole_found[whole] = self.whole.search(whole, most, swaps=True)
            for value, cost in self.whole_found[whole].items():
                out[value] = min(cost, out.get(value, 1e9))
            for value, cost in self.by_words(words).items():
                if cost <= max(most, 1) + 1:
                    out[value] = min(cost, out.get(value, 1e9))
            if out:
                got.append((i, out))
            if got:
                break
        return got

    @lru_cache(200_000)  # noqa: B019
    def word(self, token: str) -> dict[str, float]:
        """Words of the reference that a token may be, with their distances."""
        most = word_reach(len(token))
        if token not in self.word_found:
            self.word_found[token] = self.words.search(token, most, swaps=True)
        found = dict(self.word_found[token]) if len(token) > 1 or token.isdigit() else {}
        if most < 2:  # a short token is either misspelt or the beginning of a word
            found = {w: c for w, c in found.items() if c <= 1}
        if token in self.initials:
            found.update(dict.fromkeys(self.initials[token], 0.5))
        if not found and len(token) > 2:  # letters of a word in their order, the first one included
            for w in self.by_letter.get(token[0], []):
                rest = iter(w)
                if len(token) * 4 >= len(w) and all(c in rest for c in token):
                    found[w] = 1.5
        return found

    def _tokens(self, words: list[str]) -> list[tuple[dict[str, float], int]]:
        """(words that it may be, its length) of each token; two neighbours that are one word only together count as one."""
        out, i = [], 0
        while i < len(words):
            joined = self.word(words[i] + words[i + 1]) if i + 1 < len(words) else {}
            apart = self.word(words[i])
            if joined and (not apart or not self.word(words[i + 1])) and min(joined.values()) <= 1:
                out.append((joined, len(words[i]) + len(words[i + 1])))
                i += 2
            else:
                out.append((apart, len(words[i])))
                i += 1
        return out

    def by_words(self, words: list[str]) -> dict[int, float]:
        """The distances of the entries all of whose words are among those of a value, and of which it has no others."""
        tokens = self._tokens(words)
        if not tokens or not all(t for t, _ in tokens):
            return {}
        out = {}
        for value in set.union(*(self.having[w] for t, _ in tokens for w in t)):
            own = self.entries[value]
            best = [min((t[w] for t, _ in tokens if w in t), default=None) for w in own]
            if None not in best and all(any(w in t for w in own) for t, _ in tokens):
                out[value] = sum(best)
        return out

    def covered(self, words: list[str]) -> int:
        """The entry of whose words a value has the largest share, if that is unique and enough; else 0."""
        shares: dict[int, tuple[float, float]] = {}
        tokens = [(t, n) for t, n in self._tokens(words) if n > 3 or any(c <= 0.5 for c in t.values())]
        best: dict[str, float] = {}
        for t, _ in tokens:
            for w, c in t.items():
                best[w] = min(c, best.get(w, 1e9))
        for value in set().union(*(self.having[w] for w in best)) if best else ():
            own = self.entries[value]
            total = sum(self.weight[w] for w in own)
            got = sum(self.weight[w] * (1 - 0.1 * best[w]) for w in own if w in best)
            if total and got / total >= COVERAGE:
                shares[value] = got / total
        top = sorted(shares.items(), key=lambda x: -x[1])[:2]
        return top[0][0] if top and (len(top) == 1 or top[0][1] > top[1][1] + 0.02) else 0

    def match(self, text: str) -> tuple[int, int, tuple[tuple[int, float], ...]]:
        """(the entry of least distance, or 0; else the entry most of whose words the value has; all entries within its distance)."""
        near = self.within(text)
        least = min(near.values(), default=0)
        first = [v for v, c in near.items() if c == least]
        meant = first[0] if len(first) == 1 else 0
        likely = 0 if near else next((v for t in bared(text) if (v := self.covered(words_of(t)))), 0)
        return meant, likely, tuple(sorted(near.items()))


def _lists(rows: DataFrame, field: str, value: str, name: str) -> dict[str, list[tuple[int, str]]]:
    got = rows.select(field, value, name).where(f"{name} IS NOT NULL AND {value} IS NOT NULL").limit(MOST_ENTRIES + 1).collect()
    if len(got) > MOST_ENTRIES:
        raise ValueError("the reference list is too long to be held by each task")
    out: dict[str, list[tuple[int, str]]] = {}
    for f, i, c in sorted(got, key=lambda r: (str(r[0]), r[1], r[2])):
        out.setdefault(f, []).append((i, c))
    return out


ANSWER = "f string, v string, key string, value_id int, likely int, near array<struct<value_id:int,distance:double>>, form int"


def searched(distinct: DataFrame, lists: dict[str, list[tuple[int, str]]], aliases: dict[str, list[tuple[int, str]]]) -> DataFrame:
    """(f, v, key, value_id, likely, near, form) of distinct (f, v): the entry of least distance, that of most words, all in the distance
    of the value; where these are tied, the number of the form that has them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers: dict[str, Matcher] = {}
        for batch in batches:
            for f, own in batch.groupby("f"):
                values = own["v"].tolist()
                if f in lists and f not in matchers:
                    matchers[f] = Matcher(lists[f], [(name, i) for i, name in aliases.get(f, [])])
                got = matchers[f].match_all(values) if f in lists else [(0, 0, ())] * len(values)
                form = lambda v, tied: matchers[f].by_form(v)[0][0] if tied else 0  # noqa: B023, E731
                rows = [(f, v, key_of(v), meant, likely, [{"value_id": i, "distance": float(c)} for i, c in near], form(v, near and not meant)) for v, (meant, likely, near) in zip(values, got)]
                yield pd.DataFrame(rows, columns=["f", "v", "key", "value_id", "likely", "near", "form"])

    return distinct.mapInPandas(run, ANSWER)


def learnt_aliases(named: DataFrame) -> DataFrame:
    """(f, key, value_id): values that no path reaches, as other names of the entry that their carriers mostly have.

    named: f, by (the carrier, such as a company), key, value_id of each row. A carrier speaks for the entry that most of its reached
    rows have; a value is an alias if at least LEAST_COMPANIES carriers have it, LEAST_SHARE of them speak for one entry, and that is
    no chance: the log likelihood against the entry's share of all carriers is EVIDENCE at least. Counts are summed before they are
    shuffled; a carrier speaks for one entry only, so no join makes pairs.
    """
    named = named.where("by IS NOT NULL").withColumn("by", F.xxhash64("by"))
    of = named.where("value_id > 0").groupBy("f", "by", "value_id").agg(F.count("*").alias("n"))
    speaks = of.groupBy("f", "by").agg(F.max_by("value_id", F.struct("n", -F.col("value_id"))).alias("value_id"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most * 2 > all").select("f", "by", "value_id")
    speaks = cut(speaks)
    usual = speaks.groupBy("f", "value_id").agg(F.count("*").alias("carriers"))
    everyone = usual.groupBy("f").agg(F.sum("carriers").alias("everyone"))
    asked = named.where("value_id = 0 AND key <> ''").select("f", "key", "by").distinct()
    votes = asked.join(speaks, ["f", "by"]).groupBy("f", "key", "value_id").agg(F.count("*").alias("n"))
    won = votes.groupBy("f", "key").agg(F.max_by("value_id", F.struct("n", -F.col("value_id"))).alias("value_id"), F.max("n").alias("most"), F.sum("n").alias("all"))
    likely = F.col("most") * F.log(F.col("most") / F.col("all") * F.col("everyone") / F.col("carriers"))
    won = won.where((F.col("all") >= LEAST_COMPANIES) & (F.col("most") >= LEAST_SHARE * F.col("all")))
    return won.join(usual, ["f", "value_id"]).join(everyone, "f").where(likely >= EVIDENCE).select("f", "key", "value_id")


def among_aliases(values: DataFrame, learnt: DataFrame, most: int) -> DataFrame:
    """(f, v, form, value_id, distance): the learnt aliases (f, key, value_id) in reach of distinct (f, v).

    They are searched in a grid: each cell holds the trie of a slice of about most aliases and reads a part of the values in batches, so no
    task grows with the aliases, and none is left out.
    """
    slices = max(1, math.ceil(learnt.count() / most))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n, c: F.pmod(F.xxhash64("f", c), F.lit(n)).cast("int")
    names = learnt.select("f", F.col("key").alias("v"), "value_id", at(slices, "key").alias("i"), every(parts).alias("j"))
    asked = values.select("f", "v", F.lit(0).alias("value_id"), every(slices).alias("i"), at(parts, "v").alias("j"))
    cells = names.union(asked).select(F.xxhash64("f", "i", "j").alias("cell"), "f", "v", "value_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, names, matcher = None, [], None
        for batch in batches:
            rows = []
            for now, own in batch.groupby("cell", sort=False):
                if now != cell:
                    cell, names, matcher = now, [], None
                known = own["value_id"] > 0
                names += zip(own["v"][known], own["value_id"][known].tolist())
                texts = own["v"][~known].tolist()
                if texts and names:
                    matcher = matcher or Matcher([], names)
                    matcher.match_all(texts)
                    rows += [(f, v, form, i, float(c)) for f, v in zip(own["f"][~known], texts) for form, found in matcher.by_form(v) for i, c in found.items()]
            yield pd.DataFrame(rows, columns=["f", "v", "form", "value_id", "distance"])

    # the rows of a cell stand together in a sorted partition, its aliases first
    ordered = widely(cells, "cell").sortWithinPartitions("cell", F.desc("value_id"))
    return ordered.mapInPandas(run, "f string, v string, form int, value_id int, distance double")


def taught(open_: DataFrame, learnt: DataFrame, most: int) -> DataFrame:
    """open_, answers without an entry, as they are with the learnt aliases besides: the same as one search of entries and aliases."""
    hits = among_aliases(open_.select("f", "v"), learnt, most).groupBy("f", "v").agg(F.collect_list(F.struct("form", "value_id", "distance")).alias("hits"))
    first = F.transform("near", lambda x: F.struct(F.col("form").alias("form"), x["value_id"].alias("value_id"), x["distance"].alias("distance")))
    found = open_.join(hits, ["f", "v"], "left").withColumn("all", F.when(F.col("hits").isNull(), first).otherwise(F.concat(first, "hits")))
    found = found.withColumn("form", F.array_min(F.transform("all", lambda x: x["form"])))
    # what a form is exactly goes with the first form; of the others only the first that has any counts
    found = found.withColumn("all", F.filter("all", lambda x: (x["form"] == F.col("form")) | (F.col("form") <= 0) & (x["form"] <= 0)))
    nearest = lambda i: F.array_min(F.transform(F.filter("all", lambda x: x["value_id"] == i), lambda x: x["distance"]))
    found = found.withColumn("near", F.transform(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["value_id"]))), lambda i: F.struct(i.alias("value_id"), nearest(i).alias("distance"))))
    least = F.array_min(F.transform("near", lambda x: x["distance"]))
    found = found.withColumn("best", F.filter("near", lambda x: x["distance"] == least))
    meant = F.when(F.size("best") == 1, F.get("best", F.lit(0))["value_id"]).otherwise(0)
    return found.select("f", "v", meant.alias("value_id"), F.when(F.size("near") == 0, F.col("likely")).otherwise(0).alias("likely"), "near")


def attached(rows: DataFrame, field: str, value: str, answers: DataFrame, n_bytes: int, salts: int = 8) -> DataFrame:
    """rows left-joined with answers (f, v, ...): sent to every task while small, else shuffled with salted keys, so that a value of a
    third of all rows is spread over salts tasks."""
    named = answers.withColumnsRenamed({"f": "__f", "v": "__v"})
    same = (F.col(field) == F.col("__f")) & (F.col(value) == F.col("__v"))
    if n_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(named), same, "left").drop("__f", "__v")
    named = named.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return salted.join(named, same & (F.col("__salt") == F.col("__s")), "left").drop("__f", "__v", "__s", "__salt")


def map_values(values: DataFrame, reference: DataFrame, field: str = "field_name", value: str = "value", by: str | None = None, teachers: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """values, value_id and near: the entry of reference (value_id, field_name, canonical) of the same field that is meant, or 0, and all
    entries within the distance of the value with their distances.

    aliases: (field_name, value_id, alias) other names that are known. by: the column whose groups teach further ones, in the rows of
    teachers, or of values if none are given. A null or blank value, and a value of a field that the reference list lacks, has 0. Each
    distinct value is searched once, and the answers go back to the rows in a join. The reference list and the aliases are held by
    each task, some 200 trie nodes for an entry; more than MOST_ENTRIES entries raise. Learnt aliases are searched like these, however
    many there are.
    """
    lists = _lists(reference, field, "value_id", "canonical")
    known = _lists(aliases, field, "value_id", "alias") if aliases is not None else {}
    own = values.select(F.col(field).alias("f"), F.col(value).alias("v"))
    more = teachers.select(F.col(field).alias("f"), F.col(value).alias("v"), F.col(by).alias("by")) if by and teachers is not None else own.withColumn("by", values[by]) if by else None
    both = own if teachers is None or not by else own.union(more.select("f", "v"))
    answers = cut(searched(widely(both.where("f IS NOT NULL AND v IS NOT NULL").distinct(), "v"), lists, known))
    n, chars = answers.agg(F.count("*"), F.coalesce(F.sum(F.length("v") + F.length("key")), F.lit(0))).first()
    n_bytes = 120 * n + 2 * chars
    if by:
        learnt = cut(learnt_aliases(attached(more, "f", "v", answers.select("f", "v", "key", "value_id"), n_bytes)))
        done, open_ = answers.where("value_id > 0"), answers.where("value_id = 0")
        answers = done.select("f", "v", "value_id", "likely", "near").unionByName(cut(taught(open_, learnt, ALIASES_IN_TRIE)))
    meant = F.when(F.col("value_id") > 0, F.col("value_id")).otherwise(F.col("likely"))
    joined = attached(values, field, value, answers.select("f", "v", meant.alias("__id"), F.col("near").alias("__near")), n_bytes)
    nothing = F.array().cast("array<struct<value_id:int,distance:double>>")
    return joined.select(*values.columns, F.coalesce("__id", F.lit(0)).alias("value_id"), F.coalesce("__near", nothing).alias("near"))


def entries_of(investments: DataFrame, fields: tuple[str, ...] = ("industry", "investment_type"), key: str = "inv_id", by: str | None = None) -> DataFrame:
    """(key, field_name, value[, by]) of each field of each row."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))
    more = [by] if by else []
    return investments.select(key, *more, F.explode(pairs).alias("e")).select(key, "e.field_name", "e.value", *more)


def free_entries(investments: DataFrame, reference: DataFrame, fields: tuple[str, ...] = ("industry", "investment_type"), key: str = "inv_id", by: str | None = "company_name", aliases: DataFrame | None = None) -> DataFrame:
    """(key, field_name, value, value_id, near) of the entries that are neither null nor blank nor an entry of the list, byte for byte.

    Entries of the list byte for byte teach aliases, too.
    """
    filled = entries_of(investments, fields, key, by).where(r"value RLIKE '[^\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'")
    listed = reference.select("field_name", F.col("canonical").alias("value")).distinct()
    free = filled.join(F.broadcast(listed), ["field_name", "value"], "left_anti").select(*filled.columns)
    return map_values(free, reference, by=by, teachers=filled, aliases=aliases).select(key, "field_name", "value", "value_id", "near")
