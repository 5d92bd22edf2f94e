"""Problem 2: the main body of a web page without what its site puts around and between it.

The text of a page has lost its tags, so a line stands for a container and its generalised text (numbers and names replaced) for the
path of tags and classes. Every page scores its containers: where they stand to its title and its prose, what follows them, and what
their neighbours are. In Spark the pages of a host, and all hosts together, vote on the paths; the lines are then extracted again by
the paths that won. No phrase of any site or language is known beforehand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut, spread

SENTENCE_END = re.compile(r"[.!?…。！？।؟۔][\"'”’»)\]」』）]*$")
QUOTED = re.compile(r"^[“\"«„「『].*[”\"»“」』]$")
BYLINE = re.compile(r"^(?:[^\W\d_a-z]\.\s?)+[^\W\d_a-z][\w'’-]+, [\w ]+$")
NUMBER = re.compile(r"\d[\d.,]*")
NAME = re.compile(r"\b[^\W\d_a-zß-ÿ][^\W\d_A-ZÀ-Þ]{4,}\b")
#: A line that ends as a sentence is prose from so many characters on; a line of LONG characters is prose however it ends.
PROSE_CHARS, LONG = 28, 120
#: The length at which the crawler cuts texts, less the white space it may have trimmed: the last line of such a text is unfinished.
CUT_AT = 2990
#: A host's pages: a bucket has about as many, so what is known of its paths is bounded however large the host is.
BUCKET_PAGES = 1000
SIGNS = 8
#: From so many bytes on, what is known of hosts is joined by a shuffle instead of being sent to every task.
BROADCAST_BYTES = 64 << 20
#: How the votes are read. LEAST: fewer occurrences decide nothing; BACKING: how many occurrences all hosts weigh beside those of one host.
LEAST, BACKING = 4, 8
BODY_SHARE, FIXED_NEIGHBOUR, HEADING, BETWEEN, VERBATIM, TITLE_SHARE = 0.3, 0.7, 0.88, 0.4, 0.8, 0.1
SITE_PAGES, SITE_SHARE = 3, 0.2
DROP, UNKNOWN, KEEP, TITLE = 0, 1, 2, 3


def hashed(text: str, seed: int = 42) -> int:
    """The hash that Spark's xxhash64 gives a string."""
    h = xxhash.xxh64_intdigest(text.encode(), seed)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(200_000)
def path(line: str) -> int:
    """The hash of the generalised line, without its two lowest bits. Only lines of three words or more have names replaced."""
    g = NUMBER.sub("0", line)
    if len(line.split()) > 2:
        g = NAME.sub("X", g)
    return hashed(g.lower(), 1) & ~3


def is_prose(line: str) -> bool:
    return len(line) >= LONG or len(line) >= PROSE_CHARS and SENTENCE_END.search(line) is not None


def own_title(title: str | None, company: str | None) -> str | None:
    """A page's title without the name of its site."""
    if not title or not title.strip():
        return None
    t = title.strip()
    if company and company.strip() and t.endswith(company.strip()):
        t = re.sub(r"\s*[-–|·]\s*$", "", t[: len(t) - len(company.strip())])
    elif " - " in t:
        t = t.rsplit(" - ", 1)[0]
    return t.strip()


def outline(text: str, site: frozenset) -> tuple[list[str], list[str]]:
    """(lines without white space at their ends, kind of each): P prose, Q quotation or its byline, S prose of the site, C a line cut off, s short, '' blank."""
    raw = text.split("\n")
    lines = [x.strip() for x in raw]
    kinds = []
    for i, line in enumerate(lines):
        if not line:
            kind = ""
        elif QUOTED.match(line) or kinds and kinds[-1] == "Q" and BYLINE.match(line):
            kind = "Q"
        elif is_prose(line):
            kind = "S" if site and hashed(raw[i]) in site else "P"
        else:
            kind = "s"
        kinds.append(kind)
    if len(text) >= CUT_AT and kinds[-1]:
        kinds[-1] = "C"
    return lines, kinds


def title_at(lines: list[str], first_prose: int, wanted: str | None) -> int | None:
    """Where the page's own title stands: the last such line before its prose, else the first one anywhere."""
    if not wanted:
        return None
    at = [i for i, line in enumerate(lines) if line == wanted]
    return ([i for i in at if i < first_prose] or at[:1] or [None])[-1]


def score_page(text: str, title: str | None, company: str | None, status: int | None, site: frozenset) -> list[tuple]:
    """(path, line, counted, body, before prose, own title, line after, line before) of each short line; 0 where there is no short neighbour."""
    lines, kinds = outline(text, site)
    prose = [i for i, k in enumerate(kinds) if k in ("P", "Q")]
    if not prose or status is not None and status >= 400:
        return []
    at = title_at(lines, prose[0], own_title(title, company))
    start, end = at if at is not None else prose[0], prose[-1]
    out, live = [], [i for i, k in enumerate(kinds) if k]
    for n, i in enumerate(live):
        if kinds[i] != "s":
            continue
        p = path(lines[i])
        if i == at:
            out.append((p, 0, 0, 0, 0, 1, 0, 0))
        elif at is not None or i > start:
            after = live[n + 1] if n + 1 < len(live) else None
            before = live[n - 1] if n else None
            body = start < i < end
            ahead = hashed(lines[after]) if after is not None and kinds[after] in ("s", "S") else 0
            behind = hashed(lines[before]) if before is not None and before != at and kinds[before] in ("s", "S", "C") else 0
            out.append((p, hashed(lines[i]), 1, body, body and kinds[after] in ("P", "Q"), 0, ahead, behind))
    return out


def extract(text: str, title: str | None, company: str | None, status: int | None, site: frozenset, verdicts: dict[int, int]) -> list[int]:
    """The numbers of the lines of the main body, by what the votes say of each path."""
    lines, kinds = outline(text, site)
    said = [None if not k else KEEP if k in ("P", "Q") else DROP if k == "S" else UNKNOWN if k == "C" else verdicts.get(path(line), UNKNOWN) for k, line in zip(kinds, lines)]
    prose = [i for i, k in enumerate(kinds) if k in ("P", "Q")]
    if not prose or status is not None and status >= 400 and len(prose) < 2:
        return []
    at = title_at(lines, prose[0], own_title(title, company))
    if at is None:
        titles = [i for i in range(prose[0]) if said[i] == TITLE]
        at = titles[-1] if titles else prose[0]
        while not titles and at > 0 and said[at - 1] in (UNKNOWN, KEEP):
            at -= 1
    out, last = [], True
    for i in range(at, len(lines)):
        if said[i] is None:
            continue
        if i == at or said[i] == KEEP:
            last = True
        elif kinds[i] == "C":
            last = last and said[i - 1] == KEEP
        else:  # a path that nobody knows counts as what stands around it
            last = said[i] == UNKNOWN and (last or i < prose[-1])
        if last:
            out.append(i + 1)
    return out


def _status(value) -> int | None:
    return int(value) if value is not None and value == value else None


def _str(value) -> str | None:
    return value if isinstance(value, str) else None


def known_to(pages: DataFrame, facts: DataFrame, keys: list[str], n_bytes: int, salts: int = 16) -> DataFrame:
    """pages left-joined with facts (one row for each of keys): sent to every task while small, else shuffled with the pages salted."""
    if n_bytes <= BROADCAST_BYTES:
        return pages.join(F.broadcast(facts), keys, "left")
    salted = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("__salt", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int")).join(salted, [*keys, "__salt"], "left").drop("__salt")


STATS = ["n", "body", "before_prose", "own", "n_after", "n_before"]
SKETCH = [f"{x}{i}" for x in ("line", "after", "before") for i in range(SIGNS)]


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 by the bits of each hash, 0 for no hash: the square of a sum of these tells how often two of the hashes are equal."""
    bits = (hashes[:, None] >> np.arange(8, 8 + SIGNS)) & 1
    return np.where(hashes[:, None] == 0, 0, bits * 2 - 1)


def _grouped(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [k[first] for k in keys], np.add.reduceat(values[order], first)


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        owner: list[tuple] = []
        sites: dict = {}
        for h, bucket, text, title, company, status, site in zip(*(batch[c] for c in ("h", "bucket", "text", "title", "company", "status", "site"))):
            if isinstance(text, str) and text:
                if h not in sites:
                    sites[h] = frozenset() if site is None else frozenset(site.tolist())
                new = score_page(text, _str(title), _str(company), _status(status), sites[h])
                rows += new
                owner += [(h, bucket)] * len(new)
        if not rows:
            continue
        a, o = np.array(rows, np.int64), np.array(owner, np.int64)
        plain = np.column_stack([a[:, 2:6], a[:, 6] != 0, a[:, 7] != 0])
        (p,), sums = _grouped([a[:, 0]], np.column_stack([plain, _signs(a[:, 1]), _signs(a[:, 6]), _signs(a[:, 7])]))
        whole = pd.DataFrame(sums, columns=STATS + SKETCH).assign(h=pd.NA, bucket=pd.NA, path=p)
        mine = a[:, 2] == 1
        if not mine.any():
            yield whole
            continue
        (h, bucket, p), sums = _grouped([o[mine, 0], o[mine, 1], a[mine, 0]], a[mine, 2:4])
        yield pd.concat([whole, pd.DataFrame({"h": h, "bucket": bucket, "path": p, "n": sums[:, 0], "body": sums[:, 1]})], ignore_index=True)


def _same(prefix: str, n: Column) -> Column:
    """The chance that two occurrences have the same neighbour (or line), from the sums of signs."""
    squares = [F.col(f"{prefix}{i}").cast("double") ** 2 for i in range(SIGNS)]
    return sum(squares[1:], squares[0]) / (SIGNS * n.cast("double") * n)


def _verdict() -> Column:
    """What the votes of a host (h_n, h_body) and of all hosts say of a path."""
    n, most = F.col("n"), lambda c: F.greatest(c, F.lit(1))
    k = BACKING / F.greatest(n, F.lit(BACKING))
    fixed = lambda c, x: (F.col(c) >= LEAST) & (F.col(c) * 2 >= n) & (_same(x, most(F.col(c))) >= FIXED_NEIGHBOUR)
    follows = F.col("before_prose") / most(F.col("body"))
    verbatim = _same("line", most(n)) >= VERBATIM
    return (
        F.when(F.col("own") >= TITLE_SHARE * (F.col("own") + n), TITLE)
        .when(n < LEAST, UNKNOWN)
        .when(F.col("h_body") + k * F.col("body") < BODY_SHARE * (F.col("h_n") + k * n), DROP)  # stands around the body
        .when(fixed("n_after", "after") | fixed("n_before", "before"), DROP)  # part of a block that is always the same
        .when(verbatim & (follows >= BETWEEN) & (follows < HEADING) & (F.col("body") >= LEAST), DROP)  # neither a heading nor one of a list
        .otherwise(KEEP)
    )


def main_lines(pages: DataFrame, key: str = "page_id", host: str = "website") -> DataFrame:
    """(key, line_no) of the lines of the main body, line_no from 1.

    Null and empty texts, and pages that only report an error, have no line; a null host is a host of its own; rows repeated count
    each, and so do pages fetched twice. Prose that at least SITE_SHARE of three or more pages of a host repeat word for word is the
    site's. The votes on a path are summed in each task, then for each host and for all hosts; what they say comes back to the pages
    in buckets of about a thousand pages of a host, so no row grows with a host.
    """
    kind = pages.schema[key].dataType.simpleString()
    texts = pages.select(
        F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(host), F.lit(""))).alias("h"), F.col("clean_text").alias("text"), "title", F.col("company_name").alias("company"), F.col("status_code").alias("status")
    ).where("text IS NOT NULL AND text <> ''")
    sizes = texts.groupBy("h").agg(F.count("*").alias("pages"))
    long = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: F.length(x) >= PROSE_CHARS)
    repeated = texts.select("h", F.explode(F.transform(long, lambda x: F.xxhash64(x))).alias("line")).groupBy("h", "line").agg(F.count("*").alias("n")).where(F.col("n") >= SITE_PAGES)
    votes = repeated.join(sizes, "h").where(F.col("n") >= SITE_SHARE * F.col("pages"))
    hosts = cut(sizes.join(votes.groupBy("h").agg(F.collect_list("line").alias("site")), "h", "left"))
    n_hosts, n_site = hosts.agg(F.count("*"), F.coalesce(F.sum(F.size(F.coalesce("site", F.array()))), F.lit(0))).first()
    known = known_to(spread(texts), hosts, ["h"], 40 * n_hosts + 8 * n_site)
    known = known.withColumn("bucket", F.pmod(F.xxhash64("k", F.lit(3)), F.ceil(F.col("pages") / BUCKET_PAGES)).cast("int")).drop("pages")
    counts = ", ".join(f"{c} int" for c in STATS + SKETCH)
    scored = known.mapInPandas(_scores, f"h bigint, bucket int, path bigint, {counts}")
    stats = cut(scored.groupBy("h", "bucket", "path").agg(*(F.sum(c).alias(c) for c in STATS + SKETCH)))
    theirs = stats.where("h IS NOT NULL").select("h", "bucket", "path", "n", "body")
    by_host = theirs.groupBy("h", "path").agg(F.sum("n").alias("h_n"), F.sum("body").alias("h_body"))
    by_all = stats.where("h IS NULL AND (n >= {} OR own > 0)".format(LEAST)).drop("h", "bucket")
    verdicts = by_host.join(by_all, "path").select("h", "path", _verdict().alias("verdict")).where(F.col("verdict") != UNKNOWN)
    coded = F.col("path") + F.col("verdict")  # the lowest two bits of a path are free
    told = cut(theirs.select("h", "bucket", "path").join(verdicts, ["h", "path"]).groupBy("h", "bucket").agg(F.collect_list(coded).alias("verdicts")))
    n_told, n_verdicts = told.agg(F.count("*"), F.coalesce(F.sum(F.size("verdicts")), F.lit(0))).first()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys: list = []
            found: list[int] = []
            sites: dict = {}
            for k, h, bucket, text, title, company, status, site, codes in zip(*(batch[c] for c in ("k", "h", "bucket", "text", "title", "company", "status", "site", "verdicts"))):
                if (h, bucket) not in sites:
                    sites[h, bucket] = frozenset() if site is None else frozenset(site.tolist()), {} if codes is None else {c & ~3: c & 3 for c in codes.tolist()}
                lines = extract(text, _str(title), _str(company), _status(status), *sites[h, bucket])
                keys += [k] * len(lines)
                found += lines
            yield pd.DataFrame({"k": pd.Series(keys, dtype=batch["k"].dtype), "line_no": np.array(found, np.int32)})

    both = known_to(known, told, ["h", "bucket"], 40 * n_told + 8 * n_verdicts)
    return both.mapInPandas(run, f"k {kind}, line_no int").withColumnRenamed("k", key)


def main_text(pages: DataFrame, key: str = "page_id", host: str = "website") -> DataFrame:
    """(key, main_text): the main body of each page, its lines in order; a page without one has no row."""
    kept = main_lines(pages, key, host).groupBy(key).agg(F.array_sort(F.collect_list("line_no")).alias("__lines"))
    texts = pages.select(key, F.split("clean_text", "\n").alias("__text"))
    body = F.concat_ws("\n", F.transform("__lines", lambda n: F.element_at("__text", n)))
    return texts.join(kept, key).select(key, body.alias("main_text"))
