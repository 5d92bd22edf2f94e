"""Queries over filing text, website pages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import urls
from ledgerloom.functions.titles import is_leadership, rank_title
from ledgerloom.operators import corpus, mentions, search, site
from ledgerloom.plans import sql as S
from ledgerloom.session import table

TARGET = "fair value"
LINES = r"\n"


def kwic_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Where documents mention a phrase, in context."""
    return mentions.mentions(table(spark, d, "documents"), TARGET, ["doc_id"])


_SIGNS = " ".join(
    "WHEN " + " AND ".join("(" + " OR ".join(f"b LIKE '%{w}%'" for w in group) + ")" for group in groups) + f" THEN '{name}'" for name, groups in mentions.SECTION_SIGNS
)
KWIC_MENTIONS = f"""WITH f AS (SELECT doc_id, regexp_replace(text, '{S.SPACE}', ' ', 'g') AS flat FROM documents), p AS (SELECT doc_id, flat, regexp_split_to_array(flat, '(?i){TARGET}') AS parts FROM f WHERE lower(flat) LIKE '%{TARGET}%'),
  e AS (SELECT doc_id, flat, parts, unnest(range(1, len(parts))) AS i FROM p), o AS (SELECT doc_id, flat, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * {len(TARGET)})::INTEGER AS position FROM e),
  c AS (SELECT doc_id, position, lower(substr(flat, greatest(position - 500, 0) + 1, position - greatest(position - 500, 0))) AS b, {S.trim(f"substr(flat, greatest(position - 200, 0) + 1, position + {len(TARGET)} + 200 - greatest(position - 200, 0))")} AS snippet FROM o)
  SELECT doc_id, position, CASE {_SIGNS} ELSE 'unknown' END AS likely_section, snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(snippet, 1, 80) ORDER BY position) AS rn FROM c) WHERE rn = 1"""


def mention_sections(spark: SparkSession, d: str) -> DataFrame:
    """Mentions outside schedules by the section they seem to be in (FLT-08, AGG-16)."""
    return mentions.outside_schedule(kwic_mentions(spark, d)).groupBy("likely_section").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


MENTION_SECTIONS = f"SELECT likely_section, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({KWIC_MENTIONS}) WHERE likely_section <> 'schedule_of_investments' GROUP BY likely_section"


def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.word_count(text).alias("words"), F.round(T.prose_fraction(text), 6).alias("prose_fraction"), T.is_noise(text).alias("noise"))


NOISE_FILTER = f"""SELECT doc_id, len(w)::INTEGER AS words, round(f, 6) AS prose_fraction, f < 0.55 AS noise FROM (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN
  len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}+') AND length(x) <= 20))::DOUBLE / len(w) ELSE 0.0 END AS f FROM (SELECT doc_id, {S.words('text')} AS w FROM documents))"""


def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    """Filing sections as overlapping chunks; compared to brute force in the tests."""
    return corpus.chunks(table(spark, d, "filing_section"), ["section_id"])


def chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks, with lines as paragraphs."""
    return corpus.chunks(table(spark, d, "documents").withColumn("char_start", F.lit(0)), ["doc_id"], breaks=LINES, drop_noise=True)


def text_windows(spark: SparkSession, d: str) -> DataFrame:
    """Texts of sections as windows of 512 words, whatever their paragraphs."""
    whole = F.array(F.struct(F.lit(0).alias("offset"), F.col("text").alias("para")))
    each = table(spark, d, "filing_section").where("trim(text) <> ''").select("section_id", F.posexplode(corpus.windows(whole)).alias("pos", "w"))
    return each.select("section_id", (F.col("pos") + 1).alias("window_no"), T.word_count(F.col("w.para")).alias("words"), F.sha2(F.concat_ws(" ", T.words(F.col("w.para"))), 256).alias("digest"))


TEXT_WINDOWS = f"""WITH w AS (SELECT section_id, {S.words('text')} AS w FROM filing_section WHERE trim(text) <> ''), e AS (SELECT section_id, w, unnest(range(0, greatest(len(w), 1), 512)) AS i FROM w)
  SELECT section_id, (i // 512 + 1)::INTEGER AS window_no, len(w[i + 1:i + 512])::INTEGER AS words, sha256(array_to_string(w[i + 1:i + 512], ' ')) AS digest FROM e"""


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of filing sections with their offsets (TXT-03)."""
    each = table(spark, d, "filing_section").where("text IS NOT NULL").select("section_id", F.posexplode(corpus.paragraph_structs(F.col("text"))).alias("pos", "p"))
    return each.select("section_id", (F.col("pos") + 1).alias("para_no"), F.col("p.offset").cast("int").alias("para_start"), F.col("p.para").alias("para"))


PARAGRAPHS = rf"""WITH s AS (SELECT section_id, regexp_split_to_array(text, '\n\s*\n') AS parts, regexp_extract_all(text, '\n\s*\n') AS gaps FROM filing_section WHERE text IS NOT NULL),
  e AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s),
  o AS (SELECT section_id, i, parts[i] AS part, (coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gaps[1:i - 1], lambda x: length(x))), 0))::INTEGER AS para_start FROM e)
  SELECT section_id, (row_number() OVER (PARTITION BY section_id ORDER BY i))::INTEGER AS para_no, para_start, {S.trim('part')} AS para FROM o WHERE {S.trim('part')} <> ''"""


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the items that their lines announce."""
    return corpus.sections(table(spark, d, "documents")).select("doc_id", "item", "char_start", F.length("text").alias("chars"), F.md5("text").alias("digest"))


_LINE = S.trim("line")
SECTIONS = rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS n FROM l),
  i AS (SELECT doc_id, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CASE WHEN length({_LINE}) <= 130 THEN upper({S.extracted(_LINE, r'(?i)^Item\s+([0-9]+[A-Z]?)\b')}) END AS item FROM e),
  h AS (SELECT *, item IS NOT NULL AND n = max(n) OVER (PARTITION BY doc_id, item) AS is_header FROM i), g AS (SELECT *, max(CASE WHEN is_header THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS hn FROM h),
  s AS (SELECT doc_id, hn, string_agg(line, chr(10) ORDER BY n) AS body, max(CASE WHEN n = hn THEN item END) AS item, max(CASE WHEN n = hn THEN start END) AS start FROM g GROUP BY doc_id, hn)
  SELECT doc_id, coalesce(item, 'FRONT') AS item, coalesce(start, 0)::INTEGER AS char_start, length({S.trim('body')})::INTEGER AS chars, md5({S.trim('body')}) AS digest FROM s WHERE {S.trim('body')} <> ''"""


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of all vectors to every vector whose id is divisible by 50."""
    all_ = table(spark, d, "embeddings")
    asked = all_.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.nearest(all_, asked, 10, "vec_id", "embedding", most_queries=100_000).withColumn("score", F.round("score", 6))


VECTOR_TOPK = """SELECT query_id, vec_id, round(score, 6) AS score, rn::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rn FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rn <= 10"""

QUESTION = "Which risk factors affect interest coverage of borrowers?"


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return search.index(table(spark, d, "filing_chunk").where("text IS NOT NULL"))


def hashed_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The ten chunks nearest to a question by hashed words."""
    return search.retrieve(_indexed(spark, d), QUESTION, 10).select("chunk_id", F.round("score", 6).alias("score"), "rank")


_VECTOR = "list_transform(range(0, 64), lambda i: len(list_filter(list_transform(regexp_extract_all(lower({t}), '(\\p{{L}}+)', 1), lambda t: ('0x' || substr(md5(t), 1, 7))::BIGINT % 64), lambda b: b = i))::DOUBLE)"
_COS = "CASE WHEN list_dot_product(x, x) > 0 AND list_dot_product(q, q) > 0 THEN list_dot_product(x, q) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(q, q)) ELSE 0.0 END"
HASHED_RETRIEVE = f"""WITH v AS (SELECT chunk_id, {_VECTOR.format(t='text')} AS x, {_VECTOR.format(t=f"'{QUESTION}'")} AS q FROM filing_chunk WHERE text IS NOT NULL), s AS (SELECT chunk_id, {_COS} AS score FROM v)
  SELECT chunk_id, round(score, 6) AS score, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, chunk_id) AS rn FROM s) WHERE rn <= 10"""


def _answer(spark: SparkSession, d: str, least: float | None, question: str = QUESTION) -> DataFrame:
    found = search.retrieve(_indexed(spark, d), question, 3, min_score=least)
    cited = found.select("rank", "text", T.cite(F.col("doc_id"), F.col("item"), F.coalesce("section_title", F.lit("")), F.col("char_start"), F.col("char_end")).alias("citation"))
    return search.answer(cited, question, "hvbr")


def answer_extractive(spark: SparkSession, d: str) -> DataFrame:
    return _answer(spark, d, None).select("text", "ticker", "refused", "llm_used", "citations")


_CITE = "'[' || doc_id || ' | Item ' || item || ' (' || coalesce(section_title, '') || ') | chars ' || char_start || '-' || char_end || ']'"
_FLAT = S.trim("text")
ANSWER_EXTRACTIVE = f"""WITH r AS (SELECT rank, {_CITE} AS citation, replace({_FLAT}, chr(10), ' ') AS flat FROM ({HASHED_RETRIEVE}) JOIN filing_chunk USING (chunk_id) WHERE rank <= 3)
  SELECT '[no-LLM mode] Top grounded passage for HVBR:' || chr(10) || (SELECT CASE WHEN length(flat) > 400 THEN substr(flat, 1, 400) || '…' ELSE flat END FROM r WHERE rank = 1) || ' [1]' || chr(10) || chr(10) || 'Sources:' || chr(10)
    || string_agg('[' || rank || '] ' || citation, chr(10) ORDER BY rank) AS text, 'HVBR' AS ticker, false AS refused, false AS llm_used, list(citation ORDER BY rank) AS citations FROM r"""


def answer_refusal(spark: SparkSession, d: str) -> DataFrame:
    """No chunk comes near a question whose words stand nowhere, so there is no answer and no model is asked."""
    return _answer(spark, d, 0.6, "xylophone zeppelin quixotic").select("text", "ticker", "refused", "llm_used", F.size("citations").alias("sources"))


ANSWER_REFUSAL = f"""SELECT '{(search.REFUSAL % 'HVBR').replace("'", "''")}' AS text, 'HVBR' AS ticker, true AS refused, false AS llm_used, 0 AS sources"""


def page_types(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "website_page")
    return p.select("page_id", urls.with_slash(F.col("url")).alias("url"), urls.page_type(F.col("url"), F.col("website"), F.col("title")).alias("type"))


_SAID = "lower(replace(lower(url), lower(website), '') || ' ' || coalesce(title, ''))"
PAGE_TYPES = f"SELECT page_id, regexp_replace(url, '/+$', '') || '/' AS url, CASE {' '.join(f"WHEN regexp_matches({_SAID}, '{'|'.join(w)}') THEN '{n}'" for n, w in urls.PAGE_TYPES)} END AS type FROM website_page"


def contacts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("clean_text")
    return table(spark, d, "website_page").select("page_id", urls.contacts(c, urls.EMAIL).alias("emails"), urls.contacts(c, urls.PHONE).alias("phones"))


CONTACTS = f"SELECT page_id, list_sort(list_distinct(regexp_extract_all(coalesce(clean_text, ''), '{urls.EMAIL}'))) AS emails, list_sort(list_distinct(regexp_extract_all(coalesce(clean_text, ''), '{urls.PHONE}'))) AS phones FROM website_page"


def page_urls_once(spark: SparkSession, d: str) -> DataFrame:
    """Each address of a site once, the first page that was fetched (SET-01)."""
    return site.first_of(table(spark, d, "website_page").withColumn("url", urls.with_slash(F.col("url"))), ["website", "url"], ["scraped_at", "page_id"]).select("website", "url", "page_id")


PAGE_URLS_ONCE = "SELECT website, url, page_id FROM (SELECT *, row_number() OVER (PARTITION BY website, url ORDER BY scraped_at NULLS FIRST, page_id) AS rn FROM (SELECT * REPLACE (regexp_replace(url, '/+$', '') || '/' AS url) FROM website_page)) WHERE rn = 1"

PEOPLE = [("Ann Lee", "Chief Executive Officer"), ("Bo Day", "CFO"), ("Cy Fox", "Chief Information Security Officer"), ("Di Roe", "Vice President, Sales"), ("Ed Poe", "Senior Vice President"), ("Flo Ray", "EVP Operations"), ("Gus Kim", "Director of Care"), ("Hal Orr", "General Manager"), ("Ida May", "Coordinator")]


def exec_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, n, t, "") for i, (n, t) in enumerate(PEOPLE)], "ord INT, name STRING, title STRING, bio STRING")
    return site.executives(rows.where(is_leadership(F.col("title"))), 5).select("rank", "name", "title", "tier")


_TIER = "CASE WHEN t LIKE '%executive vice president%' OR t LIKE '%evp%' THEN 9 WHEN t LIKE '%senior vice president%' OR t LIKE '%svp%' THEN 10 WHEN t LIKE '%vice president%' OR t LIKE '%vp %' OR t LIKE '% vp' THEN 11 " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN {n}" for n, w in __import__("ledgerloom.functions.titles", fromlist=["TIERS"]).TIERS) + " ELSE 99 END"
EXEC_RANK = f"""SELECT (row_number() OVER (ORDER BY tier, ord))::INTEGER AS rank, name, title, tier FROM (SELECT ord, name, title, {_TIER} AS tier FROM (SELECT ord, name, title, lower(title) AS t FROM
  (VALUES {', '.join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(PEOPLE))}) v(ord, name, title)) WHERE regexp_matches(t, 'chief|president|vp|vice|director|manager|officer|head|founder|ceo|cfo|cto|coo|partner|executive')) ORDER BY tier, ord LIMIT 5"""


def title_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Page titles by tier, to run the ranking over a table."""
    return table(spark, d, "website_page").where("title IS NOT NULL").groupBy(rank_title(F.col("title")).alias("tier")).agg(F.count("*").alias("n"))


TITLE_TIERS = f"SELECT tier, count(*) AS n FROM (SELECT {_TIER} AS tier FROM (SELECT lower(title) AS t FROM website_page WHERE title IS NOT NULL)) GROUP BY tier"

ALL = {
    "kwic_mentions": (kwic_mentions, KWIC_MENTIONS), "mention_sections": (mention_sections, MENTION_SECTIONS), "noise_filter": (noise_filter, NOISE_FILTER), "chunk_sections": (chunk_sections, None), "chunk_docs": (chunk_docs, None),
    "text_windows": (text_windows, TEXT_WINDOWS), "paragraphs": (paragraphs, PARAGRAPHS), "sections": (sections, SECTIONS), "vector_topk": (vector_topk, VECTOR_TOPK), "hashed_retrieve": (hashed_retrieve, HASHED_RETRIEVE),
    "answer_extractive": (answer_extractive, ANSWER_EXTRACTIVE), "answer_refusal": (answer_refusal, ANSWER_REFUSAL), "page_types": (page_types, PAGE_TYPES), "contacts": (contacts, CONTACTS), "page_urls_once": (page_urls_once, PAGE_URLS_ONCE),
    "exec_rank": (exec_rank, EXEC_RANK), "title_tiers": (title_tiers, TITLE_TIERS),
}
