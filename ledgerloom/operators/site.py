"""Pages of a company's website: which to visit, what they say, who leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.titles import is_leadership, rank_title
from ledgerloom.functions.urls import EMAIL, PHONE, contacts, page_type, with_slash
from ledgerloom.operators.quality import first_of
from ledgerloom.sources import html as H

#: Words of a heading that names no product.
NO_PRODUCT = "contact|blog|news|learn more|get started|ready to"
LINKEDIN = ("deferred_tos_compliance", "LinkedIn profile scraping deferred — ToS compliance consideration. Alternative compliant enrichment available via Apollo.io / Crunchbase if scoped.")


def menu_links(pages: DataFrame, keys: list[str], base: str = "base_url") -> DataFrame:
    """(keys, ord, link_text, url) of links inside the site, each address once, the first counts (FLT-10, SET-01, TXT-09)."""
    bases = pages.select(*keys, F.col(base).alias("__base"))
    found = H.scan_links(pages, keys).join(bases, keys).where((F.col("link_text") != "") & (F.length("link_text") <= 60))
    url = F.when(F.col("href").startswith("/"), F.concat(F.regexp_replace("__base", "/+$", ""), F.col("href"))).otherwise(F.col("href"))
    inside = found.withColumn("url", url).where(F.col("url").startswith(F.col("__base")))
    return first_of(inside, [*keys, "url"], ["ord"]).select(*keys, "ord", "link_text", "url")


def frontier(links: DataFrame, homes: DataFrame, keys: list[str], extra: DataFrame | None = None, base: str = "base_url") -> DataFrame:
    """(keys, url, label, type) of the pages to visit besides the home page (SET-02, JN-07).

    Typed menu links come first, then the page about the company, then extra pages; of one address the first counts.
    """
    typed = links.join(homes.select(*keys, F.col(base).alias("__base")), keys).select(*keys, F.lit(0).alias("part"), "ord", with_slash(F.col("url")).alias("url"), F.col("link_text").alias("label"), page_type(F.col("url"), F.col("__base"), F.col("link_text")).alias("type")).where("type IS NOT NULL")
    about = homes.select(*keys, F.lit(1).alias("part"), F.lit(0).alias("ord"), F.concat(with_slash(F.col(base)), F.lit("about-us/")).alias("url"), F.lit("About Us").alias("label"), F.lit("about").alias("type"))
    all_ = typed.unionByName(about)
    if extra is not None:
        all_ = all_.unionByName(extra.select(*keys, F.lit(2).alias("part"), "ord", with_slash(F.col("url")).alias("url"), "label", F.lit("products").alias("type")))
    once = first_of(all_, [*keys, "url"], ["part", "ord", "label"])
    return once.join(homes.select(*keys, with_slash(F.col(base)).alias("url")), [*keys, "url"], "left_anti").select(*keys, "url", "label", "type")


def leaders(pages: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group, name, title, bio, first page): people with a title of leadership, each name once (TXT-10, FLT-11, SET-03)."""
    found = H.scan_people(pages, keys).where((F.col("title") != "") & is_leadership(F.col("title")))
    return first_of(found, [*group, "name"], [*[k for k in keys if k not in group], "ord"])


def products(pages: DataFrame, keys: list[str], tags: tuple[str, ...] = ("h2", "h3")) -> DataFrame:
    """(keys, products): headings that may name a product, each once in order (TXT-11, FLT-12, SET-04)."""
    found = H.scan_headings(pages, keys, tags=tags).where((F.length("heading") > 3) & (F.length("heading") < 80) & ~F.lower("heading").rlike(NO_PRODUCT))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "heading"))), lambda x: x["heading"])
    return found.groupBy(*keys).agg(F.array_distinct(listed).alias("products"))


def page_table(pages: DataFrame, keys: list[str], limit: int = 3000) -> DataFrame:
    """(keys, clean_text, emails, phones): the content of each page, cut at limit, with its contacts (TXT-13, FN-25).

    pages: keys, status_code, html. A page of another status than 200 keeps a row with an error instead.
    """
    pages = pages.select(*keys, "status_code", "html")
    good = pages.where("status_code = 200")
    texts = H.scan_page_text(good, keys)
    out = good.join(texts, keys).select(*keys, "status_code", F.substring("clean_text", 1, limit).alias("clean_text"), contacts(F.col("html"), EMAIL).alias("emails"), contacts(F.col("clean_text"), PHONE).alias("phones"), F.lit(None).cast("string").alias("error"))
    nothing = F.array().cast("array<string>")
    bad = pages.where("status_code IS NULL OR status_code <> 200").select(*keys, "status_code", F.lit("").alias("clean_text"), nothing.alias("emails"), nothing.alias("phones"), F.format_string("HTTP %d", F.coalesce("status_code", F.lit(0))).alias("error"))
    return out.unionByName(bad)


def executives(people: DataFrame, n: int = 3, order: list[str] = ("ord",), source_url: str = "") -> DataFrame:
    """The n most senior people: rank, name, title, tier, source_url, linkedin_status, linkedin_notes, notes (TOP-03, FN-12)."""
    tiers = people.withColumn("tier", rank_title(F.col("title")))
    few = tiers.orderBy("tier", *order).limit(n).agg(F.array_sort(F.collect_list(F.struct("tier", *order, "name", "title", "bio"))).alias("e"))
    each = few.select(F.posexplode("e").alias("at", "x"))
    return each.select((F.col("at") + 1).alias("rank"), "x.name", "x.title", "x.tier", F.lit(source_url).alias("source_url"), F.lit(LINKEDIN[0]).alias("linkedin_status"), F.lit(LINKEDIN[1]).alias("linkedin_notes"), F.coalesce("x.bio", F.lit("")).alias("notes"))
