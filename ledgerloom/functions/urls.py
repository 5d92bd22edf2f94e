"""Addresses of pages and what they tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.names import trim_all

#: Words of an address or its link by page type, in order.
PAGE_TYPES = [
    ("about", ["about", "team", "leadership", "who-we-are"]),
    ("products", ["product", "service", "solution", "platform", "what-we-do", "offerings", "capabilities"]),
    ("contact", ["contact", "get-in-touch"]),
    ("customers", ["partner", "client", "customer", "case-stud"]),
]
#: How e-mail addresses and telephone numbers look.
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
PHONE = r"\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"


def page_type(url: Column, base: Column, link: Column) -> Column:
    """about, products, contact or customers by the address and its link text, null for none (FLT-09)."""
    said = F.lower(F.concat(F.replace(F.lower(url), F.lower(base), F.lit("")), F.lit(" "), F.coalesce(link, F.lit(""))))
    out = F.lit(None).cast("string")
    for name, signs in reversed(PAGE_TYPES):
        out = F.when(said.rlike("|".join(signs)), name).otherwise(out)
    return out


def with_slash(url: Column) -> Column:
    """url with exactly one slash at its end (FN-24)."""
    return F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/"))


def contacts(text: Column, pattern: str) -> Column:
    """The distinct matches of a pattern, sorted (FN-25, SET-06)."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))))


def product_pages(listed: Column) -> Column:
    """ARRAY<STRUCT<url, label>> of a comma-separated list; the label is the last part of the path, else the address (FN-23)."""
    parts = F.filter(F.transform(F.split(listed, ","), trim_all), lambda u: u != "")

    def page(u: Column) -> Column:
        path = F.regexp_replace(F.coalesce(F.regexp_extract(u, r"^[a-z]+://[^/]+(/[^?#]*)", 1), F.lit("")), "/+$", "")
        label = F.element_at(F.split(path, "/"), -1)
        return F.struct(u.alias("url"), F.when(label != "", label).otherwise(u).alias("label"))

    return F.transform(parts, page)
