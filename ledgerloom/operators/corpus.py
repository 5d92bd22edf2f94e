"""Filing text as sections, paragraphs and overlapping chunks with exact references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.names import trim_all
from ledgerloom.session import spread


def lines_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no from 0, line, start): each line and where it starts (WIN-04), by a running sum within the document."""
    each = docs.where(F.col(text).isNotNull()).select(doc, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def sections(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, item, title, text, char_start): one section for each item, and FRONT before the first (TXT-01).

    A header line is short and begins with Item and a number; of an item named several times the last line counts (WIN-05), and a
    section runs to the next header that counts (WIN-06). Blank sections are left out; a text without headers is FRONT.
    """
    lines = lines_of(docs, doc, text).withColumn("item", T.item_header(F.col("line")))
    last = Window.partitionBy(doc, "item")
    headed = lines.withColumn("is_header", F.col("item").isNotNull() & (F.col("line_no") == F.max("line_no").over(last)))
    so_far = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(F.col("is_header"), F.struct("line_no", "item", T.item_title(F.col("line")).alias("title"), "start")), ignorenulls=True).over(so_far)
    grouped = headed.withColumn("h", at).groupBy(doc, "h").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    body = trim_all(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    out = grouped.select(doc, F.coalesce("h.item", F.lit("FRONT")).alias("item"), F.coalesce("h.title", F.lit("Front Matter")).alias("title"), body.alias("text"), F.coalesce("h.start", F.lit(0)).alias("char_start"))
    return out.where("text <> ''")


def paragraph_structs(text: Column, breaks: str = r"\n\s*\n") -> Column:
    """ARRAY<STRUCT<offset INT, para STRING>>: what lies between breaks, trimmed, without blanks (TXT-03)."""

    def placed(parts: Column) -> Column:
        gaps = F.regexp_extract_all(text, F.lit(f"({breaks})"), F.lit(1))
        sizes = F.zip_with(parts, gaps, lambda p, g: F.coalesce(F.length(p), F.lit(0)) + F.coalesce(F.length(g), F.lit(0)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        both = F.zip_with(parts, starts, lambda p, at: F.struct(at.alias("offset"), trim_all(p).alias("para")))
        return F.filter(both, lambda x: x["para"] != "")

    return T.let(F.split(text, breaks, -1), placed)


def windows(paras: Column, limit: int = 512) -> Column:
    """Paragraphs of more than limit words as windows of limit words, the offset at the window's first word (TXT-04)."""
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<offset:int,para:string>>").alias("out"))

    def step(x: Column):
        def with_run(acc: Column, run: Column) -> Column:
            def at_found(found: Column) -> Column:
                at = F.greatest(found, acc["at"])
                piece = F.array_join(run, " ")
                return F.struct((at + F.length(piece)).cast("int").alias("at"), F.array_append(acc["out"], F.struct((x["offset"] + at - 1).cast("int").alias("offset"), piece.alias("para"))).alias("out"))

            return T.let(F.call_function("locate", F.element_at(run, 1), x["para"], acc["at"]), at_found)

        return with_run

    def explode(x: Column) -> Column:
        def cut(w: Column) -> Column:
            runs = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(limit)), lambda i: F.slice(w, i + 1, F.lit(limit)))
            return F.when(F.size(w) > limit, F.aggregate(runs, none, step(x), lambda acc: acc["out"])).otherwise(F.array(F.struct(x["offset"].cast("int").alias("offset"), x["para"].alias("para"))))

        return T.let(T.words(x["para"]), cut)

    return F.flatten(F.transform(paras, explode))


PIECES = "array<struct<offset:int,para:string,n:int>>"
CHUNKS = f"array<{PIECES}>"


def fold_chunks(paras: Column, target: int = 512, overlap: int = 64) -> Column:
    """Paragraphs gathered to chunks of at least target words, each after the first led by the tail of the one before (TXT-05, WIN-07).

    The tail is the shortest suffix of paragraphs with overlap words or more, and none if that is the whole chunk. A paragraph of
    target words or more first closes what is open, without a tail.
    """
    counted = F.transform(paras, lambda x: F.struct(x["offset"].cast("int").alias("offset"), x["para"].alias("para"), T.word_count(x["para"]).alias("n")))
    start = F.struct(F.array().cast(PIECES).alias("cur"), F.lit(0).alias("tok"), F.array().cast(CHUNKS).alias("out"))

    empty = F.struct(F.array().cast(PIECES).alias("t"), F.lit(0).alias("n"))

    def tail_of(cur: Column) -> Column:
        back = F.aggregate(F.reverse(cur), empty, lambda a, p: F.when(a["n"] >= overlap, a).otherwise(F.struct(F.array_prepend(a["t"], p).alias("t"), (a["n"] + p["n"]).alias("n"))))
        return T.let(back, lambda b: F.when(F.size(b["t"]) < F.size(cur), b).otherwise(empty))

    def step(acc: Column, p: Column) -> Column:
        closes = (p["n"] >= target) & (F.size(acc["cur"]) > 0)
        opened = F.when(closes, F.struct(F.array(p).alias("cur"), p["n"].alias("tok"), F.array_append(acc["out"], acc["cur"]).alias("out"))).otherwise(F.struct(F.array_append(acc["cur"], p).alias("cur"), (acc["tok"] + p["n"]).alias("tok"), acc["out"].alias("out")))

        def filled(s: Column) -> Column:
            full = T.let(tail_of(s["cur"]), lambda t: F.struct(t["t"].alias("cur"), t["n"].alias("tok"), F.array_append(s["out"], s["cur"]).alias("out")))
            return F.when(s["tok"] >= target, full).otherwise(s)

        return T.let(opened, filled)

    return F.aggregate(counted, start, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]))


def chunks(parts: DataFrame, keys: list[str], text: str = "text", char_start: str = "char_start", breaks: str = r"\n\s*\n", drop_noise: bool = False) -> DataFrame:
    """(keys, chunk_no from 1, text, char_start, char_end) of each section, without noise if asked (TXT-05, TXT-06). No shuffle.

    char_start of a section is added to its offsets; its null counts as 0, a null text has no chunk.
    """
    found = spread(parts.where(F.col(text).isNotNull())).select(*keys, F.coalesce(F.col(char_start), F.lit(0)).alias("__base"), F.posexplode(fold_chunks(windows(paragraph_structs(F.col(text), breaks)))).alias("__no", "__c"))
    last = F.element_at("__c", -1)
    out = found.select(
        *keys, (F.col("__no") + 1).alias("chunk_no"), F.array_join(F.transform("__c", lambda x: x["para"]), "\n\n").alias("text"),
        (F.col("__base") + F.element_at("__c", 1)["offset"]).cast("int").alias("char_start"), (F.col("__base") + last["offset"] + F.length(last["para"])).cast("int").alias("char_end"),
    )
    return out.where(~T.is_noise(F.col("text"))) if drop_noise else out


def with_reference(df: DataFrame, doc_id: str, ticker: str, item: str, section: str) -> DataFrame:
    """df and ref, the STRUCT that a chunk is cited by; a chunk without a document raises."""
    doc = F.when(F.col(doc_id).isNull(), F.raise_error("a chunk needs a reference")).otherwise(F.col(doc_id))
    return df.withColumn("ref", F.struct(doc.alias("doc_id"), F.col(ticker).alias("ticker"), F.col(item).alias("item"), F.col(section).alias("section"), "char_start", "char_end"))
