"""Paragraphs of pages: labels, raw key-value lists, notes, the specification block, and buckets of description.

All of it is column expressions over one row per paragraph; windows run within a page, whose length bounds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.runtime import broadcast_if_small
from orrery.sources.pages import bucket, carry_forward

#: Headings that begin a block of specifications, and labels that end one.
SPEC_HEADINGS = ("specifications", "specification", "technical data", "characteristics")
SPEC_ENDS = ("see also", "references", "notes", "external links", "sources", "bibliography", "further reading")


def plain_heading(text: Column) -> Column:
    """A heading in lower case, single blanks, without colons and dots behind."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[:.]+$", ""), r"\s+", " "))


def headings(page_rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(heading): section titles of all pages in plain form, and the extra ones."""
    own = page_rows.select(F.explode("sections").alias("s")).select(plain_heading(F.col("s")).alias("heading"))
    more = page_rows.sparkSession.createDataFrame([(e,) for e in extra], "heading string").select(plain_heading(F.col("heading")).alias("heading"))
    return own.unionByName(more).where("heading <> ''").distinct()


def paragraphs(page_rows: DataFrame) -> DataFrame:
    """(page_id, pos, para): paragraphs of the full text in order, without empty ones."""
    return page_rows.select("page_id", F.posexplode(F.split("full_text", r"\n[^\S\n]*\n")).alias("pos", "p")).select("page_id", "pos", F.trim("p").alias("para")).where("para <> ''")


def is_key_value_list(para: Column) -> Column:
    """Two lines or more of which at most one isn't 'Key: value'."""
    lines = F.filter(F.split(para, "\n"), lambda ln: F.trim(ln) != "")
    hits = F.size(F.filter(lines, lambda ln: ln.rlike(r"^[A-Za-z][\w /]{1,30}:\s")))
    return (F.size(lines) >= 2) & (hits >= 2) & (hits >= F.size(lines) - 1)


def is_editorial_note(para: Column) -> Column:
    """A note of whoever stored the page, about the page itself."""
    low = F.lower(para)
    return low.startswith("note:") & (low.contains("fetched content") | low.contains("this article") | low.contains("the article"))


def first_sentence(text: Column, limit: int = 200) -> Column:
    """Up to the first end of a sentence within the limit, else cut there with an ellipsis."""
    t = F.trim(text)
    found = F.regexp_extract(t, rf"^((?s:.){{1,{limit}}}?[.!?])(?:\s|$)", 1)
    return F.when(found != "", found).when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("...")))


def file_name(slug: Column, suffix: str = ".html") -> Column:
    """A slug as the name of a file: signs that file systems refuse become underscores."""
    return F.concat(F.regexp_replace(slug, r'[\\/:*?"<>|\x00-\x1f]', "_"), F.lit(suffix))


def labelled(paras: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``label`` (a known heading on a line of its own or before a colon, else null) and ``rest``, the text behind it."""
    line, rest = F.substring_index("para", "\n", 1), F.when(F.instr("para", "\n") > 0, F.trim(F.regexp_replace("para", r"^[^\n]*\n", ""))).otherwise("")
    inline = F.regexp_extract("para", r"^([^:\n]{1,90}):\s+", 1)
    given = paras.withColumn("__line", F.when(F.length(line) <= 80, plain_heading(line))).withColumn("__inline", F.when(inline != "", plain_heading(inline)))
    lines, words = known.select(F.col("heading").alias("__line"), F.lit(True).alias("__a")), known.select(F.col("heading").alias("__inline"), F.lit(True).alias("__b"))
    found = given.join(broadcast_if_small(lines), "__line", "left").join(broadcast_if_small(words), "__inline", "left")
    return found.withColumn("label", F.when(F.col("__a"), F.col("__line")).when(F.col("__b"), F.col("__inline"))).withColumn(
        "rest", F.when(F.col("__a"), rest).when(F.col("__b"), F.trim(F.regexp_replace("para", r"^[^:\n]{1,90}:\s+", ""))).otherwise(F.col("para"))).drop("__line", "__inline", "__a", "__b")


def described(page_rows: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, bucket, text, short): paragraphs by bucket of description.

    Raw lists and editorial notes are left out. A label starts a bucket, an unlabelled paragraph may by its first words
    (but not the first of a page, which is an overview); a label that ends the page drops all that follows. A page without
    an overview gets its summary.
    """
    kept = labelled(paragraphs(page_rows).where(~is_key_value_list(F.col("para")) & ~is_editorial_note(F.col("para"))), known)
    w = Window.partitionBy("page_id").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    named = kept.withColumn("__named", bucket(F.col("label"))).withColumn("__stop", F.max((bucket(F.col("label")) == "STOP").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = named.withColumn("__seen", F.max((F.col("rest") != "").cast("int")).over(before))
    hint = bucket(plain_heading(F.substring("para", 1, 100)))
    own = F.when(F.col("label").isNotNull(), F.col("__named")).when((F.col("__seen") == 1) & (hint != "STOP"), hint)
    placed = carry_forward(seen.where("coalesce(__stop, 0) = 0").withColumn("__own", own), "page_id", ["pos"], "__own", "__held").where("rest <> ''").withColumn("bucket", F.coalesce("__held", F.lit("Overview")))
    texts = placed.groupBy("page_id", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rest"))), lambda s: s["rest"]), "\n\n").alias("text"))
    bare = page_rows.where(F.trim("summary") != "").select("page_id", F.lit("Overview").alias("bucket"), F.trim("summary").alias("text")).join(texts.where("bucket = 'Overview'").select("page_id"), "page_id", "left_anti")
    return texts.unionByName(bare).withColumn("short", first_sentence(F.col("text")))


def spec_block(page_rows: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, pos, label, value): 'Label: value' paragraphs between a specification heading and the end of its block."""
    paras = labelled(paragraphs(page_rows), known.unionByName(page_rows.sparkSession.createDataFrame([(h,) for h in (*SPEC_HEADINGS, *SPEC_ENDS)], "heading string")).distinct())
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.min(F.when(F.col("label").isin(*SPEC_HEADINGS), F.col("pos"))).over(w)
    inside = paras.withColumn("__begin", begin)
    ended = inside.withColumn("__end", F.max((F.col("label").isin(*SPEC_ENDS) & (F.col("pos") > F.col("__begin"))).cast("int")).over(w))
    line = r"^([A-Za-z][A-Za-z0-9 /\-.]{1,45}):\s+((?s:.+))$"
    rows = ended.where(F.expr("pos > __begin and coalesce(__end, 0) = 0")).select("page_id", "pos", F.trim(F.regexp_extract("para", line, 1)).alias("label"), F.trim(F.regexp_extract("para", line, 2)).alias("value"))
    return rows.where("label <> '' and value <> ''")
