"""Aliases of records and their mentions in questions and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import values as V
from orrery.plans.runtime import broadcast_if_small, is_small

#: Kinds of equipment that name no record by themselves; :func:`common_words` finds those of a collection.
KINDS = ("aircraft", "antenna", "boat", "crane", "drone", "engine", "gun", "helicopter", "launcher", "missile", "mortar", "radar", "rocket", "satellite", "ship", "sonar", "submarine", "system", "tank", "torpedo", "truck", "vehicle")
#: Words that identify no record: function words, kinds of variant and of equipment.
STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "mk", "mark", "mod", "model", "block", "lot", "series", "version", "variant", "type", *KINDS)
#: A designation: up to four letters and a number, together or joined by one sign.
DESIGNATION = r"\b[A-Za-z]{1,4}[-/ ]?\d[A-Za-z0-9-]*\b"


def common_words(records: DataFrame, title: str, share: float = 0.02, least: int = 20) -> list[str]:
    """Words in more than ``share`` of all titles and in at least ``least``: names of kinds rather than of records.

    At most words-per-title / ``share`` words can be so frequent, which bounds what reaches the driver.
    """
    words = records.where(F.col(title).isNotNull()).select(F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace(title, r"[(),]", " ")), r"\s+"))).alias("w"))
    n = records.where(F.col(title).isNotNull()).count()
    frequent = words.where("w rlike '^[a-z]{3,}$'").groupBy("w").count().where(F.col("count") >= max(least, share * n))
    return sorted(r["w"] for r in frequent.collect())


def alias_table(records: DataFrame, rid: str, title: str, extra: Column | None = None, stop: Sequence[str] = STOPWORDS) -> DataFrame:
    """Distinct (alias, rid): the title, designations, names in parentheses or between commas, telling words, and ``extra`` (array) names with their designations.

    Aliases are lower case and have at least two characters; short words count only as designations, words of
    ``stop`` not at all (the caller may add :func:`common_words`).
    """
    t = F.trim(F.regexp_replace(F.col(title), r"\s+", " "))
    found = lambda c, p, k=0: F.regexp_extract_all(c, F.lit(p), F.lit(k))
    words = F.filter(F.split(F.regexp_replace(t, r"[(),]", " "), r"\s+"), lambda w: ~F.lower(w).isin(*stop) & ((F.length(w) >= 3) | w.rlike(DESIGNATION)))
    own = F.concat(F.array(t), found(t, DESIGNATION), found(t, r"\(([^)]+)\)", 1), F.transform(F.split(t, ","), lambda x: F.trim(x)), words)
    everything = own if extra is None else F.concat(own, F.coalesce(extra, F.array().cast("array<string>")), F.flatten(F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda x: found(x, DESIGNATION))))
    rows = records.where(F.col(title).isNotNull()).select(F.col(rid).cast("string").alias("rid"), F.explode(everything).alias("a"))
    return rows.select(F.lower(F.trim("a")).alias("alias"), "rid").where(F.length("alias") >= 2).distinct()


def mentions(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """Distinct (key, alias, rid) of aliases that occur in a text as whole words.

    Texts and aliases meet on words: an alias is found through its first word, so the join is an
    equi-join and no text is compared with every alias; the whole alias is verified afterwards on the
    padded text. Texts are not shuffled more than once.
    """
    spaced = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), F.lit(" "))
    keyed = aliases.select("alias", "rid", spaced(F.col("alias")).alias("pattern")).withColumn("word", F.split(F.trim("pattern"), " ")[0]).where("word <> ''")
    body = texts.where(F.col(text).isNotNull()).select(key, spaced(F.col(text)).alias("body"))
    found_words = F.explode(F.array_distinct(F.split(F.trim("body"), " "))).alias("word")
    if is_small(keyed):
        hits = body.select(key, "body", found_words).join(F.broadcast(keyed), "word")
    else:
        # texts must not travel once per word: candidates are found by words alone and verified afterwards
        candidates = body.select(key, found_words).join(keyed, "word").drop("word").distinct()
        hits = body.join(candidates, key)
    return hits.where(F.expr("contains(body, pattern)")).select(key, "alias", "rid").distinct()


def matched_records(found: DataFrame, key: str) -> DataFrame:
    """(key, rid, alias, place): records of a text by the longest alias, one row per record."""
    longest = Window.partitionBy(key, "rid").orderBy(F.desc(F.length("alias")), "alias")
    one = found.withColumn("r", F.row_number().over(longest)).where("r = 1").drop("r")
    order = Window.partitionBy(key).orderBy(F.desc(F.length("alias")), "alias", "rid")
    return one.withColumn("place", F.row_number().over(order))


def unmatched_designations(texts: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """(key, designation) of designation-like tokens in texts in which no alias matched at all."""
    tokens = texts.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{1,4}[-/]?\d+[A-Za-z0-9-]*\b"), F.lit(0)))).alias("designation"))
    return tokens.join(found.select(key).distinct(), key, "left_anti")


def families(aliases: DataFrame) -> DataFrame:
    """(stem, members): how many records share the letters of their designations."""
    stems = aliases.select(V.family_stem(F.col("alias")).alias("stem"), "rid").where("stem <> ''").distinct()
    return stems.groupBy("stem").agg(F.count("*").alias("members"))


def ambiguous_family(texts: DataFrame, key: str, text: str, sizes: DataFrame, threshold: int = 8) -> DataFrame:
    """(key, stem, members): the largest family above the threshold whose stem stands bare and in capitals in the text."""
    bare = texts.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(
        text, F.lit(r"(?<![A-Za-z0-9-])([A-Z]{1,4})(?![A-Za-z0-9]|[- ]?\d)"), F.lit(1)))).alias("s"))
    hit = bare.select(key, F.lower("s").alias("stem")).join(broadcast_if_small(sizes.where(F.col("members") > threshold)), "stem")
    w = Window.partitionBy(key).orderBy(F.desc("members"), "stem")
    return hit.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "stem", "members")


def field_intents(questions: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, field, score): fields that a question means; only those of the best score.

    ``vocabulary`` has (phrase, field, weight). A phrase counts if all its words stand in the question
    in order (checked on padded text after an equi-join on the phrase's first word).
    """
    phrases = vocabulary.select("phrase", F.col("field").alias("rid"), "weight")
    hits = mentions(questions, key, text, phrases.select(F.col("phrase").alias("alias"), "rid")).join(
        broadcast_if_small(phrases.withColumnRenamed("phrase", "alias")), ["alias", "rid"])
    scored = hits.groupBy(key, F.col("rid").alias("field")).agg(F.max("weight").alias("score"), F.max(F.size(F.split("alias", " "))).alias("words"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("words"))
    return scored.withColumn("r", F.rank().over(best)).where("r = 1").select(key, "field", "score")


def resolve_by_overlap(items: DataFrame, key: str, text: str, targets: DataFrame, accept: float = 0.62, margin: float = 0.12, doubtful: float = 0.35) -> DataFrame:
    """(key, target, score, runner_up, status): the target whose words overlap best (Dice), accepted above a score and a margin.

    ``targets`` has (target, words array). Items and targets meet on shared words; a target without a
    shared word scores 0 and needs no row. The candidates of an item are bounded by the targets.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)))
    own = items.where(F.col(text).isNotNull()).select(key, words.alias("w")).withColumn("nw", F.size("w")).where("nw > 0")
    theirs = targets.select("target", F.size("words").alias("nt"), F.explode("words").alias("word"))
    shared = own.select(key, "nw", F.explode("w").alias("word")).join(broadcast_if_small(theirs), "word").groupBy(key, "nw", "target", "nt").agg(F.count("*").alias("n"))
    scored = shared.select(key, "target", F.round(2 * F.col("n") / (F.col("nw") + F.col("nt")), 4).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "target")
    top = scored.withColumn("r", F.row_number().over(w)).withColumn("runner_up", F.lead("score").over(w)).where("r = 1")
    second = F.coalesce("runner_up", F.lit(0.0))
    status = F.when((F.col("score") >= accept) & (F.col("score") - second >= margin), "resolved").when(F.col("score") >= doubtful, "ambiguous").otherwise("unmapped")
    return top.select(key, "target", "score", second.alias("runner_up"), status.alias("status"))


def subset_match(items: DataFrame, key: str, text: str, targets: DataFrame) -> DataFrame:
    """(key, target): items whose words include all words of exactly one target."""
    own = items.where(F.col(text).isNotNull()).select(key, F.array_distinct(V.tokens(F.col(text))).alias("w"))
    theirs = targets.select("target", F.size("words").alias("nt"), F.explode("words").alias("word"))
    full = own.select(key, F.explode("w").alias("word")).join(broadcast_if_small(theirs), "word").groupBy(key, "target", "nt").agg(F.count("*").alias("n")).where("n = nt")
    return full.groupBy(key).agg(F.count("*").alias("k"), F.min("target").alias("target")).where("k = 1").select(key, "target")
