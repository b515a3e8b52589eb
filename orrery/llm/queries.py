"""Registered queries of the operators for training data, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import canonical, entities, markup, mixing, neighbours, packing, sentences, splitting, tokens
from orrery.plans.runtime import Scratch, table


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text, typed blocks and the greatest marginal of markup for every description and quote."""
    model = markup.train()
    return markup.clean_texts(table(spark, sf_dir, "rbe2"), "descr_id", "description", "rbe2", model).unionByName(
        markup.clean_texts(table(spark, sf_dir, "claims"), "claim_id", "quote", "claims", model))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_clean(spark, sf_dir).where("has_markup").select("src", "row_key")


def p2_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that each unlinked claim denotes, with confidence and kind of evidence."""
    claims = table(spark, sf_dir, "claims").where("model_id is null")
    return entities.match(claims, table(spark, sf_dir, "models"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_match(spark, sf_dir).select("claim_id", "model_id")


def _field_names(spark: SparkSession, sf_dir: str) -> list[str]:
    rows = table(spark, sf_dir, "field_ref").where("canon_field is not null").select("canon_field").distinct()
    return sorted(r["canon_field"] for r in rows.toLocalIterator())


def p5_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every claim with an attribute the entry it means, how it was found, and all near entries."""
    claims, names = table(spark, sf_dir, "claims"), _field_names(spark, sf_dir)
    return canonical.map_values(claims, "claim_id", "attribute", names, *canonical.every_alias(claims, "attribute", "canon_field", names))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose stored field is no entry of the reference list, with the entry their attribute means."""
    claims, names = table(spark, sf_dir, "claims"), _field_names(spark, sf_dir)
    aliases, more = canonical.every_alias(claims, "attribute", "canon_field", names)
    open_claims = claims.where(F.col("canon_field").isNull() | ~F.col("canon_field").isin(names))
    return canonical.map_values(open_claims, "claim_id", "attribute", names, aliases, more).select(
        "claim_id", F.col("entry").alias("canon_field"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all passages with their offsets."""
    return splitting.split_texts(table(spark, sf_dir, "records"), "row_id", "text", keep=("rid",))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that come out in more than one piece."""
    return p4_pieces(spark, sf_dir).where("rid is not null and end_pos - start_pos < total").select("rid").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.90 or more among the ten most similar rows of either."""
    return neighbours.similar_pairs(table(spark, sf_dir, "records"), "row_id", "embedding").select("row_id_a", "row_id_b")


def p6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar rows of every row whose id is divisible by 100."""
    records = table(spark, sf_dir, "records")
    found = neighbours.search(records, "row_id", "embedding", records.where("row_id % 100 = 0").select("row_id"))
    return found.withColumn("cosine", F.round("cosine", 4))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or part of a document."""
    sizes = tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.report(Scratch(spark, "packed").put(p8_pack(spark, sf_dir)))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of documents that brings each source to its share."""
    sizes = tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", keep=("source",))
    return mixing.mix(sizes, table(spark, sf_dir, "mix_targets"))[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares by source."""
    sizes = tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", keep=("source",))
    return mixing.mix(sizes, table(spark, sf_dir, "mix_targets"))[1]


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of all documents with text and position."""
    return sentences.sentences(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_sentences(spark, sf_dir).select("doc_id", "start_pos")


def p2_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the matches those of claims whose mention is nothing but a code of the catalogue."""
    claims = table(spark, sf_dir, "claims").where("model_id is null").select("claim_id", "entity_mention").distinct()
    codes = table(spark, sf_dir, "models").select(F.col("primary_equip_code").alias("entity_mention")).distinct()
    return p2_found(spark, sf_dir).join(claims.join(codes, "entity_mention"), "claim_id").select("claim_id", "model_id")


def p5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claims map to whose attribute is a name of the list, letter case and outer blanks apart."""
    names = [n.lower() for n in _field_names(spark, sf_dir)]
    return p5_mapping(spark, sf_dir).where(F.lower(F.trim("attribute")).isin(names)).select("claim_id", "entry", "status", "distance")


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each passage how far its pieces reach, whether all are within the limit and none leaves a gap."""
    order = Window.partitionBy("row_id").orderBy("start_pos")
    pieces = p4_pieces(spark, sf_dir).withColumn("before", F.coalesce(F.lag("end_pos").over(order), F.lit(0)))
    return pieces.groupBy("row_id").agg(
        F.max("end_pos").cast("long").alias("covered"), F.min(F.length("piece") <= splitting.LIMIT).alias("within"),
        F.min(F.col("start_pos") <= F.col("before")).alias("gapless"))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, containers over the capacity, and documents split though one container would hold them."""
    packed = Scratch(spark, "packed").put(p8_pack(spark, sf_dir))
    over = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n")).where("n > 2048").agg(F.count("*").alias("overfull"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    return docs.agg(F.count("n").alias("documents"), F.sum((F.coalesce("n", F.lit(0)) <= 2048).cast("long") * (F.col("parts") > 1).cast("long")).alias("split_needlessly")).crossJoin(over)


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source with a target: whether no document is used more often than allowed."""
    uses = p9_mix(spark, sf_dir).groupBy("source", "doc_id").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    targets = table(spark, sf_dir, "mix_targets")
    return targets.join(uses, "source").select("source", (F.col("most") <= F.col("max_repeats")).alias("kept"))


#: All blanks that Unicode knows, for both regular expression dialects.
_BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def p10_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of each document that its units hold, blanks apart: nothing is lost or doubled."""
    units = p10_sentences(spark, sf_dir)
    return units.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("sentence", _BLANKS, ""))).cast("long").alias("filled"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean": p1_clean,
    "p2_found": p2_found,
    "p2_match": p2_match,
    "p2_codes": p2_codes,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_mapping": p5_mapping,
    "p5_exact": p5_exact,
    "p4_invariants": p4_invariants,
    "p6_found": p6_found,
    "p6_search": p6_search,
    "p8_pack": p8_pack,
    "p8_report": p8_report,
    "p8_invariants": p8_invariants,
    "p9_mix": p9_mix,
    "p9_report": p9_report,
    "p9_invariants": p9_invariants,
    "p10_found": p10_found,
    "p10_invariants": p10_invariants,
    "p10_sentences": p10_sentences,
}

ORACLES: dict[str, str] = {
    "p2_codes": "SELECT DISTINCT claim_id, m.model_id FROM claims c JOIN (SELECT primary_equip_code AS code, min(model_id) AS model_id FROM models GROUP BY 1 HAVING count(DISTINCT model_id) = 1) m ON m.code = c.entity_mention WHERE c.model_id IS NULL",
    "p5_exact": "SELECT DISTINCT claim_id, canon_name AS entry, 'exact' AS status, CAST(0 AS INTEGER) AS distance FROM claims JOIN (SELECT DISTINCT canon_field AS canon_name FROM field_ref) ON lower(trim(attribute)) = lower(canon_name)",
    "p4_found": "SELECT DISTINCT rid FROM records WHERE rid IS NOT NULL AND length(text) > 900",
    "p4_invariants": "SELECT row_id, length(text) AS covered, true AS within, true AS gapless FROM records WHERE text IS NOT NULL",
    "p6_search": """WITH u AS (SELECT row_id, embedding::DOUBLE[] AS v FROM records WHERE embedding IS NOT NULL AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT a.row_id AS query, b.row_id AS row, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.row_id % 100 = 0 AND a.row_id <> b.row_id AND len(a.v) = len(b.v))
SELECT query, row, round(c, 4) AS cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 6) DESC, row) AS rank FROM s) WHERE rank <= 10""",
    "p8_invariants": "SELECT count(text) AS documents, CAST(0 AS BIGINT) AS split_needlessly, CAST(0 AS BIGINT) AS overfull FROM documents",
    "p9_invariants": "SELECT source, true AS kept FROM mix_targets WHERE target_share > 0 AND source IN (SELECT source FROM documents WHERE text <> '')",
    "p10_invariants": f"SELECT doc_id, length(regexp_replace(text, '{_BLANKS}', '', 'g')) AS filled FROM documents WHERE length(regexp_replace(text, '{_BLANKS}', '', 'g')) > 0",
}
