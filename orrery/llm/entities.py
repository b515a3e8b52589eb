"""Matching mentions to catalogue records without a common key.

Sorted neighbourhood: the names found in mentions and the family names of the records are sorted
together by several composite keys; within a sliding window over each order, name pairs are compared
by weighted field similarities. The window reaches across the borders of the sorted partitions by
their outermost record-side rows. A family together with the variant, or with year, maker and country
where the mention gives only those, then denotes a record.

Assignment: a claim is assigned at most one record, the one of the greatest confidence, and none if
another comes within the margin. A record may take many claims, because many claims speak of the same
equipment; a one-to-one assignment would drop all but one of them. Nor would it hold between records and
clusters of equal mentions: one record is meant by its variant here, by its year or its maker there.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.runtime import Scratch, parallelism

# Spellings of the kinds of variant.
KINDS = {"mk": "mk", "mark": "mk", "block": "block", "blk": "block", "lot": "lot", "model": "model", "mod": "model"}
# Number words of variants.
NUMBER_WORDS = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                "seventeen eighteen nineteen twenty").split()
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
# Cyrillic letters in Latin script.
_CYRILLIC = str.maketrans({
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "sch", "ы": "y", "э": "e", "ю": "yu", "я": "ya", "ь": "", "ъ": "", "ё": "e"})

_VARIANT = re.compile(
    r"(?<![a-z])(mark|mk|block|blk|lot|model|mod)\s*[.\-#]*\s*#?\s*(\d{1,4}|[ivxl]{1,6}|"
    + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + r")(?![a-z\d])", re.I)
_CODE = re.compile(r"(?<![a-z\d])([a-z]{1,3}x)[\s/\-]*([\do]{1,10})(?![a-z\d])", re.I)
_YEAR = re.compile(r"\b(?:in service since|fielded in|ioc|service entry(?: in)?|introduced in|first used in)\s+((?:19|20)\d\d)\b", re.I)
_MAKER = re.compile(r"\b(?:made|built|produced|manufactured) by\s+(.{2,40}?)(?=\s+(?:has|is|leads|was)\b|\s*[,;)=:]|\s+-\s|\.?\s*$)", re.I)
_ORIGIN = re.compile(r"\b(?:designed|developed|built|made|produced) in\s+([A-Z][a-z]+(?: [A-Z][a-z]+)*)")
_FAMILY_TITLE = re.compile(r"^family:\s*|\s+(?:family|programme|program|series)$|\s*\((?:all )?variants?\)$", re.I)
_WORD = re.compile(r"[a-z]+")

#: Rows of a sorted partition on average.
ROWS_PER_TASK = 50_000


def _number(text: str) -> int | None:
    low = text.lower()
    if low.isdigit():
        return int(low)
    if low in NUMBER_WORDS:
        return NUMBER_WORDS.index(low) + 1
    total, last = 0, 0
    for ch in reversed(low):
        v = _ROMAN.get(ch)
        if v is None:
            return None
        total += v if v >= last else -v
        last = max(last, v)
    return total or None


def parse_mention(text: str | None, sizes: tuple[int, ...] = (2,), longest: int = 40) -> dict:
    """Code, variant and possible family names of a mention: every run of as many words as families have is one.

    ``sizes`` and ``longest`` are the numbers of words and the letters of the longest family, as counted over
    all records. Null and empty mentions give nothing. A single long word is also cut at each place where
    a new name may begin, for names written together; what is longer than any family with its slips is none.
    """
    out: dict = {"code": None, "kind": None, "number": None, "names": []}
    if not text:
        return out
    s = html.unescape(text).replace("…", " ... ").translate(str.maketrans("[]()_", "     "))
    cased = s
    s = s.lower().translate(_CYRILLIC)
    code = _CODE.search(s)
    if code:
        out["code"] = f"{code.group(1)}{int(code.group(2).replace('o', '0'))}"
        s = s[:code.start()] + " | " + s[code.end():]
    for m in _VARIANT.finditer(s):
        n = _number(m.group(2))
        if n is not None:
            out["kind"], out["number"] = KINDS[m.group(1)], n
            s = s[:m.start()] + " | " + s[m.end():]
            break
    else:
        bare = re.search(r"(?<![\w.,])(\d{1,3})(?![\w.,])", s)
        if bare:
            out["number"] = int(bare.group(1))
            s = s[:bare.start()] + " | " + s[bare.end():]
    names = []
    for run in s.split("|"):
        swapped = re.search(r"([a-z]+)\s*,\s*([a-z]+)", run)
        if swapped:
            names.append((swapped.group(2), swapped.group(1)))
        words = _WORD.findall(run)
        for size in sizes:
            names += list(zip(*(words[k:] for k in range(size))))
        for w in words if 2 in sizes else ():
            if 9 <= len(w) <= longest + 2:
                names += [(w[:k], w[k:]) for k in range(4, len(w) - 3)]
    glued = re.findall(r"[A-Z][a-z]+(?=[A-Z][a-z])", cased)
    if glued:
        parts = re.findall(r"[A-Z][a-z]+", cased)
        names += [(a.lower(), b.lower()) for a, b in zip(parts, parts[1:])]
    out["names"] = list(dict.fromkeys(" ".join(n) for n in names if min(map(len, n)) > 2 and sum(map(len, n)) <= longest + 2))
    return out


def parse_claim(mention: str | None, title: str | None, quote: str | None, sizes: tuple[int, ...] = (2,), longest: int = 40) -> dict:
    """What mention, title and quote together say. The title fills what the mention leaves open."""
    own, other = parse_mention(mention, sizes, longest), parse_mention(_FAMILY_TITLE.sub("", title) if title else None, sizes, longest)
    got = {"code": own["code"], "kind": own["kind"], "number": own["number"], "names": own["names"],
           "title_names": other["names"], "title_kind": other["kind"], "title_number": other["number"], "code_title": other["code"]}
    text = html.unescape(quote) if quote else ""
    text = re.sub(r"<[^<>]*>|\*\*|'''|`", " ", f"{mention or ''} ; {text}")
    year = _YEAR.search(text) or _YEAR.search(title or "")
    got["year"] = int(year.group(1)) if year else None
    makers = [m.group(1).strip().lower() for m in _MAKER.finditer(text)]
    country = None
    if title and "," in title:
        country = title.rsplit(",", 1)[1].strip().lower()
    in_brackets = re.search(r"\(([A-Z][A-Za-z ]+)\)", mention or "")
    origin = _ORIGIN.search(text)
    if origin:
        country = origin.group(1).lower()
    if country is None and in_brackets and not _VARIANT.search(in_brackets.group(1)):
        country = in_brackets.group(1).strip().lower()
    words = (title or "").split()
    makers += [" ".join(words[:k]).lower() for k in range(1, min(4, len(words)))]
    got["country"], got["makers"] = country, list(dict.fromkeys(makers))
    return got


@lru_cache(maxsize=100_000)
def _letters(word: str) -> tuple[dict[str, int], int]:
    """Places of each letter of a word as bit sets, and the set of its letters."""
    at: dict[str, int] = {}
    for i, ch in enumerate(word):
        at[ch] = at.get(ch, 0) | 1 << i
    kinds = 0
    for ch in at:
        kinds |= 1 << (ord(ch) & 63)
    return at, kinds


def distance(a: str, b: str, most: int = 3) -> int:
    """Edits with adjacent transpositions, cut off above ``most``; bit-parallel over the places of ``a``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or not a or not b:
        return most + 1 if a and b or max(len(a), len(b)) > most else max(len(a), len(b))
    (at, kinds), (_, others) = _letters(a), _letters(b)
    if (kinds ^ others).bit_count() > 2 * most:  # an edit adds and removes at most one letter each
        return most + 1
    whole = (1 << len(a)) - 1
    high = 1 << (len(a) - 1)
    plus, minus, zero, last, d = whole, 0, 0, 0, len(a)
    for ch in b:
        here = at.get(ch, 0)
        swap = (~zero & here) << 1 & last
        zero = ((here & plus) + plus ^ plus) | here | minus | swap
        up = minus | ~(zero | plus) & whole
        down = zero & plus
        d += 1 if up & high else -1 if down & high else 0
        up = up << 1 | 1
        plus = (down << 1 | ~(zero | up)) & whole
        minus = up & zero & whole
        last = here
    return min(d, most + 1)


def similarity(name: str, family: str) -> float:
    """Mean similarity of the words of two names of equally many words; a cut-off word counts as its beginning."""
    ours, theirs = name.split(" "), family.split(" ")
    if len(ours) != len(theirs):
        return 0.0
    total, edits = 0.0, 0
    for w, f in zip(ours, theirs):
        if w == f:
            total += 1
            continue
        if 3 <= len(w) < len(f) and f.startswith(w):
            total += 0.80 + 0.02 * len(w)
            continue
        d = distance(w, f, 2)
        edits += d
        if edits > 2:
            return 0.0
        total += 1 - d / len(f)
    return total / len(ours)


_DOUBLE, _VOWELS = re.compile(r"(.)\1+"), re.compile(r"[aeiouy]")


def sort_keys(name: str) -> list[str]:
    """Composite sort keys: words in order, words reversed, and the consonant skeletons of both orders."""
    words = name.split(" ")
    bones = [_DOUBLE.sub(r"\1", _VOWELS.sub("", w)) for w in words]
    return [f"0{name}", "1" + " ".join(words[::-1]), "2" + " ".join([*bones, words[0]]), "3" + " ".join([*bones[::-1], words[-1]])]


def neighbourhood(names: DataFrame, families: DataFrame, scratch: Scratch, window: int = 6,
                  least: float = 0.7) -> DataFrame:
    """(name, family, sim): pairs of a name and a family at most ``window`` families apart in some order.

    ``names`` and ``families`` have one distinct string column each. All orders are one range
    partitioning by key; per partition only its first and last ``window`` families of each order go
    to the driver and back, so the window crosses borders without a second sort.
    """
    @F.pandas_udf("array<string>")
    def keyed(names: pd.Series) -> pd.Series:
        return names.map(sort_keys)

    left = names.select("name", F.explode(keyed("name")).alias("key"), F.lit(False).alias("ref"))
    right = families.select(F.col("family").alias("name"), F.explode(keyed("family")).alias("key"), F.lit(True).alias("ref"))
    keys = scratch.put(left.unionByName(right))
    n = max(parallelism(scratch.spark), keys.count() // ROWS_PER_TASK)
    ordered = scratch.put(keys.repartitionByRange(n, "key").withColumn("pid", F.spark_partition_id()))
    by = Window.partitionBy("pid", F.substring("key", 1, 1))
    edge = ordered.where("ref").select(
        "pid", "key", "name", F.row_number().over(by.orderBy("key")).alias("a"),
        F.row_number().over(by.orderBy(F.desc("key"))).alias("z")).where(f"a <= {window} or z <= {window}")
    border = sorted((r["pid"], r["key"], r["name"]) for r in edge.select("pid", "key", "name").collect())
    by_order: dict[str, list[tuple[int, str, str]]] = {}
    for row in border:
        by_order.setdefault(row[1][0], []).append(row)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pid = int(pdf["pid"].iloc[0])
        rows = sorted(zip(pdf["key"], pdf["ref"], pdf["name"]))
        out: dict[tuple[str, str], float] = {}
        for order in sorted({k[0] for k, _, _ in rows}):
            inner = [r for r in rows if r[0][0] == order]
            edges = by_order.get(order, [])
            at = bisect.bisect_left(edges, (pid,))
            before = [(k, True, nm) for _, k, nm in edges[max(0, at - window):at]]
            at = bisect.bisect_left(edges, (pid + 1,))
            after = [(k, True, nm) for _, k, nm in edges[at:at + window]]
            line = before + inner + after
            refs = [nm for _, is_ref, nm in line if is_ref]
            at = 0
            for _, is_ref, nm in line:
                if is_ref:
                    at += 1
                    continue
                for family in refs[max(0, at - window):at + window]:
                    if (nm, family) not in out:
                        out[nm, family] = similarity(nm, family)
        kept = [(a, b, s) for (a, b), s in out.items() if s >= least]
        return pd.DataFrame(kept, columns=["name", "family", "sim"])

    pairs = ordered.repartitionByRange(n, "pid").groupBy("pid").applyInPandas(compare, "name string, family string, sim double")
    return pairs.dropDuplicates(["name", "family"])


_PARSED = ("claim_id long, code string, kind string, number int, names array<string>, title_names array<string>, "
           "title_kind string, title_number int, year int, makers array<string>, country string")


def parse_claims(claims: DataFrame, sizes: tuple[int, ...] = (2,), longest: int = 40) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("claim_id", pa.int64()), ("code", pa.string()), ("kind", pa.string()), ("number", pa.int32()),
            ("names", pa.list_(pa.string())), ("title_names", pa.list_(pa.string())), ("title_kind", pa.string()),
            ("title_number", pa.int32()), ("year", pa.int32()), ("makers", pa.list_(pa.string())), ("country", pa.string())])
        for batch in batches:
            rows = []
            for cid, mention, title, quote in zip(*(batch.column(k).to_pylist() for k in range(4))):
                got = parse_claim(mention, title, quote, sizes, longest)
                got["code"] = got["code"] or got.pop("code_title", None)
                rows.append({"claim_id": cid} | {k: got[k] for k in schema.names if k != "claim_id"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return claims.select("claim_id", "entity_mention", "record_title", "quote").mapInArrow(run, _PARSED)


def catalogue(models: DataFrame) -> DataFrame:
    """Distinct (model_id, family, kind, number, code, year, maker, country) over all releases.

    The name ends in a kind of variant and its number, or is a family as a whole; families have any number of words.
    """
    name = F.lower(F.trim(F.regexp_replace("nomenclature", r"\s+", " ")))
    pattern = r"^(.*\S) (mk|block|lot|model) (\d+)$"
    code = F.lower(F.coalesce("primary_equip_code", F.regexp_extract("name", r"^([A-Z]+\d+)", 1)))
    parts = models.select("*", name.alias("__name"))
    varied = F.col("__name").rlike(pattern)
    return parts.select(
        "model_id",
        F.coalesce(F.when(varied, F.regexp_extract("__name", pattern, 1)).otherwise(F.col("__name")), F.lit("")).alias("family"),
        F.when(varied, F.regexp_extract("__name", pattern, 2)).otherwise("").alias("kind"),
        F.when(varied, F.expr("try_cast(regexp_extract(__name, '^(.*\\\\S) (mk|block|lot|model) (\\\\d+)$', 3) as int)")).alias("number"),
        F.concat(F.regexp_extract(code, r"^([a-z]+)0*(\d+)$", 1), F.regexp_extract(code, r"^([a-z]+)0*(\d+)$", 2)).alias("code"),
        F.col("ioc_year").cast("int").alias("year"), F.lower(F.trim("manufacturer")).alias("maker"),
        F.lower(F.trim("country_of_origin")).alias("country")).where("model_id is not null").distinct()


def _unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that belong to exactly one record, with that record."""
    grouped = rows.dropna(subset=keys).groupBy(*keys).agg(
        F.min("model_id").alias("model_id"), F.max("model_id").alias("other"))
    return grouped.where("model_id = other").drop("other")


def match(claims: DataFrame, models: DataFrame, window: int = 6, margin: float = 0.02) -> DataFrame:
    """claim_id, model_id, confidence and evidence for each claim that denotes exactly one record.

    Claims with null or empty mentions, generic ones, those that name only a family and those whose
    variant doesn't exist give no row; exact duplicate claims give one. Families that match equally
    well (within ``margin``) and lead to different records leave a claim unassigned.
    """
    scratch = Scratch(claims.sparkSession, "entities")
    records = scratch.put(catalogue(models))
    shape = records.where("family <> ''").agg(F.collect_set(F.size(F.split("family", " "))).alias("sizes"), F.max(F.length("family")).alias("longest")).first()
    parsed = scratch.put(parse_claims(claims, tuple(sorted(shape["sizes"])), shape["longest"] or 0).dropDuplicates(["claim_id"]))

    by_code = parsed.join(_unique(records.where("code <> ''"), ["code"]), "code").select(
        "claim_id", "model_id", F.lit(1.0).alias("confidence"), F.lit("code").alias("evidence"))

    rest = parsed.where("code is null")
    names = rest.select("claim_id", F.explode("names").alias("name"), F.lit(0).alias("place")).unionByName(
        rest.select("claim_id", F.explode("title_names").alias("name"), F.lit(1).alias("place")))
    families = records.where("family <> ''").select("family").distinct()
    similar = scratch.put(neighbourhood(names.select("name").distinct(), families, scratch, window))
    # the mention's own family goes first; the title's serves where the mention names none
    named = names.join(similar, "name").groupBy("claim_id", "family").agg(
        F.min("place").alias("place"), F.max("sim").alias("sim"))
    best = Window.partitionBy("claim_id").orderBy("place", F.desc("sim"), "family")
    ranked = named.withColumn("r", F.row_number().over(best)).withColumn(
        "top", F.first(F.struct("place", "sim")).over(best))
    chosen = ranked.where(
        (F.col("place") == F.col("top.place")) & (F.col("sim") >= F.col("top.sim") - margin)).select(
        "claim_id", "family", "sim", "place")
    located = scratch.put(chosen.join(rest, "claim_id").select(
        "claim_id", "family", "sim", "year", "country", "makers",
        F.coalesce("number", "title_number").alias("number"),
        F.when(F.col("number").isNotNull(), F.col("kind")).otherwise(F.col("title_kind")).alias("kind")))

    exact = _unique(records.where("family <> ''"), ["family", "kind", "number"])
    numbered = located.where("number is not null").alias("c").join(
        exact.alias("m"), (F.col("c.family") == F.col("m.family")) & (F.col("c.number") == F.col("m.number"))
        & (F.col("c.kind").isNull() | (F.col("c.kind") == F.col("m.kind")))).select(
        "c.claim_id", "m.model_id", F.col("c.sim").alias("sim"), F.lit("variant").alias("evidence"))

    # each combination of year, maker and country that occurs with exactly one record of a family
    hints = ["year", "maker", "country"]
    spread = F.explode(F.array(F.lit(None).cast("string"), F.col("value").cast("string")))
    masked = records.where("family <> ''").select("model_id", "family", *hints)
    for h in hints:
        masked = masked.withColumn("value", F.col(h).cast("string")).withColumn(h, spread).drop("value")
    keyed = masked.distinct().withColumn("signature", F.concat_ws("|", *[F.coalesce(h, F.lit("*")) for h in hints]))
    single = _unique(keyed, ["family", "signature"])
    open_claims = located.where("number is null").select(
        "claim_id", "family", "sim", F.col("year").cast("string").alias("year"), "country",
        F.explode_outer("makers").alias("maker"))
    makers = records.select("family", "maker").where("maker is not null").distinct()
    countries = records.select("family", "country").where("country is not null").distinct()
    known = open_claims.join(makers.withColumn("maker_ok", F.lit(True)), ["family", "maker"], "left").join(
        countries.withColumn("country_ok", F.lit(True)), ["family", "country"], "left")
    hinted = known.groupBy("claim_id", "family", "sim", "year").agg(
        F.max(F.when(F.col("maker_ok"), F.col("maker"))).alias("maker"),
        F.max(F.when(F.col("country_ok"), F.col("country"))).alias("country")).where(
        "year is not null or maker is not null or country is not null")
    signed = hinted.withColumn("signature", F.concat_ws("|", *[F.coalesce(h, F.lit("*")) for h in hints]))
    described = signed.join(single, ["family", "signature"]).select(
        "claim_id", "model_id", "sim", F.lit("description").alias("evidence"))

    both = numbered.unionByName(described).select(
        "claim_id", "model_id", "evidence",
        (F.col("sim") * F.when(F.col("evidence") == "variant", 1.0).otherwise(0.9)).alias("confidence"))
    found = by_code.unionByName(both.select("claim_id", "model_id", "confidence", "evidence"))
    top = Window.partitionBy("claim_id").orderBy(F.desc("confidence"), "model_id")
    one = found.groupBy("claim_id", "model_id").agg(F.max(F.struct("confidence", "evidence")).alias("m")).select("claim_id", "model_id", "m.*")
    return one.withColumn("r", F.row_number().over(top)).withColumn("second", F.lead("confidence").over(top)).where(
        F.expr(f"r = 1 and (second is null or confidence - second >= {margin})")).select(
        "claim_id", "model_id", F.round("confidence", 4).alias("confidence"), "evidence")
