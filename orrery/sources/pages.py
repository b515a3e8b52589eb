"""Web pages to records: HTML to page structure, page to catalogue record, manifests by type."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings that end a page's content, and those that are skipped.
STOP_HEADINGS = {"see also", "references", "external links", "notes", "bibliography", "further reading", "sources", "citations", "footnotes", "footnotes and references"}
SKIP_HEADINGS = {"gallery", "photo gallery", "images"}
# Markers of ammunition and the classes by wording, in order.
AMMUNITION_MARKS = {"bullet diameter", "case length", "rim diameter", "cartridge", "case type", "overall length", "primer type", "parent case"}
CLASS_RULES = (
    ("air_to_air", r"air[- ]to[- ]air"), ("air_to_surface", r"air[- ]to[- ](?:surface|ground)|anti[- ]radiation"), ("surface_to_air", r"surface[- ]to[- ]air|\bsam\b"),
    ("anti_ship", r"anti[- ]ship"), ("anti_tank", r"anti[- ]tank"), ("cruise_missile", r"cruise missile"), ("ballistic_missile", r"ballistic missile"),
    ("aircraft_radar", r"airborne radar|aircraft radar|aesa|fire[- ]control radar"), ("radar", r"\bradar\b"), ("submarine", r"\bsubmarine\b"),
    ("naval_vessel", r"frigate|destroyer|corvette|cruiser|aircraft carrier|patrol (?:boat|vessel)"), ("main_battle_tank", r"main battle tank"),
    ("armoured_vehicle", r"armou?red (?:personnel carrier|fighting vehicle|vehicle)|infantry fighting"), ("artillery", r"howitzer|artillery|mortar"),
    ("utility_vehicle", r"utility vehicle|truck"), ("helicopter", r"helicopter|rotorcraft"), ("aircraft", r"fighter|bomber|aircraft|airplane"), ("small_arm", r"rifle|pistol|machine gun|carbine"),
)
_DROP_TAGS = {"script", "style", "nav", "noscript", "template"}
_DROP_CLASSES = ("hatnote", "navbox", "reflist", "thumb", "mw-editsection", "reference", "ad")
_VOID = {"br", "img", "hr", "input", "meta", "link", "base", "area", "col", "embed", "source", "wbr"}


def clean_text(s: str) -> str:
    """No-break blanks and minus signs made plain, white space collapsed."""
    return re.sub(r"\s+", " ", s.replace("\xa0", " ").replace("−", "-")).strip()


@dataclass
class Page:
    title: str = ""
    url: str | None = None
    category: str = "uncategorized"
    summary: str = ""
    specs: list[tuple[str, str]] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)
    full_text: str = ""


class _Reader(HTMLParser):
    """One pass over the markup: infobox rows, headings and paragraphs in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []  # (tag, starts a dropped part)
        self.drop = 0
        self.title, self.base, self.canonical = "", None, None
        self.box_depth = 0
        self.box_done = False
        self.cell: list[str] | None = None
        self.row: dict[str, str] = {}
        self.cell_kind = ""
        self.specs: list[tuple[str, str]] = []
        self.blocks: list[tuple[str, str]] = []
        self.block: list[str] | None = None
        self.block_tag = ""
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and a.get("href"):
            self.base = self.base or a["href"]
        if tag == "link" and a.get("rel") == "canonical":
            self.canonical = self.canonical or a.get("href")
        classes = a.get("class", "").split()
        if tag in _VOID:
            if tag == "br":
                if self.cell is not None:
                    self.cell.append("; ")
                elif self.block is not None:
                    self.block.append(" ")
            return
        infobox = tag == "table" and "infobox" in classes and not self.box_done
        dropped = not infobox and self.box_depth == 0 and (
            tag in _DROP_TAGS or tag == "table" or any(c in classes for c in _DROP_CLASSES)) or tag in ("script", "style") or (tag == "sup" and "reference" in classes)
        self.stack.append((tag, dropped))
        self.drop += dropped
        if infobox:
            self.box_depth = len(self.stack)
        if self.drop:
            return
        if tag == "title":
            self.in_title = True
        if self.box_depth:
            if tag == "tr":
                self.row = {}
            elif tag in ("th", "td"):
                self.cell, self.cell_kind = [], tag
            elif tag == "li" and self.cell:
                self.cell.append("; ")
        elif tag in ("h1", "h2", "h3", "p", "li"):
            self._flush()
            self.block, self.block_tag = [], tag

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, _ in self.stack):
            return
        while self.stack:
            open_tag, dropped = self.stack.pop()
            self.drop -= dropped
            if self.box_depth and len(self.stack) < self.box_depth:
                self.box_depth, self.box_done = 0, True
            if open_tag == tag:
                break
        if tag == "title":
            self.in_title = False
        if tag in ("th", "td") and self.cell is not None:
            text = re.sub(r"(?:;\s*)+", "; ", clean_text("".join(self.cell))).strip("; ")
            if self.cell_kind == tag:
                self.row.setdefault(tag, text)
            self.cell = None
        if tag == "tr" and self.row.get("th") and self.row.get("td"):
            self.specs.append((self.row["th"], self.row["td"]))
            self.row = {}
        if tag in ("h1", "h2", "h3", "p", "li") and self.block is not None and tag == self.block_tag:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        if self.drop:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif self.block is not None:
            self.block.append(data)

    def _flush(self) -> None:
        if self.block is not None:
            text = clean_text("".join(self.block))
            if text:
                self.blocks.append((self.block_tag, text))
        self.block = None

    def close(self) -> None:
        super().close()
        self._flush()


def classify(type_text: str, lead: str) -> str:
    """First class whose wording stands in the type row, else in the lead."""
    for text in (type_text, lead):
        for name, pattern in CLASS_RULES:
            if text and re.search(pattern, text, re.I):
                return name
    return "uncategorized"


def slug(url: str) -> str:
    """Name for a file from the last part of the address after /wiki/."""
    name = unquote(url.split("/wiki/")[-1].split("?")[0].split("#")[0])
    return re.sub(r"_+", "_", re.sub(r"[()\"'<>:|?*/\\]", "", name.replace(" ", "_"))).lstrip(".").strip("_")


def extract_page(markup: str | None, url: str | None = None) -> Page | None:
    """The page's structure; None for empty markup. Unclosed tags and scripts that contain tags do no harm."""
    if not markup:
        return None
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    lead: list[str] = []
    sections: list[tuple[str, list[str]]] = []
    skipping = False
    title = re.sub(r"\s+-\s+Wikipedia$", "", clean_text(reader.title))
    for tag, text in reader.blocks:
        if tag == "h1":
            title = title or text
        elif tag in ("h2", "h3"):
            low = re.sub(r"\s*\[edit\]$", "", text).lower()
            if low in STOP_HEADINGS:
                break
            skipping = low in SKIP_HEADINGS
            if not skipping:
                sections.append((re.sub(r"\s*\[edit\]$", "", text), []))
        elif not skipping:
            (sections[-1][1] if sections else lead).append(text)
    specs = reader.specs
    kind = next((v for k, v in specs if k.lower() == "type"), next((v for k, v in specs if k.lower() == "class"), ""))
    marks = len({k.lower() for k, _ in specs} & AMMUNITION_MARKS)
    blocks = ["\n\n".join(lead)] + ["\n\n".join([f"{name.upper()}: {body[0]}", *body[1:]]) for name, body in sections if body]
    return Page(title, url or reader.base or reader.canonical, "ammunition" if marks >= 2 else classify(kind, " ".join(lead)), lead[0] if lead else "", specs,
                [name for name, _ in sections], "\n\n".join(b for b in blocks if b))


_PAGE = ("page_id long, title string, url string, category string, summary string, specs array<struct<k:string,v:string>>, sections array<string>, full_text string")


def pages(raw: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """Structures of all pages with a key and markup; pages with null or empty markup give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = pa.struct([("k", pa.string()), ("v", pa.string())])
        schema = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("url", pa.string()), ("category", pa.string()), ("summary", pa.string()),
                            ("specs", pa.list_(spec)), ("sections", pa.list_(pa.string())), ("full_text", pa.string())])
        for batch in batches:
            rows = []
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = extract_page(m)
                if p is not None:
                    rows.append({"page_id": k, "title": p.title, "url": p.url, "category": p.category, "summary": p.summary,
                                 "specs": [{"k": a, "v": b} for a, b in p.specs], "sections": p.sections, "full_text": p.full_text})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return raw.select(F.col(key).cast("long"), markup).mapInArrow(run, _PAGE)


# --- page to record -------------------------------------------------------------------------------

# Fixed values: (category) -> (group, type), and names of fields that mean the same.
GROUP_TYPE = {"air_to_air": ("Munitions", "Air to Air Missile"), "aircraft_radar": ("Sensors", "Aircraft Radar"), "utility_vehicle": ("Ground Vehicles", "Utility Vehicle")}
NAME_ALIASES = {"max speed": "Maximum speed", "maximum speed": "Maximum speed", "range": "Maximum range", "operational range": "Maximum range", "mass": "Weight",
                "designer": "Manufacturer", "in service": "In service"}
# Units by dimension in the order in which they are looked for, with the factor to the first.
QUANTITIES = {
    "length": (("km", 1.0, r"km|kilomet(?:re|er)s?"), ("mi", 1.609344, r"mi|miles?"), ("nmi", 1.852, r"nmi|nautical miles?"), ("m", 0.001, r"m|met(?:re|er)s?"), ("ft", 0.0003048, r"ft|feet|foot")),
    "mass": (("kg", 1.0, r"kg|kilograms?"), ("t", 1000.0, r"tonnes?|t"), ("lb", 0.45359237, r"lbs?|pounds?")),
    "speed": (("km/h", 1.0, r"km/h|kph"), ("mph", 1.609344, r"mph"), ("kn", 1.852, r"kn|knots?"), ("m/s", 3.6, r"m/s"), ("Mach", 1225.0, r"Mach")),
    "power": (("kW", 1.0, r"kW"), ("hp", 0.7456998715822702, r"hp|bhp"), ("W", 0.001, r"W")),
}
METRIC = {"km", "m", "kg", "t", "km/h", "m/s", "kW", "W"}
_NUMBER = r"\d{1,3}(?:[.,]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?"


def to_number(text: str) -> float | None:
    """Thousands separators of either kind; a single comma before other than three digits is decimal."""
    s = text.strip()
    if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", s):
        s = s.replace(",", "")
    elif re.fullmatch(r"\d{1,3}(\.\d{3})+(,\d+)?", s) and s.count(".") > 1 or re.fullmatch(r"\d{1,3}(\.\d{3})+,\d+", s):
        s = s.replace(".", "").replace(",", ".")
    else:
        s = s.replace(",", ".")
    try:
        return float(s)
    except ValueError:
        return None


def quantity(text: str | None, dimension: str) -> tuple[float, str] | None:
    """(value in the dimension's first unit, unit found): the leftmost metric statement, else the leftmost.

    A statement inside one that was already accepted doesn't count.
    """
    if not text or dimension not in QUANTITIES:
        return None
    taken: list[tuple[int, int, float, str]] = []
    for unit, factor, spelling in QUANTITIES[dimension]:
        shape = rf"(?:±\s*)?(?P<n>{_NUMBER})\s*(?:{spelling})(?![A-Za-z])" if unit != "Mach" else rf"Mach\s*(?P<n>{_NUMBER})"
        for m in re.finditer(shape, text):
            value = to_number(m["n"])
            if value is not None and all(m.end() <= a or m.start() >= b for a, b, *_ in taken):
                taken.append((m.start(), m.end(), value * factor, unit))
    if not taken:
        return None
    taken.sort()
    best = next((t for t in taken if t[3] in METRIC), taken[0])
    return best[2], best[3]


def money(text: str | None) -> float | None:
    m = re.search(rf"(?:US\$|\$|USD|€|EUR|£|GBP)\s*({_NUMBER})\s*(billion|bn|million|m|mn|thousand|k)?\b", text or "", re.I)
    if not m:
        return None
    scale = {"billion": 1e9, "bn": 1e9, "million": 1e6, "m": 1e6, "mn": 1e6, "thousand": 1e3, "k": 1e3}.get((m[2] or "").lower(), 1.0)
    n = to_number(m[1])
    return None if n is None else n * scale


def canonical_name(name: Column) -> Column:
    pairs = [F.lit(x) for k, v in NAME_ALIASES.items() for x in (k, v)]
    return F.coalesce(F.create_map(*pairs)[F.lower(name)], name)


def group_type(category: Column) -> Column:
    """struct(group, type): listed categories, else the category's words with capitals."""
    shown = F.initcap(F.regexp_replace(category, "_", " "))
    out = F.struct(shown.alias("group"), shown.alias("type"))
    for k, (g, t) in GROUP_TYPE.items():
        out = F.when(category == k, F.struct(F.lit(g).alias("group"), F.lit(t).alias("type"))).otherwise(out)
    return out


def parametrics(page_rows: DataFrame, first_seq: int = 1001) -> DataFrame:
    """(page_id, seq, parameter, value): specification rows in order under canonical names; repeated names keep the first."""
    rows = page_rows.select("page_id", F.posexplode("specs").alias("pos", "s")).select("page_id", "pos", canonical_name(F.col("s.k")).alias("parameter"), F.col("s.v").alias("value"))
    once = rows.withColumn("r", F.row_number().over(Window.partitionBy("page_id", F.lower("parameter")).orderBy("pos"))).where("r = 1")
    return once.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) + first_seq - 1).alias("seq"), "parameter", "value")


def carry_forward(rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null value up to each row of a group, as when a heading holds for the paragraphs below it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


# Wording of headings by bucket, in the order in which they are tried.
BUCKETS = (("STOP", r"^(?:see also|references|external links|notes)$"), ("Variants", r"variant|version|derivative"), ("Usage", r"operator|user|usage|deploy|service|combat"),
           ("History", r"history|development|origin|background|production"), ("Design", r"design|description|feature|specification|technical|construction"), ("Overview", r"overview|summary|introduction"))


def bucket(heading: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(BUCKETS):
        out = F.when(F.lower(F.trim(heading)).rlike(pattern), name).otherwise(out)
    return out


def descriptions(page_rows: DataFrame) -> DataFrame:
    """(page_id, bucket, text): paragraphs gathered by bucket in order; a STOP heading ends the page; the summary serves a page without any.

    Paragraphs 'HEADING: text' start a bucket that holds until the next one.
    """
    paras = page_rows.select("page_id", F.posexplode(F.split("full_text", r"\n\s*\n")).alias("pos", "para")).where("para <> ''")
    head = F.regexp_extract("para", r"^([A-Z][A-Z0-9 ,&/()-]{2,60}): ", 1)
    marked = paras.withColumn("own", F.when(head != "", F.coalesce(bucket(head), F.lit("Overview")))).withColumn("body", F.regexp_replace("para", r"^[A-Z][A-Z0-9 ,&/()-]{2,60}: ", ""))
    held = carry_forward(marked, "page_id", ["pos"], "own", "held").withColumn(
        "stopped", F.max((F.col("own") == "STOP").cast("int")).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    kept = held.where("coalesce(stopped, 0) = 0").withColumn("bucket", F.coalesce("held", F.lit("Overview")))
    return kept.groupBy("page_id", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda s: s["body"]), "\n\n").alias("text"))


def type_manifests(rows: DataFrame) -> DataFrame:
    """(system_group, system_type, parameters): per type its parameters with unit and count, most frequent first.

    ``rows`` has (system_group, system_type, parameter, uom, seq); the unit is the first one stated.
    """
    g = rows.groupBy("system_group", "system_type", "parameter").agg(F.count("*").alias("count"), F.min(F.when(F.col("uom").isNotNull(), F.struct("seq", "uom")))["uom"].alias("uom"))
    packed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "parameter", "uom", "count")))
    return g.groupBy("system_group", "system_type").agg(F.transform(packed, lambda s: F.struct(s["parameter"].alias("parameter"), s["uom"].alias("uom"), s["count"].alias("count"))).alias("parameters"))


def links(page_rows: DataFrame) -> DataFrame:
    """(title, url) of pages that have an address; a missing title falls back to the address's name."""
    return page_rows.where("url is not null").select(F.coalesce(F.nullif("title", F.lit("")), F.element_at(F.split("url", "/"), -1)).alias("title"), "url")


def render_links(rows: list[tuple[str, str]]) -> str:
    items = "\n".join(f'<li><a href="{html.escape(u, quote=True)}">{html.escape(t)}</a></li>' for t, u in rows)
    return f"<!doctype html>\n<ul>\n{items}\n</ul>\n"
