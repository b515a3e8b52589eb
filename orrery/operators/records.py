"""Raw JSON records of two shapes to one canonical structure.

Shape logic is irregular, so it stays in one Arrow boundary: :func:`canonical` turns JSON texts into a
nested struct; everything after it is columns. The catalogue shape has lists of descriptions,
parametrics, relations, proliferations, aliases and codes; the native shape has a parameters object
and free fields. Structures that can't be stored are counted by path instead of being lost silently.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import values as V

# Keys of the catalogue shape, and spellings of value, unit and description keys.
SHAPE_KEYS = ("parametrics", "descriptions", "nomenclature", "modelID")
VALUE_KEYS, UNIT_KEYS, DESCRIPTION_KEYS = ("value", "val"), ("unit", "uom"), ("definition", "description", "parameterDescr")
# Wording of statuses, of service entry and of a year.
OPERATING = re.compile(r"using|user|operat|service|deploy", re.I)
PRODUCING = re.compile(r"produc|manufactur|develop|design|build", re.I)
YEAR = re.compile(V.SERVICE_YEAR)
ENTRY = re.compile(r"\b(?:entered\s+(?:limited\s+)?service|in\s+service\s+since|introduced(?:\s+to\s+service)?|IOC|initial\s+operational\s+capability|declared\s+operational|fielded)\b", re.I)
SERVICE_FIELD = "serviceEntryYear"


@dataclass
class Canonical:
    id: str | None = None
    title: str | None = None
    prose: list[dict] = field(default_factory=list)
    params: list[dict] = field(default_factory=list)
    extras: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    media: list[str] = field(default_factory=list)
    dropped: list[dict] = field(default_factory=list)

    def drop(self, path: str, value: Any) -> None:
        reason = "list of objects" if isinstance(value, list) and any(isinstance(x, dict) for x in value) else "mixed list" if isinstance(value, list) else type(value).__name__
        keys = sorted({k for x in value if isinstance(x, dict) for k in x})[:8] if isinstance(value, list) else []
        self.dropped.append({"path": path, "reason": reason, "keys": ",".join(keys)})

    def extra(self, path: str, value: Any) -> None:
        for k, v in enumerate(value if isinstance(value, list) else [value]):
            kind = "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
            self.extras.append({"path": path, "seq": k, "num": float(v) if kind == "number" else None, "str": None if kind == "number" else str(v).lower() if kind == "bool" else v, "kind": kind})

    def param(self, name: str, value: Any, unit: Any = None, descr: Any = None, qualifier: Any = None, component: Any = None, dtype: Any = None) -> None:
        text = None if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)
        opt = lambda x: str(x) if x not in (None, "") else None
        self.params.append({"seq": len(self.params), "name": name, "value": text, "unit": opt(unit), "descr": opt(descr), "qualifier": opt(qualifier), "component": opt(component), "dtype": opt(dtype)})


def unescape(x: Any) -> Any:
    """HTML entities of all keys and texts decoded exactly once."""
    if isinstance(x, str):
        return html.unescape(x)
    if isinstance(x, list):
        return [unescape(i) for i in x]
    return {html.unescape(str(k)): unescape(v) for k, v in x.items()} if isinstance(x, dict) else x


def _first(row: dict, keys: tuple[str, ...]) -> Any:
    return next((row[k] for k in keys if row.get(k) is not None), None)


def service_year(value: Any) -> int | None:
    """A year from 1930 to 2035 of a whole number or a text."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value) if float(value).is_integer() and 1930 <= value <= 2035 else None
    m = YEAR.search(str(value))
    return int(m.group(1)) if m else None


def year_from_prose(texts: list[str]) -> int | None:
    """The year that shares a clause with wording of service entry; several years only if one is at least 8 characters nearer."""
    near: list[tuple[int, int]] = []
    for clause in re.split(r"[.;\n]", " ".join(texts)):
        cues = [m.start() for m in ENTRY.finditer(clause)]
        near += [(min(abs(y.start() - c) for c in cues), int(y.group(1))) for y in YEAR.finditer(clause) if cues]
    if not near:
        return None
    near.sort()
    if len({y for _, y in near}) == 1 or near[1][0] - near[0][0] >= 8:
        return near[0][1]
    return None


def normalise(raw: dict, base: str | None = None) -> Canonical:
    """The canonical form of one record; ``base`` serves as id where the record has none."""
    raw = unescape(raw)
    out = Canonical()
    rid = raw.get("id") or raw.get("modelID") or base
    out.id = None if rid is None else str(rid)
    title = raw.get("title") or raw.get("nomenclature") or out.id
    out.title = None if title is None else str(title)
    catalogue_shape = any(k in raw for k in SHAPE_KEYS)
    used = {"id", "title", "modelID", "descriptions", "media"}
    for d in raw.get("descriptions") or []:
        text = isinstance(d, dict) and (d.get("description") or d.get("shortDescription"))
        if text:
            out.prose.append({"section": str(d.get("descrType") or "Description"), "text": str(text)})
    out.media = [json.dumps(m, sort_keys=True) for m in raw.get("media") or []] if isinstance(raw.get("media"), list) else []
    if catalogue_shape:
        used |= _catalogue_shape(raw, out)
    else:
        for key in ("parameters", "params"):
            if isinstance(raw.get(key), dict):
                used.add(key)
                for name, spec in raw[key].items():
                    if isinstance(spec, dict) and _first(spec, VALUE_KEYS) is None and not set(spec) & set(VALUE_KEYS):
                        _flatten(spec, "", out, set())
                    elif isinstance(spec, dict):
                        out.param(name, _first(spec, VALUE_KEYS), _first(spec, UNIT_KEYS), _first(spec, DESCRIPTION_KEYS))
                    else:
                        out.param(name, spec)
    mined = year_from_prose([p["text"] for p in out.prose if p["section"] != "Proliferation"])
    stated = next((e["num"] for e in out.extras if e["path"] == SERVICE_FIELD), None)
    if mined is not None and stated is None:
        out.extra(SERVICE_FIELD, mined)
    elif mined is not None and stated != mined:
        out.dropped.append({"path": f"{SERVICE_FIELD}.prose_conflict", "reason": "prose names another year", "keys": ""})
    _flatten(raw, "", out, used)
    return out


def _catalogue_shape(raw: dict, out: Canonical) -> set[str]:
    used = {"parametrics"}
    rows = raw.get("parametrics")
    if isinstance(rows, list) and rows:
        if all(isinstance(r, dict) and "parameter" in r and "parameterValue" in r for r in rows):
            for r in rows:
                if r.get("childModelID") is not None or r.get("childModel"):
                    out.relations.append(_relation(r, r.get("childModel") or r.get("parameterValue"), r.get("parameterOnly") or r.get("parameter")))
                    continue
                name = r.get("parameterOnly") or re.sub(r"\s+-\s+\d+$", "", str(r.get("parameter") or ""))
                if name:
                    notes = [str(x) for x in (r.get("parameterSubTitle"), r.get("comments")) if x]
                    out.param(str(name), r.get("parameterValue"), r.get("uom"), r.get("parameterDescr"), "; ".join(notes), r.get("componentOnly") or r.get("component"), r.get("dataType"))
        else:
            out.drop("parametrics", rows)
    if isinstance(raw.get("relations"), list):
        used.add("relations")
        out.relations += [_relation(r, r.get("childModel"), r.get("relationType")) for r in raw["relations"] if isinstance(r, dict) and (r.get("childModelID") is not None or r.get("childModel"))]
    names = [a.get("alias") for a in raw.get("aliases") or [] if isinstance(a, dict)] + [c.get("code") for c in raw.get("codes") or [] if isinstance(c, dict)] + [raw.get("primaryEquipCode")]
    used |= {k for k in ("aliases", "codes") if isinstance(raw.get(k), list)}
    out.aliases = list(dict.fromkeys(str(n) for n in names if n))
    if out.aliases:
        out.prose.append({"section": "Also known as", "text": "; ".join(out.aliases)})
    if _proliferations(raw.get("proliferations"), out):
        used |= {"proliferations", "countryList", "regionList", "trigraphLists"}
    if out.relations:
        said = [f"{r['child_name']} ({', '.join(x for x in (r['relation_type'], r['component']) if x)})" for r in out.relations if r["child_name"]]
        out.prose.append({"section": "Related systems", "text": "; ".join(said)})
    return used


def _relation(r: dict, name: Any, kind: Any) -> dict:
    opt = lambda x: None if x in (None, "") else str(x)
    return {"child_id": opt(r.get("childModelID")), "child_name": opt(name), "parent_id": opt(r.get("parentModelID")), "component": opt(r.get("componentOnly") or r.get("component") or r.get("parentComponent")), "relation_type": opt(kind)}


def _proliferations(rows: Any, out: Canonical) -> bool:
    """Countries by what they do with the system, regions, the earliest IOC year and the fielding status."""
    if not isinstance(rows, list) or not rows:
        return False
    found: dict[str, list] = {"Operated by (country)": [], "Produced by (country)": [], "Proliferation region": [], "Fielding status": []}
    years, said = [], []
    for r in (x for x in rows if isinstance(x, dict)):
        country, status = r.get("country"), str(r.get("proliferation") or "").strip()
        kind = next((str(v or "").strip() for k, v in r.items() if str(k).lower() == "type"), "")
        if r.get("region"):
            found["Proliferation region"].append(str(r["region"]))
        if "ioc" in kind.lower():
            year = service_year(status)
            if year is not None:
                years.append(year)
                found["Operated by (country)"] += [str(country)] if country else []
        elif kind.lower() == "projected fielding":
            found["Fielding status"].append("Projected")
        elif not kind and country and status:
            found["Operated by (country)"] += [str(country)] if OPERATING.search(status) else []
            found["Produced by (country)"] += [str(country)] if PRODUCING.search(status) else []
        if country or status:
            org = f" ({r['organization']})" if r.get("organization") else ""
            said.append(" - ".join(x for x in (str(country or "unknown country"), kind, status) if x) + org)
    for name, items in found.items():
        if items:
            out.extra(name, list(dict.fromkeys(items)))
    if years:
        out.extra(SERVICE_FIELD, min(years))
    if said:
        out.prose.append({"section": "Proliferation", "text": "; ".join(said)})
    return True


def _flatten(node: dict, prefix: str, out: Canonical, skip: set[str]) -> None:
    """All other scalars as extras under dotted paths; value objects as parameters; unknown lists are reported."""
    for key, value in node.items():
        if not prefix and key in skip:
            continue
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(value, dict):
            if set(value) & set(VALUE_KEYS):
                if _first(value, VALUE_KEYS) is not None:
                    out.param(path, _first(value, VALUE_KEYS), _first(value, UNIT_KEYS), _first(value, DESCRIPTION_KEYS))
            else:
                _flatten(value, prefix if key in ("parameters", "params") else path, out, set())
        elif isinstance(value, list):
            if value and all(isinstance(x, (str, int, float, bool)) for x in value):
                out.extra(path, value)
            elif value:
                out.drop(path, value)
        elif value is not None:
            out.extra(path, value)


_STR = pa.string()
ARROW = pa.schema([
    ("rid", _STR), ("title", _STR), ("prose", pa.list_(pa.struct([("section", _STR), ("text", _STR)]))),
    ("params", pa.list_(pa.struct([("seq", pa.int32()), *[(c, _STR) for c in ("name", "value", "unit", "descr", "qualifier", "component", "dtype")]]))),
    ("extras", pa.list_(pa.struct([("path", _STR), ("seq", pa.int32()), ("num", pa.float64()), ("str", _STR), ("kind", _STR)]))),
    ("relations", pa.list_(pa.struct([(c, _STR) for c in ("child_id", "child_name", "parent_id", "component", "relation_type")]))),
    ("aliases", pa.list_(_STR)), ("media", pa.list_(_STR)), ("dropped", pa.list_(pa.struct([(c, _STR) for c in ("path", "reason", "keys")])))])
SCHEMA = ("rid string, title string, prose array<struct<section:string,text:string>>, params array<struct<seq:int,name:string,value:string,unit:string,descr:string,qualifier:string,component:string,dtype:string>>, "
          "extras array<struct<path:string,seq:int,num:double,str:string,kind:string>>, relations array<struct<child_id:string,child_name:string,parent_id:string,component:string,relation_type:string>>, "
          "aliases array<string>, media array<string>, dropped array<struct<path:string,reason:string,keys:string>>")


def canonical(raw: DataFrame, text: str = "value", name: str | None = None) -> DataFrame:
    """One row per record of JSON texts that hold an object or a list of objects; anything else gives no row.

    Ids come from the record, else from the source's base name and the place in its list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                loaded = json.loads(t)
                listed = loaded if isinstance(loaded, list) else [loaded]
                for i, r in enumerate(listed):
                    if isinstance(r, dict):
                        c = normalise(r, f"{n}#{i}" if n and isinstance(loaded, list) else n)
                        rows.append({"rid": c.id, "title": c.title, "prose": c.prose, "params": c.params, "extras": c.extras, "relations": c.relations,
                                     "aliases": c.aliases, "media": c.media, "dropped": c.dropped})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    base = F.regexp_extract(F.col(name), r"([^/]+?)(?:\.json)?$", 1) if name else F.lit(None).cast("string")
    return raw.select(F.col(text), base.alias("base")).mapInArrow(run, SCHEMA)


def params(records: DataFrame) -> DataFrame:
    return records.select("rid", F.explode("params").alias("p")).select("rid", "p.*")


def extras(records: DataFrame) -> DataFrame:
    """Extras as rows of the long field table, dates in ISO form."""
    e = records.select("rid", F.explode("extras").alias("e")).where("e.num is not null or e.str <> ''")
    text = F.col("e.str")
    return e.select("rid", F.col("e.path").alias("field"), F.col("e.seq").alias("seq"),
                    F.coalesce("e.num", V.coerce_number(text)).alias("num"), F.coalesce("e.num", V.coerce_number(text)).alias("lo"), F.coalesce("e.num", V.coerce_number(text)).alias("hi"),
                    F.when(V.coerce_number(text).isNull(), F.coalesce(V.parse_date(text).cast("string"), text)).alias("str"),
                    F.when(F.col("e.kind") == "bool", "bool").when(F.coalesce("e.num", V.coerce_number(text)).isNotNull(), "number").otherwise("string").alias("kind"),
                    F.lit(None).cast("string").alias("unit"))


def relations(records: DataFrame) -> DataFrame:
    return records.select("rid", F.explode("relations").alias("r")).select("rid", "r.*")


def import_report(records: DataFrame) -> DataFrame:
    """(path, reason, count, keys) of structures that weren't stored, most frequent first."""
    d = records.select(F.explode("dropped").alias("d")).select("d.*")
    return d.groupBy("path", "reason").agg(F.count("*").alias("count"), F.min("keys").alias("keys")).orderBy(F.desc("count"), "path")


def comment_intervals(rows: DataFrame) -> DataFrame:
    """Rows of parameters whose qualifier states exactly one range around the value, as a further variant.

    A dash range counts only if the value lies inside; 'to' ranges count in any case.
    """
    shape = r"(?<![\w.-])(\d+(?:,\d{3})*(?:\.\d+)?)\s*(to|-|–)\s*(\d+(?:,\d{3})*(?:\.\d+)?)(?![\w.-])"
    got = lambda k: F.regexp_extract("qualifier", shape, k)
    num = V.coerce_number(F.col("value"), force=True)
    a, b = V.strip_thousands(got(1)).try_cast("double"), V.strip_thousands(got(3)).try_cast("double")
    lo, hi = F.least(a, b), F.greatest(a, b)
    one = rows.where(F.col("qualifier").isNotNull() & (F.regexp_count("qualifier", F.lit(shape)) == 1))
    kept = one.where(num.isNotNull() & ((F.lower(got(2)) == "to") | num.between(lo, hi)))
    text = F.concat(lo.cast("string"), F.lit(" to "), hi.cast("string"))
    return kept.withColumn("value", text).withColumn("dtype", F.lit("Number")).withColumn("seq", F.col("seq") + 1000)
