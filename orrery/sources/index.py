"""Readers of records and the index of a catalogue, published atomically.

An index is a directory of Parquet tables under a version name; the file CURRENT holds the version
that readers use. A build writes all tables of a new version, checks them and only then replaces the
pointer, so readers never see a half-built index and a failed build leaves the old one in place.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import catalogue, chunks, fields, filters, names, records, retrieval
from orrery.plans.runtime import Scratch

TABLES = ("records", "params", "fields", "passages", "edges", "catalogue", "labels", "aliases", "category_stats", "field_vectors", "meta")
#: Columns without which a table is of another schema.
NEEDED = {"records": ("rid", "title"), "fields": ("rid", "field", "lo", "hi", "str", "kind", "unit"), "passages": ("rid", "text"), "catalogue": ("field", "type", "count"), "aliases": ("alias", "rid")}
#: Fields that say of what type a record is, in the order in which they are looked for.
TYPE_FIELDS = ("systemType", "system_type", "type")


class CatalogueError(RuntimeError):
    """An index or its source can't be used; the message says why."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_records(spark: SparkSession, source: str, skip: str = "schema-example|_index|exemplar_schema") -> DataFrame:
    """Canonical records of one JSON file or all of a directory; a missing, empty or recordless source is an error."""
    path, fs = _fs(spark, source)
    if not fs.exists(path):
        raise CatalogueError(f"source not found: {source}")
    glob = f"{source.rstrip('/')}/*.json" if fs.getFileStatus(path).isDirectory() else source
    if not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(glob)):
        raise CatalogueError(f"no JSON files in {source}")
    raw = spark.read.text(glob, wholetext=True).withColumn("file", F.input_file_name()).where(~F.element_at(F.split("file", "/"), -1).rlike(skip))
    return records.canonical(raw, "value", "file")


def build(spark: SparkSession, canon: DataFrame, units: DataFrame | None = None,
          embed: Callable[[DataFrame], DataFrame] | None = None, embedder: str = "none") -> dict[str, DataFrame]:
    """All tables of an index from canonical records. Only the catalogue needs the fields complete; the rest is independent."""
    canon = Scratch(spark, "index").put(canon)
    own = records.params(canon)
    typed = fields.from_params(own.unionByName(records.comment_intervals(own)))
    plain = records.extras(canon)
    linked = records.relations(canon).where("child_name is not null").select(
        "rid", F.lit("Fitted with").alias("field"), F.lit(0).alias("seq"), *[F.lit(None).cast("double").alias(c) for c in ("num", "lo", "hi")],
        F.col("child_name").alias("str"), F.lit("string").alias("kind"), F.lit(None).cast("string").alias("unit")).distinct()
    both = fields.country_parts(fields.override(plain.unionByName(fields.range_fields(plain)), typed)).unionByName(linked)
    if units is not None:
        both = catalogue.reconcile_units(both, units).drop("unit", "converted").withColumnRenamed("to_unit", "unit").select(*typed.columns)
    both = Scratch(spark, "index").put(both)
    prose = canon.select("rid", "title", F.array_join(F.transform("prose", lambda p: F.concat_ws(": ", p["section"], p["text"])), "\n").alias("prose"))
    view = fields.text_view(canon, F.col("title"), [], own).withColumnRenamed("text", "lines")
    text = prose.join(view, "rid").select("rid", "title", F.concat_ws("\n", "prose", F.regexp_replace("lines", r"^Title:[^\n]*\n?", "")).alias("text"))
    passages = chunks.chunk(text, "rid", "title", "text")
    if embed is not None:
        passages = embed(passages)
    made = Scratch(spark, "index").put(catalogue.classify(both, own.where("upper(dtype) = 'LOV'").select(F.col("name").alias("field"))))
    labels = Scratch(spark, "index").put(catalogue.label_values(both))
    present = {r["field"] for r in made.where(F.col("field").isin(*TYPE_FIELDS)).select("field").collect()}
    kind = next((f for f in TYPE_FIELDS if f in present), TYPE_FIELDS[0])
    vectors = catalogue.descriptor(made, labels)
    vectors = embed(vectors) if embed is not None else vectors.withColumn("embedding", F.lit(None).cast("array<float>"))
    return {
        "records": canon.select("rid", "title", "prose", "media"), "params": own, "fields": both, "passages": passages, "edges": records.relations(canon),
        "catalogue": made, "labels": labels, "category_stats": catalogue.category_stats(both, made, kind), "field_vectors": vectors, "aliases": names.alias_table(canon, "rid", "title", F.col("aliases"), [*names.STOPWORDS, *names.common_words(canon, "title")]),
        "meta": spark.createDataFrame([("embedder", embedder), ("built", str(int(time.time())))], "key string, value string")}


def publish(spark: SparkSession, tables: dict[str, DataFrame], directory: str) -> str:
    """Write a new version, check all its tables, point CURRENT to it; returns the version.

    The pointer is replaced by one overwriting rename, so a reader finds the old version or the new one.
    """
    version = f"v{time.time_ns()}"
    staged = f"{directory.rstrip('/')}/{version}"
    path, fs = _fs(spark, staged)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staged}/{name}")
        for name, df in tables.items():
            if spark.read.parquet(f"{staged}/{name}").columns != df.columns:
                raise CatalogueError(f"table {name} is incomplete")
        if spark.read.parquet(f"{staged}/records").limit(1).count() == 0:
            raise CatalogueError("no records")
    except Exception:
        fs.delete(path, True)
        raise
    pointer, fs = _fs(spark, f"{directory.rstrip('/')}/CURRENT")
    fresh, _ = _fs(spark, f"{directory.rstrip('/')}/CURRENT.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, pointer, overwrite)
    return version


def remove_old(spark: SparkSession, directory: str, keep: int = 2) -> list[str]:
    """Deletes all versions but the current one and the ``keep`` newest; returns what was deleted."""
    root, fs = _fs(spark, directory)
    held = current(spark, directory)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v"))
    gone = [v for v in versions[:max(0, len(versions) - keep)] if v != held]
    for v in gone:
        fs.delete(_fs(spark, f"{directory.rstrip('/')}/{v}")[0], True)
    return gone


def current(spark: SparkSession, directory: str) -> str:
    pointer, fs = _fs(spark, f"{directory.rstrip('/')}/CURRENT")
    if not fs.exists(pointer):
        raise CatalogueError(f"no index in {directory}")
    return spark.read.text(f"{directory.rstrip('/')}/CURRENT").first()[0]


class Index:
    """An opened index; tables are read lazily and cached per version."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory
        self.version = current(spark, directory)
        self._tables: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.directory}/{self.version}/{name}")
        return self._tables[name]

    def refresh(self) -> bool:
        """True if a newer version was published since; its tables are used from then on."""
        latest = current(self.spark, self.directory)
        if latest == self.version:
            return False
        self.version, self._tables = latest, {}
        return True

    def check_embedder(self, name: str, dimension: int | None = None, allow: bool = False) -> None:
        """Another embedder than the index was built with is an error unless allowed; another dimension always is."""
        stored = {r["key"]: r["value"] for r in self.meta.collect()}
        if stored.get("embedder") != name and not allow:
            raise CatalogueError(f"the index was built with {stored.get('embedder')}, not {name}")
        if dimension is not None and "embedding" in self.passages.columns:
            first = self.passages.where("embedding is not null").select(F.size("embedding").alias("n")).first()
            if first and first["n"] != dimension:
                raise CatalogueError(f"the index has {first['n']} dimensions, not {dimension}")

    def check_schema(self) -> None:
        """An index whose tables lack columns was built by another version and must be built anew."""
        for name, columns in NEEDED.items():
            missing = sorted(set(columns) - set(getattr(self, name).columns))
            if missing:
                raise CatalogueError(f"table {name} lacks {', '.join(missing)}; build the index anew")

    def field_ranking(self, vector: list[float] | None) -> dict[str, float] | None:
        """Similarity of each field to an embedded question, or None where the index has no field vectors (then coverage ranks)."""
        if vector is None:
            return None
        rows = self.field_vectors.where(F.col("embedding").isNotNull())
        scored = retrieval.vector_top(rows, "embedding", vector, "field", pool=1000).collect()
        return {r["field"]: r["score"] for r in scored} or None

    def catalogue_map(self) -> dict[str, dict]:
        """The catalogue for the planner: one entry per field name."""
        labels = {r["field"]: r["values"] for r in self.labels.collect()}
        units = {r["field"]: r["unit"] for r in self.fields.where("unit is not null").groupBy("field").agg(F.min("unit").alias("unit")).collect()}
        return {r["field"]: {"type": r["type"], "count": r["count"], "min": r["min"], "max": r["max"], "admin": r["admin"], "unit": units.get(r["field"]), "values": labels.get(r["field"], [])}
                for r in self.catalogue.orderBy(F.desc("count"), "field").collect()}


def ingest(spark: SparkSession, source: str, directory: str, **options) -> str:
    canon = read_records(spark, source)
    if canon.limit(1).count() == 0:
        raise CatalogueError(f"no records in {source}")
    return publish(spark, build(spark, canon, **options), directory)


def field_aliases(files: list[str], built_in: dict[str, list[str]] | None = None) -> dict[str, str]:
    """{alias: field} from JSON files over built-in ones, names in plain form.

    A file maps fields to lists of aliases or aliases to fields; what is read later wins.
    """
    out: dict[str, str] = {}
    for source in [built_in or {}, *(json.loads(Path(f).read_text(encoding="utf-8")) for f in files)]:
        for key, value in source.items():
            for alias, target in [(a, key) for a in value] if isinstance(value, list) else [(key, value)]:
                out[filters.plain_name(alias)] = target
    return out


def snapshot(index: Index, directory: str) -> dict[str, int]:
    """Writes the catalogue as JSON lines and its prompt lines as text under ``directory``; returns the number of fields by type."""
    index.catalogue.join(index.labels, "field", "left").orderBy(F.desc("count"), "field").coalesce(1).write.mode("overwrite").json(f"{directory}/catalogue")
    catalogue.spec_lines(index.catalogue, index.labels).orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(f"{directory}/prompt")
    return {r["type"]: r["fields"] for r in catalogue.type_counts(index.catalogue).collect()}


def write_records(canon: DataFrame, directory: str, clean: bool = False) -> None:
    """Records as JSON lines; ``clean`` replaces what is there, else it must not exist."""
    canon.write.mode("overwrite" if clean else "errorifexists").json(directory)


def hashed_embedder(dimension: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Deterministic embedder without a model: signed hashed words, unit length. Any mapper with the same contract can take its place."""
    from pyspark.sql import Column

    def vector(text: str) -> Column:
        words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z0-9]+"), F.lit(0))
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        sums = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda d: F.aggregate(
            F.filter(hashed, lambda h: F.pmod(h, F.lit(dimension)) == d), F.lit(0.0), lambda s, h: s + F.when(F.pmod(F.shiftright(h, 17), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
        norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(norm > 0, F.transform(sums, lambda x: (x / norm).cast("float")))

    return lambda df: df.withColumn("embedding", vector("text"))
