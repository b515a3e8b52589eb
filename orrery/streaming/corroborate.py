"""Incremental enrichment as streams: claims arrive in files, clusters gather sources, documents are seen once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import enrich


def clusters(claims: DataFrame) -> DataFrame:
    """Streaming aggregate: sources and claims of each (model_id, canon_field).

    State is one row per distinct claim of a cluster and one per cluster and document, both partitioned
    by their keys; exact duplicate claims are dropped by id.
    """
    valid = claims.where("model_id is not null and canon_field is not null and value_norm is not null").dropDuplicates(["claim_id"])
    # sources are counted exactly: first per document, in the consumer over documents
    return valid.groupBy("model_id", "canon_field", "doc_id").agg(F.count("*").alias("claims"))


def summarise(per_document: DataFrame, sources: int = enrich.SOURCES) -> DataFrame:
    return per_document.groupBy("model_id", "canon_field").agg(
        F.count("*").alias("docs"), F.sum("claims").alias("claims")).where(F.col("docs") >= sources)


def clusters_once(spark: SparkSession, claims_path: str, scratch: str) -> DataFrame:
    """Runs the stream over all files that are there (availableNow) and returns the clusters of two or more sources."""
    schema = spark.read.parquet(claims_path).schema
    directory = f"{claims_path.rsplit('/', 1)[0]}"
    name = claims_path.rsplit("/", 1)[1]
    jpath = spark._jvm.org.apache.hadoop.fs.Path(claims_path)
    is_file = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile()
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", name).parquet(directory) if is_file else reader.parquet(claims_path)
    out = f"{scratch}/clusters"

    def store(batch: DataFrame, batch_id: int) -> None:
        # the aggregate's complete result replaces the table, so a repeated batch changes nothing
        batch.write.mode("overwrite").parquet(f"{out}/{batch_id}")

    stream = clusters(source).writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{scratch}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    last = max(int(s.getPath().getName()) for s in jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(out)))
    return summarise(spark.read.parquet(f"{out}/{last}"))


def enrich_stream(spark: SparkSession, documents: DataFrame, extract, state_dir: str, run_id: int, checkpoint: str):
    """Streaming variant of a batch of enrichment: unseen documents are extracted, their claims appended.

    ``extract`` maps a DataFrame of documents to claims. Each micro-batch writes under its id, so that a
    batch that is run again after a failure replaces its own output.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        from orrery.sources import state

        ledger = state.Ledger(spark, state_dir)
        fresh = enrich.unseen(batch, ledger.read("docs_seen", batch.sparkSession.createDataFrame([], "content_hash string")))
        once = fresh.dropDuplicates(["content_hash"])
        ledger.append("claims", extract(once).withColumn("run_id", F.lit(run_id)), f"{run_id}-{batch_id}")
        ledger.append("docs_seen", once.select("content_hash", "doc_id"), f"{run_id}-{batch_id}")

    return documents.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling windows with a watermark for late rows (beyond the reference); the time column has no zone and is cast."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
