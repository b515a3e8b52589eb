"""State of the enrichment: append-only tables, each batch under its own name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import enrich


class Ledger:
    """Tables in a directory: claims, docs_seen, failures, runs, rejections.

    ``append`` writes one Parquet directory per batch name and replaces it if the batch is written
    again, so a batch that is repeated after a failure leaves no second copy.
    """

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def append(self, table: str, rows: DataFrame, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.directory}/{table}/batch={batch}")

    def read(self, table: str, empty: DataFrame) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return empty
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.directory}/{table}")

    def next_run(self) -> int:
        runs = self.read("runs", self.spark.createDataFrame([], "run_id int"))
        return (runs.agg(F.max("run_id")).first()[0] or 0) + 1

    def record_failures(self, rows: DataFrame, batch: str) -> None:
        """Failed documents with at most 1,000 characters of the raw reply; they stay unseen and are tried again."""
        self.append("failures", rows.withColumn("raw", F.substring("raw", 1, 1000)), batch)

    def finish_run(self, run_id: int, note: str = "", **counters: int) -> None:
        """Writes a run's row with its counters (documents, calls, tokens, errors), in place of what was written before."""
        row = {"run_id": run_id, "note": note} | counters
        self.append("runs", self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'note' else 'int' if k == 'run_id' else 'long'}" for k in row)), str(run_id))

    def reject(self, full_fp: str, reason: str) -> None:
        self.append("rejections", self.spark.createDataFrame([(full_fp, reason)], "full_fp string, reason string"), f"fp-{full_fp}")

    def status(self) -> dict[str, int]:
        none = self.spark.createDataFrame([], "status string")
        rows = self.read("claims", none)
        return {} if "status" not in rows.columns else {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}


def run_batch(spark: SparkSession, documents: DataFrame, extract, ledger: Ledger, note: str = "") -> DataFrame:
    """One batch: unseen documents are extracted, claims fingerprinted and stored, then graduated over all runs.

    ``extract`` maps documents to claims with an ``error`` column (null if it succeeded); a document with
    an error is recorded as a failure and not marked as seen.
    """
    run_id = ledger.next_run()
    hashed = documents.withColumn("content_hash", F.sha2("text", 256))
    fresh = enrich.unseen(hashed, ledger.read("docs_seen", spark.createDataFrame([], "content_hash string"))).dropDuplicates(["content_hash"])
    from orrery.plans.runtime import Scratch

    got = Scratch(spark, "batch").put(extract(fresh))
    failed = got.where("error is not null")
    claims = enrich.with_fingerprints(got.where("error is null")).withColumn("run_id", F.lit(run_id))
    rejected = ledger.read("rejections", spark.createDataFrame([], "full_fp string, reason string"))
    ledger.append("claims", enrich.without_rejected(enrich.first_in_run(claims), rejected), str(run_id))
    ledger.append("docs_seen", fresh.join(failed.select("doc_id"), "doc_id", "left_anti").select("content_hash", "doc_id"), str(run_id))
    ledger.record_failures(failed.select("doc_id", "error", F.col("error").alias("raw")), str(run_id))
    done = got.agg(F.count_distinct("doc_id").alias("d"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("doc_id"))).alias("e")).first()
    ledger.finish_run(run_id, note, documents=done["d"], errors=done["e"])
    return enrich.graduate(ledger.read("claims", claims))
