"""Streaming ingestion: the batch classifier under Structured Streaming, and sessions with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ingestion
from ..sources.contracts import Contract, drift


def ingest(spark: SparkSession, source: str, target: str, contract: Contract, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Classify the lines of all files in a folder in micro-batches; every batch goes to its own folder of target.

    Rows carry their file and line, since a batch takes files whole. Like the batch path it sees one row at a
    time: no rules across tables, no duplicates, no thresholds. A batch that is run again after a failure
    overwrites what it had written.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)

    def classified(rows: DataFrame, batch: int) -> None:
        found = ingestion.of_lines(ingestion.numbered(rows), contract)
        found.where(F.size("rules") == 0).drop("rules").write.mode("overwrite").parquet(f"{target}/accepted/batch={batch}")
        found.where(F.size("rules") > 0).write.mode("overwrite").parquet(f"{target}/quarantine/batch={batch}")

    return lines.writeStream.foreachBatch(classified).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(spark: SparkSession, target: str) -> DataFrame:
    """batch, accepted and quarantined rows of a stream's folders; a batch without rows of a kind has 0."""
    sides = [spark.read.option("basePath", f"{target}/{kind}").parquet(f"{target}/{kind}/batch=*").groupBy("batch").agg(F.count("*").alias(kind)) for kind in ("accepted", "quarantine")]
    both = sides[0].join(sides[1], "batch", "full_outer").na.fill(0, ["accepted", "quarantine"])
    return both.withColumnRenamed("quarantine", "quarantined")


def run(spark: SparkSession, source: str, target: str, contract: Contract, schema_policy: str = "strict", max_quarantine_rate: float = 1.0, files_per_batch: int = 1, overwrite: bool = False) -> dict:
    """The stream over all files that are there, then its manifest, in the form of the batch path's; returns the manifest.

    Drift is judged by the first record before anything is read into batches; an error stops the run. The stream
    resumes from its checkpoint, so new files of a folder go into further batches and the manifest covers all.
    ``overwrite`` only allows a manifest to be replaced.
    """
    if contract.format != "jsonl":
        raise ValueError(f"{contract.dataset}: streams take jsonl")
    before = ingestion.manifest(spark, f"{target}/ingestion-manifest.json")
    if before is not None and not overwrite:
        raise FileExistsError(f"{target} has a manifest; pass overwrite")
    keys = ingestion.first_keys(ingestion.numbered(spark.read.text(source)))
    said = [ingestion.Finding(rule, contract.dataset, severity, column) for rule, column, severity in drift(contract, keys or contract.names, schema_policy)]
    counts, batches = {"source": 0, "accepted": 0, "quarantined": 0, "cross_failures": 0, "rate": 0.0}, 0
    if not any(f.severity == "error" for f in said):
        query = ingest(spark, source, target, contract, f"{target}/_checkpoint", files_per_batch)
        query.awaitTermination()
        good, bad, batches = counted(spark, target).agg(F.coalesce(F.sum("accepted"), F.lit(0)), F.coalesce(F.sum("quarantined"), F.lit(0)), F.count("*")).first()
        counts |= {"source": good + bad, "accepted": good, "quarantined": bad, "rate": round(bad / (good + bad), 6) if good + bad else 0.0}
    failed = any(f.severity == "error" for f in said) or counts["rate"] > max_quarantine_rate
    status = "failed" if failed else "passed_with_warnings" if said or counts["quarantined"] else "passed"
    config = {"source": source, "contracts": {contract.dataset: contract.version}, "schema_policy": schema_policy, "files_per_batch": files_per_batch}
    out = {"run_id": ingestion.run_id("str_", config), "pipeline_status": status, "contract_versions": config["contracts"], "datasets": {contract.dataset: counts}, "batches": batches, "findings": [f.__dict__ for f in said], "lineage": {contract.dataset: source}}
    ingestion.write_document(spark, out, f"{target}/ingestion-manifest.json", overwrite)
    return out


def session_counts(events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Events per user and session window; rows later than the watermark are dropped on a stream."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", f"{minutes} minutes")).agg(F.count("*").alias("event_count"))
