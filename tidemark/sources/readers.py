"""CSV and JSONL sources of a contract, read as text with file positions, and trusted tables behind a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import Contract, typed


def csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """Typed rows with broken rules and the file they come from."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    for f in contract.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast("string"))
    return typed(rows.withColumn("_file", F.input_file_name()), contract)


def jsonl_rules(value) -> F.Column:
    """Why a line is no record: blank, malformed, or JSON that is no object; null for records."""
    line = F.trim(value)
    is_json = F.try_parse_json(line).isNotNull()
    return F.when(value.isNull() | (line == ""), "JSONL_BLANK_LINE").when(~is_json, "JSONL_MALFORMED").when(~line.startswith("{"), "JSONL_NON_OBJECT")


def jsonl(lines: DataFrame, contract: Contract) -> DataFrame:
    """Typed rows of a column ``value`` of lines; lines that are no records have their rule and null fields."""
    broken = jsonl_rules(F.col("value"))
    fields = [F.get_json_object("value", f"$.{f.name}").alias(f.name) for f in contract.fields]
    rows = typed(lines.withColumn("_broken", broken).select("*", *fields), contract)
    return rows.withColumn("rules", F.when(F.col("_broken").isNotNull(), F.array("_broken")).otherwise(F.col("rules"))).drop("_broken")


def trusted(spark: SparkSession, folder: str, contracts: dict[str, Contract]) -> dict[str, DataFrame]:
    """Accepted tables of an ingestion that passed; any other status or contract version is an error."""
    text = spark.read.text(f"{folder}/ingestion-manifest.json", wholetext=True).first()[0]
    manifest = json.loads(text)
    if manifest.get("pipeline_status") != "passed":
        raise ValueError(f"{folder}: status {manifest.get('pipeline_status')}")
    for name, contract in contracts.items():
        if manifest.get("contract_versions", {}).get(name, contract.version) != contract.version:
            raise ValueError(f"{name}: contract version differs")
    return {name: spark.read.parquet(f"{folder}/accepted/{name}") for name in contracts}


def write_classified(rows: DataFrame, folder: str, name: str, overwrite: bool = False) -> None:
    """Accepted and quarantined rows side by side; an existing output is an error unless overwritten."""
    mode = "overwrite" if overwrite else "errorifexists"
    rows.where(F.size("rules") == 0).drop("rules").write.mode(mode).parquet(f"{folder}/accepted/{name}")
    rows.where(F.size("rules") > 0).write.mode(mode).parquet(f"{folder}/quarantine/{name}")
