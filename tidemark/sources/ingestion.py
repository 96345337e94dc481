"""Batch ingestion end to end: numbered lines, file rules, manifest gates, cross rules joined back, duplicates, thresholds, sinks."""

from __future__ import annotations

import csv as csv_
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quality
from .contracts import Contract, drift, typed
from .readers import jsonl_rules

POLICIES = {"reject": "reject", "keep-first": "keep_first", "keep-last": "keep_last"}


def numbered(lines: DataFrame) -> DataFrame:
    """file, line (from 1 within the file) and value of text files, without ordering rows: lines of each block of a file are counted, then offset.

    A task may read blocks of several files in any order, but each block whole and from its start.
    """
    place = F.monotonically_increasing_id()
    rows = lines.select(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("_block"), place.alias("_at"), "value")
    sizes = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    sizes = sizes.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(sizes, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value")


@dataclass(frozen=True)
class Finding:
    """A rule that a whole file or dataset breaks."""

    rule: str
    dataset: str
    severity: str
    detail: str = ""


def rule_result(rule: str, dataset: str, failures: int, severity: str = "error") -> dict:
    """A rule's result as manifests hold it: its name, and referential for foreign keys, temporal for the others across tables."""
    return {"rule_id": rule, "name": rule.replace("_", " ").title(), "category": "referential" if rule.startswith("FK_") else "temporal", "dataset": dataset, "severity": severity, "failures": failures, "status": "failed" if failures else "passed"}


def safe_value(value: Column) -> Column:
    """An offending value as it may stand in a report: JSON text, long ones cut."""
    text = F.to_json(F.struct(value.alias("v")))
    return F.substring(F.regexp_extract(text, r'^\{"v":(.*)\}$', 1), 1, 200)


def read_csv(spark: SparkSession, path: str, contract: Contract, policy: str = "strict") -> tuple[DataFrame | None, list[Finding]]:
    """Typed rows with file, line and rules (the header is line 1), or None where the file can't be read as a table.

    A field may hold quoted commas and quotes, but no line breaks.
    """
    lines = spark.read.text(path)
    head = lines.first()
    if head is None or not head[0].strip():
        return None, [Finding("FILE_EMPTY", contract.dataset, "critical")]
    names = next(csv_.reader([head[0]]))
    if len(set(names)) < len(names):
        return None, [Finding("CSV_DUPLICATE_HEADER", contract.dataset, "critical")]
    found = [Finding(rule, contract.dataset, severity, column) for rule, column, severity in drift(contract, names, policy)]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = numbered(lines).where("line > 1").select("file", "line", F.from_csv("value", schema, {"mode": "PERMISSIVE", "escape": '"'}).alias("r"))
    return _typed(rows.select("file", "line", "r.*"), contract, names), found


def read_jsonl(spark: SparkSession, path: str, contract: Contract, policy: str = "strict") -> tuple[DataFrame | None, list[Finding]]:
    """Typed rows with file, line and rules; drift is judged by the keys of the first record."""
    lines = numbered(spark.read.text(path))
    return of_lines(lines, contract), [Finding(rule, contract.dataset, severity, column) for rule, column, severity in drift(contract, first_keys(lines) or contract.names, policy)]


def first_keys(lines: DataFrame) -> list[str] | None:
    row = lines.where(jsonl_rules(F.col("value")).isNull()).orderBy("file", "line").select(F.json_object_keys("value").alias("k")).first()
    return list(row[0]) if row else None


def of_lines(lines: DataFrame, contract: Contract) -> DataFrame:
    """Typed rows of numbered JSON lines; those that are no records have their rule and null fields."""
    rows = lines.withColumn("_broken", jsonl_rules(F.col("value"))).select("file", "line", "_broken", *(F.get_json_object("value", f"$.{n}").alias(n) for n in contract.names))
    rows = typed(rows, contract)
    return rows.withColumn("rules", F.when(F.col("_broken").isNotNull(), F.array("_broken")).otherwise(F.col("rules"))).drop("_broken")


def _typed(rows: DataFrame, contract: Contract, names: list[str]) -> DataFrame:
    for n in contract.names:
        if n not in names:
            rows = rows.withColumn(n, F.lit(None).cast("string"))
    return typed(rows.select("file", "line", *contract.names), contract)


def read(spark: SparkSession, path: str, contract: Contract, policy: str = "strict") -> tuple[DataFrame | None, list[Finding]]:
    """By the contract's format."""
    readers = {"csv": read_csv, "jsonl": read_jsonl}
    if contract.format not in readers:
        raise ValueError(f"{contract.dataset}: no format {contract.format}")
    return readers[contract.format](spark, path, contract, policy)


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes and sha256 of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str) -> dict | None:
    """A JSON document, None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return json.loads(row[0]) if row else None


def gate(found: dict | None, contracts: dict[str, Contract], strict: bool = True) -> list[Finding]:
    """What a source manifest says against the contracts: other versions are an error; without a manifest nothing is said."""
    versions = (found or {}).get("contract_versions", {})
    return [Finding("CONTRACT_VERSION_MISMATCH", d, "critical" if strict else "warning", versions[d]) for d, c in contracts.items() if versions.get(d, c.version) != c.version]


def reconciled(found: dict | None, dataset: str, sha256: str, rows: int, strict: bool = True) -> list[Finding]:
    """What a manifest's entry of a dataset says against its file: missing, another checksum, another number of rows."""
    if found is None:
        return []
    entry = {x["dataset"]: x for x in found.get("files", [])}.get(dataset)
    if entry is None:
        return [Finding("MANIFEST_DATASET_MISSING", dataset, "error")]
    out = [Finding("MANIFEST_CHECKSUM_MISMATCH", dataset, "critical" if strict else "warning", sha256)] if entry.get("sha256", sha256) != sha256 else []
    return out + ([Finding("MANIFEST_ROW_COUNT_MISMATCH", dataset, "error", str(rows))] if entry.get("row_count", rows) != rows else [])


def moved(records: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """Records with what rules across tables found joined back: the first rule quarantines a record, every one counts.

    ``failures`` has the keys, rule and its number in the order of rules; records that are quarantined already stay so.
    """
    first = failures.groupBy(*keys).agg(F.min(F.struct("number", "rule")).alias("_f"), F.count("*").alias("cross_failures"))
    rows = records.join(first, keys, "left")
    rules = F.when((F.size("rules") == 0) & F.col("_f").isNotNull(), F.array("_f.rule")).otherwise(F.col("rules"))
    return rows.withColumn("rules", rules).withColumn("cross_failures", F.coalesce("cross_failures", F.lit(0))).drop("_f")


def accepted_copies(rows: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """Classified rows after the duplicate policy: second and later copies under reject are quarantined, what is discarded goes."""
    good = quality.deduplicated(rows.where(F.size("rules") == 0), keys, ["file", "line"], POLICIES[policy])
    good = good.where("outcome <> 'discarded'").withColumn("rules", F.when(F.col("outcome") == "quarantined", F.array(F.lit("DUPLICATE_PRIMARY_KEY"))).otherwise(F.col("rules"))).drop("outcome")
    return good.unionByName(rows.where(F.size("rules") > 0))


def canonical(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as compact JSON with sorted keys, nulls included."""
    return rows.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("value"))


def as_text(rows: DataFrame, dialect: str = "plain") -> DataFrame:
    """Columns as report files hold them: null empty, booleans lower case; dialect sorted orders columns by name, rounded cuts numbers to five places."""
    columns = sorted(rows.columns) if dialect == "sorted" else rows.columns
    kinds = dict(rows.dtypes)

    def text(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return (F.bround(F.col(c), 5) if dialect == "rounded" else F.col(c)).cast("string")
        return F.array_join(F.col(c).cast("array<string>"), "|") if kinds[c].startswith("array") else F.col(c).cast("string")

    return rows.select(*(F.coalesce(text(c), F.lit("")).alias(c) for c in columns))


def guarded(spark: SparkSession, folder: str, overwrite: bool) -> str:
    """The writers' mode for a folder: without ``overwrite`` an existing one is an error."""
    return "overwrite" if overwrite else "errorifexists"


def write_table(rows: DataFrame, path: str, dialect: str = "plain", overwrite: bool = False) -> None:
    as_text(rows, dialect).write.mode(guarded(rows.sparkSession, path, overwrite)).option("header", True).option("emptyValue", "").csv(path)


def write_document(spark: SparkSession, document: dict | str, path: str, overwrite: bool = False) -> None:
    """A JSON object with sorted keys, or a text, as one file."""
    text = document if isinstance(document, str) else json.dumps(document, sort_keys=True, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(guarded(spark, path, overwrite)).text(path)


def markdown(title: str, rows: list[dict]) -> str:
    """A heading and a table of all columns that occur."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = lambda xs: "| " + " | ".join(str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([f"# {title}", "", cells(names), cells(["-"] * len(names)), *(cells([r.get(n, "") for n in names]) for r in rows), ""])


def run_id(prefix: str, config: dict) -> str:
    """A name that follows from the configuration alone."""
    import hashlib

    return prefix + hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Settings:
    schema_policy: str = "strict"
    duplicates: str = "reject"
    max_quarantine_rate: float = 0.0
    overwrite: bool = False


def ingest(spark: SparkSession, source: str, target: str, contracts: dict[str, Contract], settings: Settings = Settings()) -> dict:
    """All datasets of a folder into accepted and quarantined tables, with manifest and quality report; returns the manifest.

    Rules within records come first, then foreign keys against what those accepted, once and without cascade,
    then duplicates and thresholds. Only counts reach the driver.
    """
    kept, findings, counts = {}, gate(manifest(spark, f"{source}/manifest.json"), contracts), {}
    stated = manifest(spark, f"{source}/manifest.json")
    for name, contract in contracts.items():
        path = f"{source}/{name}.{contract.format}"
        rows, said = read(spark, path, contract, settings.schema_policy)
        findings += said
        if rows is None or any(f.severity == "error" for f in said):
            continue
        kept[name] = rows
        (file,) = checksums(spark, [path]).collect()
        findings += reconciled(stated, name, file.sha256, rows.count())
    for name, rows in kept.items():
        contract, failures = contracts[name], None
        for number, (column, (parent, key)) in enumerate(contract.foreign_keys.items()):
            if parent in kept:
                bad = quality.orphans(rows.where(F.size("rules") == 0), kept[parent].where(F.size("rules") == 0).select(F.col(key).alias(column)), column).select("file", "line", F.lit(f"FK_{column.upper()}").alias("rule"), F.lit(number).alias("number"))
                failures = bad if failures is None else failures.unionByName(bad)
        joined = moved(rows, failures, ["file", "line"]) if failures is not None else rows.withColumn("cross_failures", F.lit(0).cast("long"))
        out = accepted_copies(joined, list(contract.key), settings.duplicates)
        mode = guarded(spark, target, settings.overwrite)
        canonical(out.where(F.size("rules") == 0), contract.names).write.mode(mode).text(f"{target}/accepted/{name}")
        out.where(F.size("rules") > 0).write.mode(mode).parquet(f"{target}/quarantine/{name}")
        good, bad = spark.read.text(f"{target}/accepted/{name}").count(), spark.read.parquet(f"{target}/quarantine/{name}")
        n, cross = bad.agg(F.count("*"), F.coalesce(F.sum("cross_failures"), F.lit(0))).first()
        counts[name] = {"source": rows.count(), "accepted": good, "quarantined": n, "cross_failures": cross, "rate": round(n / (good + n), 6) if good + n else 0.0}
    critical = any(f.severity in ("critical", "error") for f in findings)
    over = any(c["rate"] > settings.max_quarantine_rate for c in counts.values())
    status = "failed" if critical or over else "passed_with_warnings" if findings or any(c["quarantined"] for c in counts.values()) else "passed"
    config = {"source": source, "contracts": {n: c.version for n, c in contracts.items()}, "schema_policy": settings.schema_policy, "duplicates": settings.duplicates}
    out = {"run_id": run_id("ing_", config), "pipeline_status": status, "contract_versions": config["contracts"], "datasets": counts, "findings": [f.__dict__ for f in findings], "lineage": {n: f"{source}/{n}.{c.format}" for n, c in contracts.items()}}
    write_document(spark, out, f"{target}/ingestion-manifest.json", settings.overwrite)
    write_document(spark, markdown("Data quality", [{"dataset": n, **c} for n, c in counts.items()]), f"{target}/quality-report.md", settings.overwrite)
    return out
