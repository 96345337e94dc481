"""Result sets in a folder: tables in a total order, documents, a checksum of every part, and a manifest written last.

Tables keep many parts. Nothing but totals per output reaches the driver; the list of parts is a table too.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint
from . import ingestion

FORMATS = ("csv", "jsonl", "json", "md")
#: Rows of a part, which keeps each part far below the two gigabytes that one value may hold.
PART_ROWS = 1_000_000
LISTING, MANIFEST = "checksums", "manifest"


@dataclass(frozen=True)
class Output:
    """A table with the columns that order it, or a document (a dict, a list or Markdown)."""

    rows: DataFrame | dict | list | str
    order: tuple[str, ...] = ()
    format: str = "csv"
    dialect: str = "plain"

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"no format {self.format}")


def in_order(rows: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows in one total order: keys (nulls first), then all other columns as JSON, so that ties have an order and a hot key is split over tasks."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    return rows.orderBy(*(F.col(k).asc_nulls_first() for k in keys), *([F.to_json(F.struct(*rest)).asc()] if rest else []))


def record_order(rows: DataFrame, user: str, times: list[str], key: str) -> DataFrame:
    """Records of mixed kinds by user, first time that is not null, id and fingerprint; what a record lacks counts as an empty text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.orderBy(text(user), F.coalesce(*(F.col(t).cast("string") for t in times), F.lit("")), text(key), fingerprint(*rows.columns))


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds any file, at any depth."""
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").isEmpty()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """output, part, bytes and sha256 of the parts of all outputs of a folder; hashed in tasks. Parts without a byte are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    named = files.select(F.regexp_extract("path", r"/([^/]+)/part-[^/]+$", 1).alias("output"), F.regexp_extract("path", r"/(part-[^/]+)$", 1).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return named.where(~F.col("output").isin(LISTING, MANIFEST))


def digest() -> Column:
    """One value of all parts of a group, whatever their order: the sum of 60 bits of each name with its checksum."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", "part", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.sum(bits).cast("string")


def totals(parts: DataFrame) -> dict[str, dict]:
    rows = parts.groupBy("output").agg(F.count("*").alias("parts"), F.sum("bytes").alias("bytes"), digest().alias("digest")).collect()  # a row per output
    return {r.output: {"parts": r.parts, "bytes": r.bytes, "digest": r.digest} for r in rows}


def write(spark: SparkSession, out: Output, path: str, overwrite: bool) -> dict:
    """Writes one output; returns its format, and of a table the rows and the types that ``evidence`` reads it with."""
    said: dict = {"format": out.format}
    if not isinstance(out.rows, DataFrame):
        ingestion.write_document(spark, out.rows if isinstance(out.rows, str) else json.dumps(out.rows, sort_keys=True, default=str), path, overwrite)
        return said
    seen = Observation()
    rows = in_order(out.rows, out.order).observe(seen, F.count(F.lit(1)).alias("rows"))
    target = (ingestion.as_text(rows, out.dialect) if out.format == "csv" else rows).write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", PART_ROWS)
    if out.format == "csv":
        target.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
        columns = sorted(out.rows.columns) if out.dialect == "sorted" else out.rows.columns
    else:
        target.option("ignoreNullFields", False).json(path)
        columns = out.rows.columns
    kinds = dict(out.rows.dtypes)
    return said | {"rows": seen.get["rows"], "order": list(out.order), "columns": [[c, kinds[c]] for c in columns]}


def publish(spark: SparkSession, folder: str, verb: str, config: dict, outputs: dict[str, Output], inputs: dict[str, int] | None = None, overwrite: bool = False, at: str | None = None, run_id: str | None = None) -> dict:
    """Writes all outputs, their checksums and, as the last file, the manifest; returns the manifest.

    A folder that holds files is an error unless ``overwrite`` is set. While the work lasts the manifest says
    "unfinished", so that readers never take half a run. ``at`` is stated as the time of the run; without it
    nothing in the folder depends on the clock.
    """
    if bad := {LISTING, MANIFEST} & set(outputs):
        raise ValueError(f"reserved names: {sorted(bad)}")
    if exists(spark, folder) and not overwrite:
        raise FileExistsError(f"{folder} holds files; pass overwrite")
    marks = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    head = {"verb": verb, "run_id": run_id or f"{verb.split('-')[-1]}_{marks[:16]}", "config": config, "config_fingerprint": marks, "inputs": inputs or {}, "run_time": at}
    ingestion.write_document(spark, head | {"status": "unfinished"}, f"{folder}/{MANIFEST}", overwrite)
    written = {name: write(spark, out, f"{folder}/{name}", overwrite) for name, out in outputs.items()}
    parts = listing(spark, folder).where(F.col("output").isin(*outputs)).cache()
    few = parts.repartitionByRange(1 + parts.count() // PART_ROWS, "output", "part").sortWithinPartitions("output", "part")
    few.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(f"{folder}/{LISTING}")
    parts.unpersist()
    sums = totals(stored(spark, folder))
    found = head | {"status": "passed", "outputs": {n: said | sums.get(n, {"parts": 0, "bytes": 0, "digest": None}) for n, said in written.items()}, "lineage": {n: sorted(inputs or {}) for n in outputs}}
    ingestion.write_document(spark, found, f"{folder}/{MANIFEST}", True)
    return found


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("output string, part string, bytes long, sha256 string").option("header", True).csv(f"{folder}/{LISTING}")


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a result set, None where there is none."""
    try:
        lines = spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).collect()  # one document
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return json.loads(lines[0][0])


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(output, part, problem) of a result set: parts changed, missing or not listed, and outputs whose listing is not the manifest's. No rows mean that all is as written."""
    said = manifest(spark, folder)
    if said is None or said["status"] != "passed":
        raise ValueError(f"{folder}: no finished run")
    old, new = stored(spark, folder), listing(spark, folder).select("output", "part", F.col("sha256").alias("now"))
    both = old.join(new, ["output", "part"], "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("now") != F.col("sha256"), "changed")
    rows = both.select("output", "part", problem.alias("problem")).where("problem IS NOT NULL")
    stated = spark.createDataFrame([(n, o["digest"]) for n, o in said["outputs"].items()], "output string, stated string")
    lists = old.groupBy("output").agg(digest().alias("digest")).join(F.broadcast(stated), "output", "full_outer")
    return rows.unionByName(lists.where(~F.col("digest").eqNullSafe(F.col("stated"))).select("output", F.lit("").alias("part"), F.lit("listing").alias("problem")))
