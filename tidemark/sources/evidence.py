"""Stored result sets as evidence for reports: required artifacts checked at once, read back with the types they were written from."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import published


@dataclass(frozen=True)
class Evidence:
    """Artifacts by id (domain/name); what an artifact is not, an accessor refuses with a TypeError."""

    spark: SparkSession
    root: str
    manifests: dict[str, dict]

    def _said(self, artifact: str, formats: tuple[str, ...], kind: str) -> dict:
        domain, _, name = artifact.partition("/")
        said = self.manifests[domain]["outputs"][name]
        if said["format"] not in formats:
            raise TypeError(f"{artifact} is {said['format']}, no {kind}")
        return said

    def table(self, artifact: str) -> DataFrame:
        """A table with its types; a header or a value that doesn't fit them fails the job that reads it."""
        said = self._said(artifact, ("csv", "jsonl"), "table")
        path = f"{self.root}/{artifact}"
        if said["format"] == "jsonl":
            return self.spark.read.schema(", ".join(f"`{c}` {t}" for c, t in said["columns"])).option("mode", "FAILFAST").json(path)
        names = ", ".join(f"`{c}` string" for c, _ in said["columns"])
        rows = self.spark.read.schema(names).option("header", True).option("enforceSchema", False).option("escape", '"').option("mode", "FAILFAST").option("multiLine", True).csv(path)
        return rows.select(*(_back(F.col(f"`{c}`"), t).alias(c) for c, t in said["columns"]))

    def document(self, artifact: str) -> dict | list:
        self._said(artifact, ("json",), "JSON document")
        return json.loads(self._text(artifact))

    def text(self, artifact: str) -> str:
        self._said(artifact, ("md",), "text")
        return self._text(artifact)

    def _text(self, artifact: str) -> str:
        return self.spark.read.text(f"{self.root}/{artifact}", wholetext=True).first()[0]

    def inventory(self) -> list[dict]:
        """Every artifact with its domain, rows and digest."""
        return [{"artifact_id": f"{d}/{n}", "domain": d, "rows": o.get("rows"), "digest": o["digest"]} for d, m in sorted(self.manifests.items()) for n, o in sorted(m["outputs"].items())]


def _back(text: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, r"\|")).cast(kind)
    return text.cast(kind)


def load(spark: SparkSession, root: str, required: dict[str, tuple[str, ...]]) -> Evidence:
    """Result sets of domains below a folder. All that is missing is named in one error; a run that isn't finished is one too."""
    found, missing = {}, []
    for domain, names in required.items():
        said = published.manifest(spark, f"{root}/{domain}")
        if said is None:
            missing.append(domain)
            continue
        if said["status"] != "passed":
            raise ValueError(f"{domain}: status {said['status']}")
        missing += [f"{domain}/{n}" for n in names if n not in said["outputs"]]
        found[domain] = said
    if missing:
        raise FileNotFoundError(f"missing evidence: {', '.join(missing)}")
    return Evidence(spark, root, found)
