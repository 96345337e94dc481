"""Command line: ingestion, the result set of every domain, insights and the reporting layer, and single queries over a folder of tables."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from . import plans
from .operators import insights as insight_op
from .plans import domains
from .sources import contracts, ingestion, published


def environment(name: str | None) -> str:
    """A known environment name in lower case."""
    found = (name or "local").strip().lower()
    if found not in ("local", "test", "development", "production"):
        raise ValueError(f"unknown environment {name}")
    return found


def listed(text: str) -> list[str]:
    """Names of a comma-separated list, each once."""
    return list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))


def _common(verb: argparse.ArgumentParser) -> None:
    verb.add_argument("--run-id")
    verb.add_argument("--fixed-run-time", help="stated in the manifest as the time of the run")
    verb.add_argument("--overwrite", action="store_true")


def parser() -> argparse.ArgumentParser:
    """Verbs and their options; those of the domains follow from their declarations."""
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)
    verbs.add_parser("project-info", help="names of all queries and whether SQL states them too")
    run = verbs.add_parser("run", help="queries over a folder of Parquet tables, each written as a folder of CSV")
    run.add_argument("queries", type=listed)
    run.add_argument("tables")
    run.add_argument("target")
    run.add_argument("--dialect", choices=("plain", "sorted", "rounded"), default="plain")
    run.add_argument("--overwrite", action="store_true")
    for name in ("ingest-batch", "ingest-stream"):
        verb = verbs.add_parser(name, help="files of a folder into accepted and quarantined records by contract")
        verb.add_argument("source")
        verb.add_argument("target")
        verb.add_argument("--contracts", required=True, help="JSON file with a list of contracts")
        verb.add_argument("--schema-policy", choices=("strict", "compatible", "report-only"), default="strict")
        verb.add_argument("--max-quarantine-rate", type=float, default=0.0 if name == "ingest-batch" else 1.0)
        verb.add_argument("--overwrite", action="store_true")
        if name == "ingest-batch":
            verb.add_argument("--duplicate-policy", choices=tuple(ingestion.POLICIES), default="reject")
        else:
            verb.add_argument("--dataset", required=True)
            verb.add_argument("--files-per-batch", type=int, default=1)
    for d in domains.DOMAINS.values():
        verb = verbs.add_parser(d.verb, help=d.about)
        verb.add_argument("tables")
        verb.add_argument("target")
        verb.add_argument("--only", type=listed, help=f"some of {', '.join(d.tables)}")
        for option, choice in d.choices.items():
            verb.add_argument(f"--{option}", action="append", default=[], choices=choice.known)
        _common(verb)
    verb = verbs.add_parser("generate-product-insights", help="insights from stored result sets of all domains")
    verb.add_argument("root")
    verb.add_argument("target")
    verb.add_argument("--provider", choices=tuple(insight_op.PROVIDERS), default="deterministic_template")
    _common(verb)
    verb = verbs.add_parser("build-reporting-layer", help="facts, dimensions, metrics and the semantic model")
    verb.add_argument("tables")
    verb.add_argument("target")
    verb.add_argument("--include-domain", action="append", default=[])
    _common(verb)
    verb = verbs.add_parser("verify", help="compare a result set with its checksums")
    verb.add_argument("folder")
    return out


def _run(spark: SparkSession, given: argparse.Namespace) -> int:
    known = plans.queries()
    rows = []
    for name in given.queries:
        ingestion.write_table(known[name](spark, given.tables), f"{given.target}/{name}", given.dialect, given.overwrite)
        rows.append({"query": name, "rows": spark.read.option("header", True).csv(f"{given.target}/{name}").count()})
    lineage = {"run_id": ingestion.run_id("run_", {"queries": given.queries, "tables": given.tables}), "source": given.tables, "outputs": rows}
    ingestion.write_document(spark, lineage, f"{given.target}/manifest.json", given.overwrite)
    ingestion.write_document(spark, ingestion.markdown("Results", rows), f"{given.target}/report.md", given.overwrite)
    return 0


def _ingest(spark: SparkSession, given: argparse.Namespace) -> int:
    """0 where the run passed, with warnings or without; 1 where it failed."""
    known = contracts.loaded(spark.read.text(given.contracts, wholetext=True).first()[0])
    if given.verb == "ingest-batch":
        said = ingestion.ingest(spark, given.source, given.target, known, ingestion.Settings(given.schema_policy, given.duplicate_policy, given.max_quarantine_rate, given.overwrite))
    else:
        from .streaming import ingest as stream

        if given.dataset not in known:
            raise ValueError(f"unknown dataset {given.dataset}")
        said = stream.run(spark, given.source, given.target, known[given.dataset], given.schema_policy, given.max_quarantine_rate, given.files_per_batch, given.overwrite)
    print(json.dumps(said, sort_keys=True))
    return int(said["pipeline_status"] == "failed")


def main(args: list[str] | None = None) -> int:
    out = parser()
    given = out.parse_args(args)
    known, stated = plans.queries(), plans.oracle_sql()
    if given.verb == "project-info":
        print(f"environment {environment(os.environ.get('APP_ENVIRONMENT'))}")
        for name in known:
            print(name, "with SQL" if name in stated else "without SQL")
        return 0
    if given.verb == "run" and (bad := [q for q in given.queries if q not in known]):
        out.error(f"unknown queries: {', '.join(bad)}")
    spark = SparkSession.builder.getOrCreate()
    if given.verb == "run":
        return _run(spark, given)
    if given.verb.startswith("ingest-"):
        return _ingest(spark, given)
    if given.verb == "verify":
        wrong = published.in_order(published.verify(spark, given.folder), ("output", "part"))
        for r in wrong.limit(100).collect():  # shown, not all of them
            print(r.output, r.part, r.problem)
        return int(not wrong.isEmpty())
    common = {"overwrite": given.overwrite, "at": given.fixed_run_time, "run_id": given.run_id}
    if given.verb == "generate-product-insights":
        said = domains.insights(spark, given.root, given.target, given.provider, **common)
    elif given.verb == "build-reporting-layer":
        said = domains.report(spark, given.tables, given.target, given.include_domain or None, **common)
    else:
        wanted = {c: getattr(given, c) for c in domains.DOMAINS[given.verb].choices if getattr(given, c)}
        said = domains.run(spark, given.verb, given.tables, given.target, wanted, given.only, **common)
    print(said["run_id"], said["status"], f"{len(said['outputs'])} outputs")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
