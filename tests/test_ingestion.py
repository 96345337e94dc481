"""Ingestion end to end, sinks and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.sources import ingestion as ing
from tidemark.sources.contracts import Contract, Field

USERS = Contract("users", (Field("user_id", prefix="u"), Field("age", "integer", nullable=True, low=0)), ("user_id",))
EVENTS = Contract("events", (Field("event_id"), Field("user_id"), Field("ok", "boolean", nullable=True)), ("event_id",), "jsonl", foreign_keys={"user_id": ("users", "user_id")})


@pytest.fixture
def source(tmp_path):
    (tmp_path / "users.csv").write_text('user_id,age\nu1,3\n"u2",\nx3,4\nu4,-1\nu5,7\nu5,8\n')
    (tmp_path / "events.jsonl").write_text('{"event_id":"a","user_id":"u1","ok":true}\n\n{bad\n[1]\n{"event_id":"b","user_id":"u9"}\n{"event_id":"c","user_id":"x3","ok":"maybe"}\n{"event_id":"d","user_id":"u5"}\n')
    return tmp_path


def test_ingest(spark, source, tmp_path):
    out = ing.ingest(spark, str(source), str(tmp_path / "out"), {"users": USERS, "events": EVENTS}, ing.Settings(max_quarantine_rate=0.9))
    assert out["datasets"]["users"] == {"source": 6, "accepted": 2, "quarantined": 3, "cross_failures": 0, "rate": 0.6}  # one of the two copies is silently gone
    assert out["datasets"]["events"] == {"source": 7, "accepted": 2, "quarantined": 5, "cross_failures": 1, "rate": 0.714286}
    assert out["pipeline_status"] == "passed_with_warnings" and out["findings"] == []
    accepted = sorted(r.value for r in spark.read.text(str(tmp_path / "out/accepted/users")).collect())
    assert accepted == ['{"age":3,"user_id":"u1"}', '{"age":null,"user_id":"u2"}']
    bad = {(r.line, *r.rules) for r in spark.read.parquet(str(tmp_path / "out/quarantine/events")).collect()}
    assert bad == {(2, "JSONL_BLANK_LINE"), (3, "JSONL_MALFORMED"), (4, "JSONL_NON_OBJECT"), (5, "FK_USER_ID"), (6, "FIELD_TYPE_INVALID:ok")}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        ing.ingest(spark, str(source), str(tmp_path / "out"), {"users": USERS})
    stored = "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "out/ingestion-manifest.json")).coalesce(1).collect())
    assert json.loads(stored)["run_id"] == out["run_id"]


def test_duplicate_policies(spark, source):
    rows, _ = ing.read(spark, str(source / "users.csv"), USERS)
    kept = lambda p: sorted((r.line, r.age) for r in ing.accepted_copies(rows, ["user_id"], p).where(F.size("rules") == 0).where("user_id = 'u5'").collect())
    assert kept("keep-first") == [(6, 7)] and kept("keep-last") == [(7, 8)] and kept("reject") == []


def test_fatal_files_and_drift(spark, tmp_path):
    (tmp_path / "users.csv").write_text("")
    assert ing.read(spark, str(tmp_path / "users.csv"), USERS) == (None, [ing.Finding("FILE_EMPTY", "users", "critical")])
    (tmp_path / "two.csv").write_text("user_id,user_id\nu1,u2\n")
    assert ing.read(spark, str(tmp_path / "two.csv"), USERS)[1][0].rule == "CSV_DUPLICATE_HEADER"
    (tmp_path / "more.csv").write_text("user_id,extra\nu1,2\n")
    rows, found = ing.read(spark, str(tmp_path / "more.csv"), USERS)
    assert {(f.rule, f.detail) for f in found} == {("MISSING_REQUIRED", "age"), ("UNEXPECTED_COLUMN", "extra")} and rows.first().line == 2


def test_manifest_rules(spark, tmp_path):
    assert ing.manifest(spark, str(tmp_path / "none.json")) is None and ing.reconciled(None, "users", "x", 1) == []
    found = {"contract_versions": {"users": "2.0"}, "files": [{"dataset": "users", "sha256": "a", "row_count": 5}]}
    assert [f.rule for f in ing.gate(found, {"users": USERS, "events": EVENTS})] == ["CONTRACT_VERSION_MISMATCH"]
    assert [(f.rule, f.severity) for f in ing.reconciled(found, "users", "b", 4, strict=False)] == [("MANIFEST_CHECKSUM_MISMATCH", "warning"), ("MANIFEST_ROW_COUNT_MISMATCH", "error")]
    assert [f.rule for f in ing.reconciled(found, "events", "b", 4)] == ["MANIFEST_DATASET_MISSING"]


def test_checksums_and_sinks(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("abc")
    assert ing.checksums(spark, [str(tmp_path / "a.txt")]).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    rows = spark.createDataFrame([(True, None, 1.23456789, ["x", "y"])], "b boolean, a string, d double, l array<string>")
    assert ing.as_text(rows).first().asDict() == {"b": "true", "a": "", "d": "1.23456789", "l": "x|y"}
    assert ing.as_text(rows, "sorted").columns == ["a", "b", "d", "l"] and ing.as_text(rows, "rounded").first().d == "1.23457"
    assert ing.markdown("T", [{"a": 1}, {"b": "x|y"}]) == "# T\n\n| a | b |\n| - | - |\n| 1 |  |\n|  | x\\|y |\n"
    assert ing.rule_result("FK_USER_ID", "events", 2) | {} == {"rule_id": "FK_USER_ID", "name": "Fk User Id", "category": "referential", "dataset": "events", "severity": "error", "failures": 2, "status": "failed"}
    assert spark.range(1).select(ing.safe_value(F.lit("q" * 300))).first()[0] == '"' + "q" * 199


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["project-info"]) == 0 and "dq_rule_counts with SQL" in capsys.readouterr().out
    assert cli.main(["run", "dq_rule_counts", "/root/testdata/sf0.001", str(tmp_path / "o")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "o/dq_rule_counts")).columns == ["rule_id", "failures"]
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "a", "b"])
    with pytest.raises(ValueError):
        cli.environment("moon")
