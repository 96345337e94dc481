"""Result sets, evidence read back from them, insights, streaming manifests and the verbs of the command line."""

import datetime
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import insights as insight_op
from tidemark.operators import reporting as report_op
from tidemark.plans import domains
from tidemark.sources import evidence, published
from tidemark.sources.contracts import loaded
from tidemark.streaming import ingest as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture
def table(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # small data in several parts
    yield made(spark)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def made(spark):
    hot = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(0, 3000, 1, 7).select(hot.alias("k"), (F.hash("id") % 100).alias("n"), F.when(F.col("id") % 7 > 0, F.col("id") / 8).alias("x"), F.array(F.lit("a"), F.lit("b,c")).alias("l"), F.lit('say "no"\nthen, go').alias("t"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("at"))


def test_order_over_parts_and_values_come_back(spark, table, tmp_path):
    folder = str(tmp_path / "set")
    out = {"rows": published.Output(table, ("k",)), "lines": published.Output(table, ("n",), "jsonl"), "note": published.Output("# Hi\n", format="md"), "facts": published.Output({"a": [1]}, format="json")}
    said = published.publish(spark, folder, "make-sets", {"a": 1}, out, {"range": 3000}, at="2026-01-01T00:00:00Z")
    assert said["status"] == "passed" and said["outputs"]["rows"]["rows"] == said["outputs"]["lines"]["rows"] == 3000 and said["inputs"] == {"range": 3000} and said["run_time"] == "2026-01-01T00:00:00Z"
    assert said["outputs"]["lines"]["parts"] > 1 and published.verify(spark, folder).isEmpty()
    keys = [(r["n"],) for part in sorted(glob.glob(f"{folder}/lines/part-*")) for r in map(json.loads, open(part))]
    assert len(keys) == 3000 and keys == sorted(keys)  # files in the order of their names are the total order
    assert len([p for p in glob.glob(f"{folder}/rows/part-*") if '"no' in open(p).read() and "hot" in open(p).read()]) > 1  # the hot key is split
    found = evidence.load(spark, str(tmp_path), {"set": ("rows", "note")})
    for name in ("rows", "lines"):
        back = found.table(f"set/{name}")
        assert back.dtypes == table.dtypes and back.exceptAll(table).isEmpty() and table.exceptAll(back).isEmpty()
    assert found.document("set/facts") == {"a": [1]} and found.text("set/note").startswith("# Hi")
    for wrong in (lambda: found.table("set/note"), lambda: found.document("set/rows"), lambda: found.text("set/facts")):
        with pytest.raises(TypeError):
            wrong()
    again = published.publish(spark, str(tmp_path / "two"), "make-sets", {"a": 1}, {"rows": out["rows"]})
    assert again["config_fingerprint"] == said["config_fingerprint"] and again["run_id"] == said["run_id"]


def test_what_changed_is_found(spark, table, tmp_path):
    folder = str(tmp_path / "set")
    published.publish(spark, folder, "make-sets", {}, {"rows": published.Output(table, ("k",)), "lines": published.Output(table, ("n",), "jsonl"), "none": published.Output(table.limit(0), ("k",)), "empty": published.Output(table.limit(0), ("k",), "jsonl")})
    with pytest.raises(FileExistsError):
        published.publish(spark, folder, "make-sets", {}, {"rows": published.Output(table, ("k",))})
    first, second = sorted(glob.glob(f"{folder}/lines/part-*"))[:2]
    text = open(first).read()
    open(first, "w").write(text.replace("1", "2", 1))
    open(second.replace("part-", "part-9"), "w").write("{}\n")
    open(second, "w").close()
    for crc in glob.glob(f"{folder}/lines/.*.crc"):
        open(crc.replace("lines/.", "lines/ignored."), "w").close()
        os.remove(crc)
    got = {(r.output, r.part.split("-")[1][:1] == "9", r.problem) for r in published.verify(spark, folder).collect()}
    assert got == {("lines", False, "changed"), ("lines", True, "unlisted"), ("lines", False, "missing")}  # a part emptied counts as missing
    listed = glob.glob(f"{folder}/checksums/part-*")[0]
    lines = open(listed).read().splitlines()
    open(listed, "w").write("\n".join(x for x in lines if not x.startswith("none")) + "\n")
    os.remove(f"{folder}/checksums/.{listed.rsplit('/', 1)[1]}.crc")
    assert ("none", "", "listing") in {tuple(r) for r in published.verify(spark, folder).collect()}


def test_evidence_that_is_missing_or_malformed(spark, table, tmp_path):
    published.publish(spark, str(tmp_path / "set"), "make-sets", {}, {"rows": published.Output(table.select("k", "n").limit(5), ("k",))})
    with pytest.raises(FileNotFoundError, match="other, set/absent"):
        evidence.load(spark, str(tmp_path), {"other": ("a",), "set": ("rows", "absent")})
    part = glob.glob(str(tmp_path / "set/rows/part-*"))[0]
    text = open(part).read()
    os.remove(f"{part.rsplit('/', 1)[0]}/.{part.rsplit('/', 1)[1]}.crc")
    for bad in (text.replace("k,n", "n,k", 1), text + "k1,many\n"):
        open(part, "w").write(bad)
        with pytest.raises(Exception, match="CSV header|CAST_INVALID_INPUT"):
            evidence.load(spark, str(tmp_path), {"set": ("rows",)}).table("set/rows").collect()
    with pytest.raises(ValueError):
        published.Output(table, format="xls")


def test_records_of_mixed_kinds(spark):
    at = datetime.datetime
    rows = spark.createDataFrame([("u2", at(2024, 1, 1), None, "b"), ("u1", None, at(2024, 1, 3), "c"), ("u1", at(2024, 1, 2), at(2020, 1, 1), "d"), ("u1", None, None, "z"), (None, None, None, "y")], "user string, a timestamp_ntz, b timestamp_ntz, id string")
    assert [r.id for r in published.record_order(rows, "user", ["a", "b"], "id").collect()] == ["y", "z", "d", "c", "b"]


def _tables(spark):
    rows = lambda schema, *xs: spark.createDataFrame(list(xs), schema)
    return {
        "analyse-funnels/funnel-summary": rows("funnel_id string, completion_rate double", ("buy", 0.5), ("ask", 0.25), ("none", None)), "analyse-retention/cohort-summary": rows("definition_id string, cohort string, return_rate double", ("seen", "W1", 0.5), ("seen", "W2", 0.0), ("seen", "W3", 0.125)),
        "train-churn-model/feature-importance": rows("feature string, importance double", ("b", 0.75), ("a", 0.75), ("c", 0.1)), "train-churn-model/evaluation-metrics": rows("f1 double", (0.6,)), "segment-users/segment-profiles": rows("segment string, metric string, users long", ("x", "m", 3), ("x", "n", 3), ("y", "m", 1)),
        "build-recommendations/model-comparison": rows("model string, ndcg double, recall double, coverage double", ("recent", 0.5, 0.25, 0.9), ("global", 0.25, 0.75, 0.9)), "analyse-experiments/decision-summary": rows("decision string", ("ship",), ("ship",), ("do_not_ship",)), "analyse-experiments/guardrail-results": rows("status string", ("fail",), ("pass",)),
    }


def test_insights_of_all_types(spark):
    tables = _tables(spark)
    rows = insight_op.generated(insight_op.inputs(tables.__getitem__))
    said = {r.insight_type: r for r in rows.collect()}
    assert {k: r.summary for k, r in said.items()} == {
        "funnel": "buy is finished most (0.5000), ask least (0.2500).", "retention": "Half of 3 cohorts return at 0.1250 or more; seen W2 returns least (0.0000).", "churn": "a weighs most (0.7500); the model's F1 is 0.6000.", "segmentation": "x holds 0.7500 of the users.",
        "recommendation": "recent is chosen with NDCG 0.5000 and recall 0.2500.", "experiment": "Decisions: do_not_ship: 1, ship: 2; guardrails failed: 1.", "cross_domain": "The weakest funnel (ask), the strongest churn feature (a) and 1 failed guardrails are one place to look.", "risk_caveat": "Results come from made data and offline analysis; 1 guardrails failed.",
    }
    assert said["churn"].supporting_metrics == ["importance=0.7500", "f1=0.6000"] and len({r.insight_id for r in said.values()}) == 8
    assert report_op.governance(rows, list(tables)).first().status == "passed"
    empty = insight_op.generated(insight_op.inputs(lambda a: tables[a].limit(0))).where("insight_type = 'funnel'").first()
    assert empty.summary == " is finished most (),  least ()."
    other = insight_op.generated(insight_op.inputs(tables.__getitem__), "hosted_placeholder")
    assert {r.generation_mode for r in other.collect()} == {"hosted_placeholder_no_call"} and insight_op.provider("hosted_placeholder").package(["b", "a"])["input_sections"] == ["a", "b"]
    with pytest.raises(ValueError):
        insight_op.provider("oracle")


def test_insights_from_stored_sets(spark, tmp_path):
    sets: dict = {}
    for artifact, rows in _tables(spark).items():
        domain, name = artifact.split("/")
        sets.setdefault(domain, {})[name] = published.Output(rows, (rows.columns[0],))
    for domain, outputs in sets.items():
        published.publish(spark, str(tmp_path / domain), domain, {}, outputs)
    assert cli.main(["generate-product-insights", str(tmp_path), str(tmp_path / "out")]) == 0
    found = evidence.load(spark, str(tmp_path / "out"), {"generate-product-insights": ("grounded-insights", "risk-and-caveat-register", "insight-governance-checks", "product-manager-action-brief")})
    assert found.table("generate-product-insights/grounded-insights").count() == 8
    assert found.document("generate-product-insights/insight-governance-checks")["status"] == "passed"
    assert found.document("generate-product-insights/prompt-package")["llm_call_performed"] is False
    assert cli.main(["verify", str(tmp_path / "out/generate-product-insights")]) == 0


def test_domain_verb(spark, tmp_path, capsys):
    verb = ["analyse-funnels", SF, str(tmp_path), "--funnel", "purchase", "--only", "funnel-summary,funnel-attempts", "--fixed-run-time", "2026-01-01T00:00:00Z"]
    assert cli.main(verb) == 0 and "passed" in capsys.readouterr().out
    said = published.manifest(spark, str(tmp_path / "analyse-funnels"))
    assert sorted(said["outputs"]) == ["definitions", "diagnostics", "executive-report", "funnel-attempts", "funnel-summary"] and said["config"]["choices"] == {"funnel": ["purchase"]} and said["inputs"]["events"] > 0
    found = evidence.load(spark, str(tmp_path), {"analyse-funnels": ("funnel-summary",)})
    assert [r.funnel_id for r in found.table("analyse-funnels/funnel-summary").collect()] == ["purchase"]
    assert "## funnel-summary" in found.text("analyse-funnels/executive-report").splitlines() and len(found.document("analyse-funnels/definitions")) == 4
    with pytest.raises(FileExistsError):
        cli.main(verb)
    for bad in ({"wanted": {"funnel": ["nothing"]}}, {"only": ["nothing"]}):
        with pytest.raises(ValueError, match="unknown"):
            domains.run(spark, "analyse-funnels", SF, str(tmp_path / "x"), **bad)


def test_every_table_of_a_domain_is_a_query_with_its_order(spark):
    known = domains._known()
    for d in domains.DOMAINS.values():
        assert {t.query for t in d.tables.values()} <= set(known) and set(d.report) <= set(d.tables), d.verb
    assert {f"{v}/{a}" for v, names in insight_op.REQUIRED.items() for a in names} <= set(domains._QUERY)


CONTRACTS = '[{"dataset": "events", "format": "jsonl", "key": ["event_id"], "fields": [{"name": "event_id"}, {"name": "kind", "allowed": ["a", "b"]}, {"name": "n", "type": "integer", "nullable": true, "low": 0}]}]'


def test_stream_and_batch_agree(spark, tmp_path, capsys):
    (tmp_path / "files").mkdir()
    (tmp_path / "contracts.json").write_text(CONTRACTS)
    lines = ['{"event_id":"%d","kind":"%s","n":%d}' % (i, "abc"[i % 3], i - 2) for i in range(40)] + ["", "{bad"]
    for i in range(3):
        (tmp_path / f"files/f{i}.jsonl").write_text("\n".join(lines[i * 14 : i * 14 + 14]) + "\n")
    (tmp_path / "events.jsonl").write_text("\n".join(lines) + "\n")
    given = ["--contracts", str(tmp_path / "contracts.json"), "--max-quarantine-rate", "0.9"]
    assert cli.main(["ingest-stream", str(tmp_path / "files"), str(tmp_path / "s"), "--dataset", "events", *given]) == 0
    a = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert cli.main(["ingest-batch", str(tmp_path), str(tmp_path / "b"), *given]) == 0
    b = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert a["datasets"] == b["datasets"] and a["pipeline_status"] == b["pipeline_status"] == "passed_with_warnings" and a["batches"] == 3
    bad = spark.read.parquet(str(tmp_path / "s/quarantine"))
    assert {(r.file[-8:], r.line) for r in bad.where("array_contains(rules, 'JSONL_MALFORMED')").collect()} == {("f2.jsonl", 14)}
    assert bad.count() == a["datasets"]["events"]["quarantined"] and bad.groupBy("file", "line").count().where("count > 1").isEmpty()
    with pytest.raises(FileExistsError):
        cli.main(["ingest-stream", str(tmp_path / "files"), str(tmp_path / "s"), "--dataset", "events", *given])


def test_stream_stops_at_drift(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.jsonl").write_text('{"event_id":"1","kind":"a","n":1,"more":2}\n')
    contract = loaded(CONTRACTS)["events"]
    said = stream.run(spark, str(tmp_path / "f"), str(tmp_path / "o"), contract)
    assert said["pipeline_status"] == "failed" and [(f["rule"], f["detail"]) for f in said["findings"]] == [("UNEXPECTED_COLUMN", "more")] and said["batches"] == 0
    said = stream.run(spark, str(tmp_path / "f"), str(tmp_path / "o"), contract, "report-only", overwrite=True)
    assert said["pipeline_status"] == "passed_with_warnings" and said["datasets"]["events"]["accepted"] == 1
    with pytest.raises(ValueError, match="two contracts"):
        loaded(CONTRACTS[:-1] + "," + CONTRACTS[1:])
