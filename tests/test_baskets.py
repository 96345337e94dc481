"""Recommendations from rows a user, against lists made by hand, and how often the interactions are computed for them."""

import datetime as dt
import random

import pytest

from tidemark.operators import recommend as op
from tidemark.plans import recommend as plan

KINDS = "user_id int, item string, ts timestamp_ntz, weight double"
USERS, ITEMS, SUPPORT, K = 60, 7, 10, plan.K
BEFORE, AFTER = dt.datetime(1999, 6, 1), dt.datetime(2000, 2, 1)


@pytest.fixture(scope="module")
def sold(spark):
    rng = random.Random(5)
    rows = [(u, f"i{i}", BEFORE if rng.random() < 0.8 else AFTER, float(rng.randint(1, 9))) for u in range(USERS) for i in range(ITEMS) if rng.random() < 0.45 for _ in range(rng.randint(1, 2))]
    return spark.createDataFrame([*rows, (99, "i1", AFTER, 1.0)], KINDS).persist()  # a user without a history


@pytest.fixture()
def calls(spark, sold, monkeypatch):
    made = []
    monkeypatch.setattr(plan, "SUPPORT", SUPPORT)
    monkeypatch.setattr(plan, "lines", lambda *_: made.append(1) or sold)
    monkeypatch.setattr(plan, "items", lambda *_: sold.select("item").distinct())
    monkeypatch.setattr(plan, "segments", lambda *_: spark.createDataFrame([(u, "ab"[u % 2]) for u in range(0, 100, 3)], "user_id int, segment string"))
    return made


def by_hand(sold):
    """(user, item, score, source) of each list, by loops over users and items."""
    own = {}
    for r in sold.collect():
        if r.ts == BEFORE:
            mine = own.setdefault(r.user_id, {})
            mine[r.item] = mine.get(r.item, 0.0) + r.weight
    items = sorted({i for mine in own.values() for i in mine})
    norm = {i: sum(mine.get(i, 0.0) ** 2 for mine in own.values()) ** 0.5 for i in items}
    both = {(a, b): [m for m in own.values() if a in m and b in m] for a in items for b in items if a != b}
    alike = {(a, b): round(sum(m[a] * m[b] for m in ms) / (norm[a] * norm[b]), 6) for (a, b), ms in both.items() if len(ms) >= SUPPORT}
    total = sum(sum(m.values()) for m in own.values())
    share = {i: round(sum(m.get(i, 0.0) for m in own.values()) / total, 6) for i in items}
    out = set()
    for u, mine in own.items():
        found = []
        for i in set(items) - set(mine):
            reach = max((alike.get((i, o), 0.0) * w for o, w in mine.items()), default=0.0)
            found.append((u, i, round(reach, 6), "item_item") if reach > 0 else (u, i, round(share[i] * 0.01, 6), "catalogue_fallback"))
        out |= set(sorted(found, key=lambda r: (-r[2], r[1]))[:K])
    return out


@pytest.mark.parametrize("most", [100_000, 0])
def test_item_item_lists_by_hand_from_one_pass_over_the_lines(spark, sold, calls, monkeypatch, most):
    monkeypatch.setattr(op, "MAX_PAIRS", most, raising=False)
    got = {(r.user_id, r["item"], r.score, r.source) for r in plan.by_similarity(spark, "").collect()}
    assert got == by_hand(sold) and {s for *_, s in got} == {"item_item", "catalogue_fallback"}
    assert len(calls) == 1, f"the lines were joined and grouped {len(calls)} times"


def test_lists_of_interactions_are_those_of_baskets(spark, sold, calls):
    have = plan.found(spark, "")
    flat = op.top(op.by_similarity(have, have, plan.pairs(spark, ""), plan.popular(spark, ""), K), K)
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, plan.by_similarity(spark, "").collect()))


def test_comparison_reads_the_lines_once_and_measures_each_list_as_the_operators_on_rows_do(spark, sold, calls):
    got = {r.model: r.asDict() for r in plan.QUERIES["recommendation_comparison"][0](spark, "").collect()}
    assert len(calls) == 1, f"the lines were joined and grouped {len(calls)} times"
    share, items = plan.popular(spark, ""), plan.items(spark, "")
    lists = {"global_popularity": plan.by_score(spark, ""), "recent_popularity": plan.ranked(spark, ""), "segment_popularity": plan.by_segment(spark, ""), "item_item_cf": plan.by_similarity(spark, "")}
    for model, ranked in lists.items():
        want = op.averages(op.list_measures(ranked, plan.held_out(spark, ""), K)).first().asDict()
        want |= {"coverage": op.coverage(ranked, items, K).first().coverage, "novelty": op.novelty(ranked, share, K).first().novelty}
        assert {c: got[model][c] for c in want} == pytest.approx(want, abs=2e-6), model
    assert got["segment_popularity"]["fallback_rate"] > 0 and got["item_item_cf"]["fallback_rate"] > 0 and got["global_popularity"]["fallback_rate"] == 0


def test_measures_without_a_list_or_wanted_items_are_null(spark):
    rows = spark.createDataFrame([(1, ["a"], []), (2, [], [("a", 1.0, "s")]), (3, ["a", "z"], [("b", 2.0, "s"), ("a", 1.0, "s")])], "user_id int, wanted array<string>, list array<struct<item string, score double, source string>>")
    got = {r.user_id: tuple(r[m] for m in op.MEASURES) for r in op.measured(rows, 5).collect()}
    assert got[1] == got[2] == (None,) * 6 and got[3] == (0.5, 0.5, 1.0, 0.5, 0.25, 0.386853)
    empty = op.compared({"m": rows.where("user_id = 1")}, spark.createDataFrame([("a",)], "item string"), spark.createDataFrame([("a", 1.0)], "item string, share double"), 5).first()
    assert (empty.users, empty.precision, empty.coverage, empty.novelty, empty.fallback_rate) == (0, None, 0.0, None, 0.0)


def test_model_choice_reads_the_lines_once(spark, calls):
    got = {r.model: r.selected for r in plan.QUERIES["recommendation_model_choice"][0](spark, "").collect()}
    assert len(got) == 4 and sum(got.values()) == 1 and len(calls) == 1


@pytest.mark.parametrize("query", ["report_grounded_insights", "report_governance_damaged"])
def test_reports_join_orders_and_lines_once(spark, monkeypatch, query):
    from tidemark import plans

    made, joined = [], plan.lines
    monkeypatch.setattr(plan, "lines", lambda *a: made.append(1) or joined(*a))
    plans.queries()[query](spark, "/root/testdata/sf0.001")
    assert len(made) == 1, f"the lines were joined and grouped {len(made)} times"
