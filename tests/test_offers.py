"""Recommendations over eligible items, held against a version in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import offers
from tidemark.operators import recommend as op

ITEM = "item string, priority double, active boolean, repeatable boolean, plans array<string>, personas array<string>, sizes array<string>, required array<string>, incompatible array<string>"


@pytest.fixture(scope="module")
def shop(spark):
    r = random.Random(8)
    names = [f"i{k:02}" for k in range(30)]
    some = lambda p: [r.choice(names)] if r.random() < p else []
    items = [(n, float(r.randint(1, 9)), r.random() < 0.9, r.random() < 0.3, ["free", "paid"] if r.random() < 0.7 else ["paid"], ["dev"] if r.random() < 0.2 else [], ["small"] if r.random() < 0.2 else [], some(0.2), some(0.2)) for n in names]
    users = [(u, r.choice(["free", "paid"]), r.choice(["dev", "ops"]), r.choice(["small", "large"]), r.choice("xyz")) for u in range(40)]
    found = [(u, n, float(r.randint(1, 5)), r.random() < 0.6) for u in range(30) for n in r.sample(names[:22], r.randint(0, 6))]
    frames = spark.createDataFrame(users, "user_id long, plan string, persona string, size string, segment string"), spark.createDataFrame(items, ITEM), spark.createDataFrame(found, "user_id long, item string, weight double, consumed boolean")
    return users, items, found, *frames


def admitted(user, item, found):
    had, done = {n for u, n, _, _ in found if u == user[0]}, {n for u, n, _, c in found if u == user[0] and c}
    name, _, active, again, plans, personas, sizes, required, incompatible = item
    return active and user[1] in plans and (not personas or user[2] in personas) and (not sizes or user[3] in sizes) and (again or name not in done) and set(required) <= had and not set(incompatible) & had


def ranked(frame):
    return {(r.user_id, r["rank"]): (r.item, round(r.score, 6), r.source) for r in frame.collect()}


def expected(users, items, found, score, k=4):
    out = {}
    for user in users:
        rows = []
        for item in items:
            if admitted(user, item, found):
                value, source = score(user, item[0])
                rows.append((value, item[0], source) if value > 0 else (round(item[1] * 0.01, 6), item[0], "catalogue_fallback"))
        for rank, (value, name, source) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1]))[:k], 1):
            out[user[0], rank] = (name, round(value, 6), source)
    return out


@pytest.mark.parametrize("block", [10_000, 7])
def test_offers_of_one_list_and_of_many(spark, shop, monkeypatch, block):
    """Each model gives the same for a catalogue in one list and in several, and what plain Python gives."""
    monkeypatch.setattr(offers, "MAX_BLOCK", block)
    monkeypatch.setattr(offers, "PARTS", 2)
    users, items, found, people, catalogue, have = shop
    total, own = {}, {}
    segment = {u[0]: u[4] for u in users}
    for u, n, w, _ in found:
        total[n] = total.get(n, 0) + w
        own[segment[u], n] = own.get((segment[u], n), 0) + w
    scores = have.groupBy("item").agg(F.sum("weight").alias("score"))
    people = offers.people(people, have)
    got = ranked(op.top(offers.by_popularity(people, catalogue, scores, 25), 25))  # long lists reach items without score
    assert got == expected(users, items, found, lambda u, n: (total.get(n, 0), "global_popularity"), 25) and any(s == "catalogue_fallback" for *_, s in got.values())

    def by_segment(u, n):
        return (own[u[4], n], "segment_popularity") if (u[4], n) in own else (total.get(n, 0), "segment_global_fallback")

    of_segment = have.join(people.select("user_id", "segment"), "user_id").groupBy("segment", "item").agg(F.sum("weight").alias("score"))
    got = ranked(op.top(offers.by_segment(people, catalogue, of_segment, scores, 4), 4))
    assert got == expected(users, items, found, by_segment) and {s for *_, s in got.values()} >= {"segment_popularity"}

    pairs = op.similarity(have, 2)
    near = {(r.item, r.other): r.similarity for r in pairs.collect()}

    def similar(u, n):
        best = min(((-round(near.get((n, o), 0) * w, 6), o) for x, o, w, _ in found if x == u[0]), default=(0, ""))
        return (-best[0], f"item_similarity:{best[1]}") if best[0] < 0 else (total.get(n, 0) * 0.001, "cf_popularity_fallback")

    small = scores.withColumn("score", F.col("score") * 0.001)  # so that both kinds stand in lists
    got = ranked(op.top(offers.by_similarity(people, catalogue, have, pairs, small, 4), 4))
    assert got == expected(users, items, found, similar) and {s.split(":")[0] for *_, s in got.values()} >= {"item_similarity", "cf_popularity_fallback"}


def test_offers_without_interactions_or_catalogue(spark, shop):
    users, items, _, people, catalogue, have = shop
    nothing = have.limit(0)
    none = nothing.groupBy("item").agg(F.sum("weight").alias("score"))
    cold = offers.people(people, nothing)
    assert ranked(op.top(offers.by_popularity(cold, catalogue, none, 4), 4)) == expected(users, items, [], lambda u, n: (0, ""))
    assert op.top(offers.by_popularity(cold, catalogue.limit(0), none, 4), 4).count() == 0
