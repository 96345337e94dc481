"""Sequential funnels: one attempt per user and funnel, and the tables computed from attempts.

A stage takes the first qualifying event strictly later than the last. Seen from the end, each event of a stage
knows what follows it: the earliest later event of the next stage, which knows its own. That is a running
minimum over a user's events, latest first, so all funnels take one shuffle and one sort that spills, and no
user's events are gathered in an array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import fingerprint, nearest_rank, rate, seconds_between, unpivoted


@dataclass(frozen=True)
class Stage:
    name: str
    events: tuple[str, ...]
    min_count: int = 1  # the match is so many qualifying events on
    paid: bool = False  # a paid subscription start qualifies too


@dataclass(frozen=True)
class Funnel:
    name: str
    stages: tuple[Stage, ...]
    days: int
    eligible: str = "true"  # condition on users joined with their set of event names, seen
    version: str = "1.0"

    def __post_init__(self) -> None:
        names = [s.name for s in self.stages]
        if len(names) < 2 or len(set(names)) != len(names) or self.days < 1 or any(s.min_count < 1 or not (s.events or s.paid) for s in self.stages):
            raise ValueError(f"funnel {self.name}: two stages of different names, events for each and a positive window are needed")


def activity(events: DataFrame, paid: DataFrame | None = None) -> DataFrame:
    """user_id, ts, event_id and name of events; paid subscription starts come in as name 'paid:'."""
    rows = events.select("user_id", "ts", F.col("event_id").cast("string").alias("event_id"), F.col("event_name").alias("name"))
    if paid is not None:
        rows = rows.unionByName(paid.where("mrr > 0").select("user_id", F.col("start_ts").alias("ts"), F.concat(F.lit("subscription:"), F.col("subscription_id").cast("string")).alias("event_id"), F.lit("paid:").alias("name")))
    return rows


def names_seen(rows: DataFrame) -> DataFrame:
    """user_id, the set of its event names, seen, and its last time."""
    return rows.groupBy("user_id").agg(F.collect_set("name").alias("seen"), F.max("ts").alias("last_ts"))


def chains(rows: DataFrame, funnels: Sequence[Funnel]) -> DataFrame:
    """user_id and, for each funnel, chain_<i>: ts and event_id of the first stage's match, and in ``next`` of those after it."""
    match = [[F.col("name").isin([*s.events, *(["paid:"] if s.paid else [])]) for s in f.stages] for f in funnels]
    every = sorted({x for f in funnels for s in f.stages for x in [*s.events, *(["paid:"] if s.paid else [])]})
    rows = rows.where(F.col("name").isin(every)).withColumn("_us", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")))
    user = Window.partitionBy("user_id")
    later = user.orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, -1)
    following = user.orderBy(F.desc("_us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    steps: list[list[tuple]] = []  # of each funnel from its end: (stage, window that the step looks through)
    for f in funnels:
        mine = []
        for i in range(len(f.stages) - 1, -1, -1):
            mine += [(i, following)] * (f.stages[i].min_count - 1) + ([(i, later)] if i else [])
        steps.append(mine)
    held: dict[int, Column] = {k: F.struct("ts", "event_id") for k in range(len(funnels))}
    for level in range(max(map(len, steps))):
        made = {}
        for k, mine in enumerate(steps):
            if level < len(mine):
                i, window = mine[level]
                found = F.min(F.when(match[k][i], F.struct("ts", "event_id", held[k].alias("h")))).over(window)["h"]
                made[f"_{k}_{level}"] = found
        rows = rows.withColumns(made)
        for k, mine in enumerate(steps):
            if level < len(mine):
                i, window = mine[level]
                held[k] = F.col(f"_{k}_{level}") if window is following else F.struct("ts", "event_id", F.col(f"_{k}_{level}").alias("next"))
    first = [F.min(F.when(match[k][0], F.struct("ts", "event_id", held[k].alias("h"))))["h"].alias(f"chain_{k}") for k in range(len(funnels))]
    return rows.groupBy("user_id").agg(*first)


def attempts(users: DataFrame, events: DataFrame, funnels: Sequence[Funnel], analysis_end: str, paid: DataFrame | None = None) -> DataFrame:
    """An attempt per funnel and eligible user who entered: stage times, highest stage and status.

    completed: last stage within the window, its end included; else censored if the window ends after
    analysis_end; else incomplete with the first stage alone; else abandoned. exit_ts is the completion, or else
    the last time of the user at all.
    """
    rows = activity(events, paid)
    rows = users.join(names_seen(rows), "user_id").join(chains(rows, funnels), "user_id")
    every = []
    for k, f in enumerate(funnels):
        at, chain = F.col(f"chain_{k}"), []
        for i in range(len(f.stages)):
            chain.append(at)
            at = at["next"] if i < len(f.stages) - 1 else at
        entered = F.expr(f.eligible) & F.col(f"chain_{k}").isNotNull()
        days = F.expr(f"INTERVAL {f.days} DAYS")
        every.append(F.when(entered, F.struct(
            F.lit(f.name).alias("funnel_id"), F.lit(f.version).alias("version"), F.array(*(c["ts"] for c in chain)).alias("stage_times"),
            F.array(*(c["event_id"] for c in chain)).alias("stage_events"), chain[-1]["ts"].alias("final"), (chain[0]["ts"] + days).cast("timestamp_ntz").alias("deadline"),
        )))
    rows = rows.select("user_id", "last_ts", F.explode(F.array_compact(F.array(*every))).alias("a")).select("user_id", "last_ts", "a.*")
    rows = rows.withColumn("entry_ts", F.get("stage_times", F.lit(0))).withColumn("n_reached", F.size(F.array_compact("stage_times")))
    end = F.lit(analysis_end).cast("timestamp_ntz")
    status = F.when(F.col("final") <= F.col("deadline"), "completed").when(F.col("deadline") > end, "censored").when(F.col("n_reached") == 1, "incomplete").otherwise("abandoned")
    rows = rows.withColumn("status", status)
    done = F.col("status") == "completed"
    key = F.concat(F.lit("fna_"), F.substring(fingerprint("funnel_id", "version", "user_id", "entry_ts"), 1, 20))
    return rows.select(
        key.alias("attempt_id"), "funnel_id", "user_id", "entry_ts", F.when(done, F.col("final")).otherwise(F.greatest("last_ts", "entry_ts")).alias("exit_ts"), "deadline", "n_reached", "status", "stage_times",
        "stage_events", F.when(done, seconds_between("entry_ts", "final")).alias("seconds"),
    )


def summary(found: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per funnel: counts by status, three rates and the median seconds of completed attempts.

    ``eligible`` is (funnel_id, eligible); funnels that nobody entered have their row too.
    """
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = found.groupBy("funnel_id").agg(F.count("*").alias("entrants"), *(count(s) for s in ("completed", "censored", "incomplete", "abandoned")))
    median = nearest_rank(found, ["funnel_id"], "seconds", {"median_seconds": 0.5}).select("funnel_id", "median_seconds")
    rows = eligible.join(rows, "funnel_id", "left").join(median, "funnel_id", "left").na.fill(0, ["entrants", "completed", "censored", "incomplete", "abandoned"])
    return rows.select(
        "funnel_id", "eligible", "entrants", (F.col("eligible") - F.col("entrants")).alias("non_entrants"), "completed", "censored", "incomplete", "abandoned",
        rate("entrants", "eligible").alias("entry_rate"), rate("completed", "eligible").alias("completion_rate"),
        rate("completed", F.col("entrants") - F.col("censored")).alias("observed_completion_rate"), "median_seconds",
    )


def stage_rows(found: DataFrame) -> DataFrame:
    """A row per attempt and stage of its funnel: stage (from 0), ts and seconds since the stage before, null if not reached."""
    rows = found.select("funnel_id", "user_id", F.col("stage_times").alias("times"), F.posexplode("stage_times").alias("stage", "ts"))
    return rows.withColumn("seconds", F.when(F.col("stage") > 0, seconds_between(F.get("times", F.col("stage") - 1), "ts"))).drop("times")


def stage_metrics(found: DataFrame) -> DataFrame:
    """Reach, step rate from the stage before (entrants for the first) and drop-off per stage."""
    rows = stage_rows(found).groupBy("funnel_id", "stage").agg(F.count("ts").alias("reached"), F.count("*").alias("entrants"))
    order = Window.partitionBy("funnel_id").orderBy("stage")
    rows = rows.withColumn("previous", F.coalesce(F.lag("reached").over(order), F.col("entrants")))
    return rows.select("funnel_id", "stage", "reached", "previous", rate("reached", "previous").alias("step_rate"), rate("reached", "entrants").alias("reach_rate"), (F.col("previous") - F.col("reached")).alias("drop_off"))


def time_metrics(found: DataFrame) -> DataFrame:
    """Seconds from stage to stage: count, extremes and percentiles, the 90th from five values on."""
    got = nearest_rank(stage_rows(found).where("stage > 0"), ["funnel_id", "stage"], "seconds", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    return got.withColumn("p90", F.when(F.col("n") >= 5, F.col("p90")))


def segment_metrics(found: DataFrame, users: DataFrame, dimensions: list[str], suppression: int) -> DataFrame:
    """Entrants, completions and rate by each dimension alone; groups of fewer entrants than ``suppression`` show no rate."""
    rows = unpivoted(found.select("funnel_id", "user_id", "status").join(users.select("user_id", *dimensions), "user_id"), ["funnel_id", "status"], dimensions)
    rows = rows.groupBy("funnel_id", "dimension", "value").agg(F.count("*").alias("entrants"), F.count_if(F.col("status") == "completed").alias("completed"))
    hidden = F.col("entrants") < suppression
    return rows.select("funnel_id", "dimension", "value", "entrants", F.when(~hidden, F.col("completed")).alias("completed"), F.when(~hidden, rate("completed", "entrants")).alias("completion_rate"), hidden.alias("suppressed"))


def dropoff(found: DataFrame, events: DataFrame, error_events: list[str], session: str = "session") -> DataFrame:
    """Attempts that did not complete by their highest stage: users, share of entrants, errors, sessions, most frequent last event.

    Errors and distinct sessions count from entry to exit, both ends included.
    """
    open_ = found.where("status <> 'completed'").select("attempt_id", "funnel_id", "user_id", "entry_ts", "exit_ts", "n_reached", F.get("stage_events", F.col("n_reached") - 1).alias("last_event"))
    rows = events.select("user_id", "ts", F.col("event_name").isin(error_events).alias("bad"), F.col(session).alias("session"))
    inside = F.col("ts").between(F.col("entry_ts"), F.col("exit_ts"))
    hit = open_.join(rows, "user_id", "left").groupBy("attempt_id", "funnel_id", "n_reached", "last_event").agg(F.count_if(inside & F.col("bad")).alias("errors"), F.countDistinct(F.when(inside, F.col("session"))).alias("sessions"))
    keys = ["funnel_id", F.col("n_reached").alias("highest_stage")]
    out = hit.groupBy(*keys).agg(F.count("*").alias("users"), F.sum("errors").alias("errors"), F.bround(F.avg("errors"), 6).alias("errors_per_user"))
    entrants = found.groupBy("funnel_id").agg(F.count("*").alias("entrants"))
    sessions = nearest_rank(hit.withColumnRenamed("n_reached", "highest_stage"), ["funnel_id", "highest_stage"], "sessions", {"median_sessions": 0.5}).select("funnel_id", "highest_stage", "median_sessions")
    common = hit.groupBy(*keys, "last_event").agg(F.count("*").alias("n")).groupBy("funnel_id", "highest_stage").agg(F.min_by("last_event", F.struct((-F.col("n")).alias("n"), "last_event")).alias("common_last_event"))
    rows = out.join(entrants, "funnel_id").join(sessions, ["funnel_id", "highest_stage"]).join(common, ["funnel_id", "highest_stage"])
    return rows.withColumn("share_of_entrants", rate("users", "entrants")).drop("entrants")


def diagnostics(found: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: funnels evaluated, attempts by status and suppressed segment rows."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    left = found.agg(F.countDistinct("funnel_id").alias("funnels"), F.count("*").alias("attempts"), *(status(s) for s in ("completed", "abandoned", "incomplete", "censored")))
    return left.join(F.broadcast(segments.agg(F.count_if("suppressed").alias("suppressed_segments"))))  # one row each


def broken_attempts(found: DataFrame) -> DataFrame:
    """(attempt_id, rule) of attempts that can't be: repeated ids, stages not strictly later, a completion that isn't the last stage's."""
    times = F.array_compact("stage_times")
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size(times) - 1, F.lit(1))), lambda i: F.coalesce(F.get(times, i) > F.get(times, i - 1), F.lit(True)))
    gaps = F.size(times) != F.size(F.filter(F.slice("stage_times", 1, F.size(times)), lambda x: x.isNotNull()))
    rules = F.array(F.when(~ordered, F.lit("STAGES_OUT_OF_ORDER")), F.when(gaps, F.lit("STAGE_SKIPPED")), F.when((F.col("status") == "completed") & (F.col("exit_ts") != F.element_at("stage_times", -1)), F.lit("COMPLETION_NOT_LAST_STAGE")), F.when(F.col("exit_ts") < F.col("entry_ts"), F.lit("EXIT_BEFORE_ENTRY")))
    rows = found.select("attempt_id", F.explode(F.array_compact(rules)).alias("rule"))
    again = found.groupBy("attempt_id").agg(F.count("*").alias("n")).where("n > 1").select("attempt_id", F.lit("ATTEMPT_ID_REPEATED").alias("rule"))
    return rows.unionByName(again)


def broken_summary(totals: DataFrame, stages: DataFrame) -> DataFrame:
    """(funnel_id, rule) of summaries that don't reconcile: more entrants than eligible, statuses that don't add up, rates outside [0, 1], reach that grows."""
    rates = ["entry_rate", "completion_rate", "observed_completion_rate"]
    parts = F.col("completed") + F.col("censored") + F.col("incomplete") + F.col("abandoned")
    rules = F.array(F.when(F.col("entrants") > F.col("eligible"), F.lit("ENTRANTS_ABOVE_ELIGIBLE")), F.when(parts != F.col("entrants"), F.lit("STATUS_SUM")), *(F.when(~F.col(r).between(0, 1), F.lit(f"RATE_RANGE:{r}")) for r in rates))
    return totals.select("funnel_id", F.explode(F.array_compact(rules)).alias("rule")).unionByName(stages.where("reached > previous").select("funnel_id", F.lit("REACH_GROWS").alias("rule")).distinct())
