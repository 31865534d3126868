"""T5: admission of calls by minute, day, month and budget.

Whether a call is let through depends on which calls were let through before it,
per tenant.  The work is cut into (tenant, day) pieces that run side by side; each
piece streams its calls in time order and keeps only a few numbers of state.  A
piece first runs as if nothing came before it.  Then the true state at its start
is known from the pieces before it, and only the pieces for which that state could
change a decision run again, until none is left.  The result equals one pass
over every tenant from its first call to its last.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from newsmill import fixed
from newsmill.operators.usage import rate_limits
from newsmill.session import durable

MINUTE = 60.0
PIECE = ["tenant", "day"]


@dataclass
class Gate:
    """State of one tenant while its calls pass in time order."""

    limits: Mapping[str, Any]
    recent: deque = field(default_factory=deque)
    daily: int = 0
    monthly: int = 0
    spent: float = 0.0
    day: str = ""
    month: str = ""

    def decide(self, t: float, day: str, month: str, cost: float, rpm: int, rpd: int) -> str:
        """``accepted``, or the limit that stops the call; rejected calls do not count."""
        if day != self.day:
            self.day, self.daily = day, 0
        if month != self.month:
            self.month, self.monthly, self.spent = month, 0, 0.0
        lim = self.limits
        if lim["enabled"]:
            if self.daily >= lim["daily_max_calls"]:
                return "daily"
            if self.monthly >= lim["monthly_max_calls"]:
                return "monthly"
            if lim["cooldown_enabled"] and self.spent >= lim["monthly_budget_usd"]:
                return "budget"
        while self.recent and self.recent[0] <= t - MINUTE:
            self.recent.popleft()
        if lim["free_tier_only"]:
            if len(self.recent) >= rpm:
                return "rpm"
            if self.daily >= rpd:
                return "rpd"
        self.recent.append(t)
        self.daily += 1
        self.monthly += 1
        self.spent = round(self.spent + cost, 6)
        return "accepted"


def _run_pieces(limits: Mapping[str, Any]):
    """Batches of calls sorted by (tenant, day, t) in, decisions out.

    Start states are on every call; they are read on the first of a piece only."""
    shown = ["call_id", "tenant", "day", "month", "t", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, piece = None, None
        for batch in batches:
            out = []
            calls = [batch[c].to_pylist() for c in ("tenant", "day", "month", "t", "cost", "rpm", "rpd")]
            for i, (tenant, day, month, t, cost, rpm, rpd) in enumerate(zip(*calls)):
                if (tenant, day) != piece:
                    piece = (tenant, day)
                    recent, daily, monthly, spent = (batch[c][i].as_py() for c in START)
                    gate = Gate(limits, deque(recent), daily, monthly, spent, day, month)
                cost = float("nan") if cost is None else cost
                out.append(gate.decide(t, day, month, cost, rpm, rpd))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in shown), pa.array(out, pa.string())], names=[*shown, "decision"]
            )

    return run


_DECISIONS = "call_id long, tenant string, day string, month string, t double, cost double, decision string"


def _decide(rows: DataFrame, states: DataFrame, limits: Mapping[str, Any]) -> DataFrame:
    ready = (
        rows.join(states, PIECE)
        .repartition(*PIECE)
        .sortWithinPartitions(*PIECE, "t", "call_id")
    )
    return durable(ready.mapInArrow(_run_pieces(limits), _DECISIONS), "decisions")


def _outcomes(decided: DataFrame) -> DataFrame:
    """What each piece passes on: calls, cost, and accepted times of its last minute."""
    day_end = F.unix_seconds(F.to_timestamp("day")) + 86400
    late = (F.col("decision") == "accepted") & (F.col("t") > day_end - MINUTE)
    yes = F.col("decision") == "accepted"
    # At most one minute's limit of accepted calls per piece is collected.
    return decided.groupBy(*PIECE, "month").agg(
        F.count_if(yes).alias("calls"),
        F.coalesce(F.round(F.sum(F.when(yes, F.col("cost"))), 6), F.lit(0.0)).alias("spent"),
        F.array_sort(F.collect_list(F.when(late, F.col("t")))).alias("tail"),
    )


START = ["s_recent", "s_daily", "s_monthly", "s_spent"]


def _start_states(outcomes: DataFrame, initial: DataFrame | None) -> DataFrame:
    """State at the start of every piece, from what the pieces before it pass on."""
    pieces = outcomes.select(
        *PIECE, "month", "calls", "spent", "tail", F.lit(0).cast("long").alias("daily"), F.lit(1).alias("real")
    )
    if initial is not None:
        # What is known of a tenant beforehand stands in front of its first piece.
        pieces = pieces.unionByName(
            initial.select(
                *PIECE, "month", F.col("monthly").alias("calls"), "spent", F.col("recent").alias("tail"),
                "daily", F.lit(0).alias("real"),
            )
        )
    in_order = Window.partitionBy("tenant").orderBy("day", "real")
    in_month = (
        Window.partitionBy("tenant", "month").orderBy("day", "real")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.lag("day").over(in_order)
    same = before == F.col("day")
    adjacent = before == F.date_format(F.date_sub(F.to_date("day"), 1), "yyyy-MM-dd")
    return pieces.select(
        *PIECE, "month", "calls", "spent", "real",
        F.when(same | adjacent, F.lag("tail").over(in_order))
        .otherwise(F.array().cast("array<double>")).alias("s_recent"),
        F.when(same, F.lag("daily").over(in_order)).otherwise(F.lit(0).cast("long")).alias("s_daily"),
        F.coalesce(F.sum("calls").over(in_month), F.lit(0)).alias("s_monthly"),
        F.coalesce(F.round(F.sum("spent").over(in_month), 6), F.lit(0.0)).alias("s_spent"),
    ).where("real = 1").drop("real")


def _end_states(decided: DataFrame, starts: DataFrame, initial: DataFrame | None) -> DataFrame:
    """State of every tenant after its last call, for the next batch."""
    lasts = decided.groupBy("tenant").agg(F.max(F.struct("day", "t")).alias("_last")).select(
        "tenant", F.col("_last.day").alias("day"), F.col("_last.t").alias("_t")
    )
    late = (
        decided.where("decision = 'accepted'").join(lasts, PIECE)
        .where(F.col("t") > F.col("_t") - MINUTE)
        .groupBy("tenant").agg(F.collect_list("t").alias("_late"))
    )
    none = F.array().cast("array<double>")
    ended = starts.join(lasts, PIECE).join(late, "tenant", "left").select(
        "tenant", "day", "month",
        (F.col("s_daily") + F.col("calls")).alias("daily"),
        (F.col("s_monthly") + F.col("calls")).alias("monthly"),
        F.round(F.col("s_spent") + F.col("spent"), 6).alias("spent"),
        F.array_sort(
            F.filter(
                F.concat("s_recent", F.coalesce("_late", none)), lambda x: x > F.col("_t") - MINUTE
            )
        ).alias("recent"),
    )
    if initial is None:
        return ended
    return ended.unionByName(initial.join(ended.select("tenant"), "tenant", "left_anti").select(*ended.columns))


def _last_round(rounds: list[DataFrame], outcomes: DataFrame) -> DataFrame:
    """The decisions of each piece in the last round that ran it."""
    if len(rounds) == 1:
        return rounds[0]
    every = reduce(DataFrame.unionByName, [d.withColumn("_round", F.lit(i)) for i, d in enumerate(rounds)])
    last = outcomes.select(*PIECE, "_round")
    return every.join(last, [*PIECE, "_round"], "left_semi").select(*rounds[0].columns)


def prepare(calls: DataFrame, tenant: str = "task_id") -> DataFrame:
    """The columns that decide: tenant, day, month, time, cost and the model's limits."""
    rpm, rpd = rate_limits("model")
    ts = F.col("ts").cast("timestamp")
    return calls.select(
        F.col("call_id").cast("long").alias("call_id"),
        F.col(tenant).cast("string").alias("tenant"),
        F.date_format(ts, "yyyy-MM-dd").alias("day"),
        F.date_format(ts, "yyyy-MM").alias("month"),
        (F.unix_micros(ts) / 1e6).alias("t"),
        F.col("cost").cast("double").alias("cost"),
        rpm.cast("int").alias("rpm"),
        rpd.cast("int").alias("rpd"),
    ).where(F.col("tenant").isNotNull())


def settle_admission(
    rows: DataFrame, limits: Mapping[str, Any], initial: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Decisions of prepared calls and the state of every tenant after them."""
    limits = {**fixed.DEFAULT_LIMITS, **limits}
    budget = limits["monthly_budget_usd"] if limits["cooldown_enabled"] else float("inf")
    most = limits["monthly_max_calls"]
    if not limits["enabled"]:
        budget, most = float("inf"), 2**62
    # Priced and dated once, not in every round.
    rows = durable(rows, "calls")
    nothing = rows.groupBy(*PIECE, "month").agg(
        F.lit(0).cast("long").alias("calls"), F.lit(0.0).alias("spent"),
        F.array().cast("array<double>").alias("tail"),
    )
    used = durable(_start_states(nothing, initial).select(*PIECE, *START), "states")
    # A round writes its own pieces only; which round of a piece counts stands with its outcome.
    rounds = [_decide(rows, used, limits)]
    outcomes = durable(_outcomes(rounds[0]).withColumn("_round", F.lit(0)), "outcomes")
    while True:
        true = durable(_start_states(outcomes, initial), "true")
        old = used.select(*PIECE, *[F.col(c).alias(f"o_{c}") for c in START])
        both = true.join(old, PIECE)
        binds = (
            (F.greatest("s_monthly", "o_s_monthly") + F.col("calls") >= most)
            | (F.greatest("s_spent", "o_s_spent") + F.col("spent") >= budget)
        )
        moved = (F.col("s_monthly") != F.col("o_s_monthly")) | (F.col("s_spent") != F.col("o_s_spent"))
        stale = durable(
            both.where((F.col("s_recent") != F.col("o_s_recent")) | (moved & binds)).select(
                *PIECE, *START
            ),
            "stale",
        )
        if stale.isEmpty():
            decided = _last_round(rounds, outcomes)
            return decided, _end_states(decided, true, initial)
        rounds.append(_decide(rows, stale, limits))
        redone = _outcomes(rounds[-1]).withColumn("_round", F.lit(len(rounds) - 1))
        kept = outcomes.join(stale.select(*PIECE), PIECE, "left_anti").select(*outcomes.columns)
        outcomes = durable(kept.unionByName(redone), "outcomes")
        used = durable(
            used.join(stale.select(*PIECE), PIECE, "left_anti").unionByName(stale), "states"
        )


def admit(
    calls: DataFrame, limits: Mapping[str, Any] = fixed.DEFAULT_LIMITS, tenant: str = "task_id"
) -> DataFrame:
    """Decision per call (``call_id`` unique); see the module text."""
    decided, _ = settle_admission(prepare(calls, tenant), limits)
    return decided.select("call_id", F.col("tenant").alias(tenant), "decision")
