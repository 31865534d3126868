"""W3, W4, W6, W8 and the usage report."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsmill.operators import ordered, usage
from newsmill.suite.base import CALLS, PRICED, calls, priced, query, stamp, stamp_sql, table


@query(
    "w3_recent_calls",
    f"""WITH {CALLS} SELECT DISTINCT epoch_us(ts) AS us, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS recent_calls FROM calls""",
)
def w3(spark, sf):
    return usage.recent_calls(calls(spark, sf)).select(F.unix_micros("ts").alias("us"), "recent_calls")


@query(
    "w3_recent_calls_by_model",
    f"""WITH {CALLS} SELECT DISTINCT model, epoch_us(ts) AS us, count(*) OVER (PARTITION BY model ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM calls""",
)
def w3b(spark, sf):
    return ordered.calls_in_last(calls(spark, sf), ["model"], "ts", 3600).select("model", F.unix_micros("ts").alias("us"), "recent")


_RUN = "OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)"


@query(
    "w4_running_usage",
    f"""WITH {PRICED} SELECT call_id, count(*) {_RUN} AS running_calls, CAST(sum(CAST(cost AS DECIMAL(28,6))) {_RUN} AS DOUBLE) AS running_cost FROM priced""",
)
def w4(spark, sf):
    return usage.running_usage(priced(spark, sf)).select("call_id", "running_calls", "running_cost")


@query(
    "w4_first_over_budget",
    f"""WITH {PRICED}, r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts, sum(CAST(cost AS DECIMAL(28,6))) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, call_id) AS c FROM priced)
    SELECT day, {stamp_sql('min(ts)')} AS reached_at FROM r WHERE c >= 0.05 GROUP BY day""",
)
def w4b(spark, sf):
    over = usage.first_over(usage.running_usage(priced(spark, sf), "day"), 0.05)
    return over.select(F.date_format("period", "yyyy-MM-dd").alias("day"), stamp("reached_at").alias("reached_at"))


@query("w6_last_calls", f"WITH {CALLS} SELECT call_id FROM calls ORDER BY ts DESC, call_id DESC LIMIT 500")
def w6(spark, sf):
    return usage.last_calls(calls(spark, sf)).select("call_id")


@query(
    "w6_last_calls_per_task",
    f"WITH {CALLS} SELECT task_id, call_id FROM calls QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, call_id DESC) <= 5",
)
def w6b(spark, sf):
    return usage.last_calls(calls(spark, sf), ["task_id"], 5).select("task_id", "call_id")


@query(
    "w8_rolling_context",
    """WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' OR turn = 0)
    SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM c""",
)
def w8(spark, sf):
    accepted = table(spark, sf, "conversations").where("role = 'assistant' or turn = 0").select("conv_id", "turn", "text")
    out = ordered.lookback(accepted, ["conv_id"], ["turn"], F.col("text"), 5, "ctx")
    return out.select("conv_id", "turn", F.array_join("ctx", "\n").alias("context"))


@query(
    "w8_shared_context",
    """SELECT doc_id, coalesce(string_agg(source || ':' || n_chars, ' ') OVER (ORDER BY doc_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM documents""",
)
def w8b(spark, sf):
    # One context shared by everything: a single key, spread over chunks.
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    label = F.concat("source", F.lit(":"), F.col("n_chars").cast("string"))
    out = ordered.lookback(d, [], ["doc_id"], label, 5, "ctx")
    return out.select("doc_id", F.array_join("ctx", " ").alias("context"))
