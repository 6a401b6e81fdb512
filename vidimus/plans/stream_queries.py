"""The events table read as a stream. Every query drains what is there and returns the settled result,
which must equal the batch answer."""
from __future__ import annotations

from pyspark.sql import functions as F

from vidimus.functions.frames import scratch_path
from vidimus.plans import inputs as inp
from vidimus.plans.log_queries import FOLD_SQL, STREAK_OUT, STREAK_SQL, _flat
from vidimus.plans.registry import query
from vidimus.streaming import log as st


def _raw(spark, sf):
    """The events table as four files that arrive one after the other, each with rows from everywhere in
    the sequence, so that every batch but the first is late for most of it."""
    events, parts = inp.table(spark, sf, "events"), scratch_path(spark, "arriving")
    events.repartition(4, "event_id").write.parquet(parts)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    return rows.select(F.col("event_id").alias("seq"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _runs(spark, sf):
    return inp.run_log_of(_raw(spark, sf))


@query("stream_refusals", f"WITH {inp.RUNS_SQL} SELECT run_id, rule, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM runs WHERE event = 'refused' GROUP BY 1, 2")
def stream_refusals(spark, sf):
    return st.drain(st.stream_census(_runs(spark, sf)), ["run_id", "rule"], "refusals").drop("category")


@query("stream_calls", f"WITH {inp.RUNS_SQL} SELECT run_id, count(*) AS calls, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(coalesce(sum(CASE WHEN k % 3 <> 0 THEN k * 2 END), 0) AS BIGINT) AS output_tokens, CAST(sum(k * 10) AS BIGINT) AS latency_ms, round(sum(coalesce(cost_usd, 0)), 6) AS cost_usd FROM runs WHERE event = 'model_call' GROUP BY 1")
def stream_calls(spark, sf):
    return st.drain(st.stream_calls(_runs(spark, sf)), ["run_id"], "calls").withColumn("cost_usd", F.round("cost_usd", 6))


@query("stream_spend", f"WITH {inp.RUNS_SQL} SELECT run_id, count(*) AS calls, count(*) FILTER (cost_usd IS NULL) AS unpriced_calls, round(sum(coalesce(cost_usd, 0.01)), 6) AS spent_usd, round(greatest(0, 0.5 - sum(coalesce(cost_usd, 0.01))), 6) AS remaining_usd, sum(coalesce(cost_usd, 0.01)) >= 0.5 AS stop FROM runs WHERE event = 'model_call' GROUP BY 1")
def stream_spend(spark, sf):
    out = st.drain(st.stream_spend(_runs(spark, sf), 0.5), ["run_id"], "spend")
    return out.withColumn("spent_usd", F.round("spent_usd", 6)).withColumn("remaining_usd", F.round("remaining_usd", 6))


@query("stream_runs", f"""WITH {inp.RUNS_SQL} SELECT run_id, max(seq) FILTER (event = 'run_started') AS started_seq, max(seq) FILTER (event = 'run_finished') AS finished_seq, count(*) AS events, count(*) FILTER (event = 'refused') AS refusals,
  max(seq) FILTER (event = 'run_started') IS NOT NULL AND NOT coalesce(max(seq) FILTER (event = 'run_finished') > max(seq) FILTER (event = 'run_started'), false) AS open FROM runs GROUP BY 1""")
def stream_runs(spark, sf):
    return st.drain(st.stream_runs(_runs(spark, sf)), ["run_id"], "runs")


@query("stream_streaks", f"WITH {STREAK_SQL} {STREAK_OUT}")
def stream_streaks(spark, sf):
    from vidimus.operators.census import refusals

    store = scratch_path(spark, "streaks")
    st.stream_streaks(refusals(inp.refused_log_of(_raw(spark, sf))), store, f"{store}/checkpoint").awaitTermination()
    return _flat(st.stored_streaks(spark, store))


@query("stream_projection", f"WITH {FOLD_SQL} SELECT id, type, status, rejected_reason, created_seq, updated_seq FROM fold UNION ALL SELECT id, type, status, rejected_reason, created_seq, updated_seq FROM dec")
def stream_projection(spark, sf):
    store, parts = scratch_path(spark, "graph"), scratch_path(spark, "log")
    # the log arrives as several files, in no particular order
    inp.ladder_log(spark, sf).repartition(4, "seq").write.parquet(parts)
    log = spark.readStream.schema(spark.read.parquet(parts).schema).option("maxFilesPerTrigger", 1).parquet(parts)
    st.stream_project(log, store, f"{store}/checkpoint").awaitTermination()
    return st.stored_graph(spark, store).nodes.select("id", "type", "status", "rejected_reason", "created_seq", "updated_seq")


# the log as text files of which the last repeats lines of the others; the tail stops after two files and starts again
@query("log_tail", "SELECT event_id AS seq, 'agent:' || user_id AS authored_by, 'analysis' AS event, CAST(event_id % 3 AS VARCHAR) AS run_id FROM events")
def log_tail(spark, sf):
    from vidimus.sources.eventlog import to_line

    root = scratch_path(spark, "tail")
    e = inp.table(spark, sf, "events")
    lines = e.select(
        F.col("event_id").alias("seq"), F.lit("analysis").alias("event"), F.concat(F.lit("agent:"), "user_id").alias("authored_by"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        (F.col("event_id") % 3).cast("string").alias("run_id"), F.lit(None).cast("string").alias("detail"))
    line = to_line(lines).alias("value")
    lines.filter("seq % 2 = 0").select(line).coalesce(1).write.text(f"{root}/log/first")
    lines.filter("seq % 2 = 1 AND seq % 5 <> 0").select(line).coalesce(1).write.text(f"{root}/log/second")

    def read_on() -> None:
        tail = st.tail(spark, f"{root}/log/*", "3650 days", max_files=1)
        keep = lambda b, n: b.select("seq", "authored_by", "event", "run_id").write.mode("overwrite").parquet(f"{root}/seen/epoch={n}")
        tail.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    read_on()
    lines.filter("seq % 5 = 0 OR seq % 7 = 0").select(line).coalesce(1).write.text(f"{root}/log/third")
    read_on()
    return spark.read.parquet(f"{root}/seen").drop("epoch")
