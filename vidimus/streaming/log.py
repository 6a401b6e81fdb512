"""The log as a stream: tail, running reads, incremental projection and streaks (M1-M6).

Running totals are plain streaming aggregates (partial sums before the shuffle, so a busy run or author
is no hot spot). The projection and the streaks keep their state as tables under a store path, one
folder per micro-batch that a replayed batch overwrites, so a restart never counts an event twice.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidimus.functions.frames import SPAN, scratch_path
from vidimus.operators import projection as pj
from vidimus.operators.census import UNKNOWN_CALL_COST, rule_category
from vidimus.sources.eventlog import parse_lines


def tail(spark: SparkSession, path: str, horizon: str | None = None, max_files: int = 1000) -> DataFrame:
    """New log files as a stream of events (M1). With a horizon, repeats of a sequence number within it
    are dropped; without one, no dedupe state is kept."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    events, _ = parse_lines(lines)
    return events if horizon is None else dedupe(events, horizon)


def dedupe(events: DataFrame, horizon: str) -> DataFrame:
    stamped = events.withColumn("_at", F.to_timestamp("at")).withWatermark("_at", horizon)
    return stamped.dropDuplicatesWithinWatermark(["seq"]).drop("_at")


# --- running totals -----------------------------------------------------------------------------------
def stream_census(events: DataFrame) -> DataFrame:
    """Running refusal counts per run and rule (M3)."""
    rule = F.coalesce(F.get_json_object("detail", "$.rule"), F.lit("unknown"))
    return events.filter("event = 'refused'").groupBy(F.coalesce("run_id", F.lit("")).alias("run_id"), rule.alias("rule")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    ).withColumn("category", rule_category("rule"))


def stream_calls(events: DataFrame) -> DataFrame:
    """Running model-call totals per run (M3)."""
    z = lambda c, out: F.sum(F.coalesce(c, F.lit(0))).alias(out)
    return events.filter("event = 'model_call'").groupBy(F.coalesce("run_id", F.lit("")).alias("run_id")).agg(
        F.count(F.lit(1)).alias("calls"), z("input_tokens", "input_tokens"), z("output_tokens", "output_tokens"),
        z("latency_ms", "latency_ms"), z("cost_usd", "cost_usd"),
    )


def stream_spend(events: DataFrame, budget: float, default: float = UNKNOWN_CALL_COST) -> DataFrame:
    """Running spend per run, and whether the next call must not be made (M4)."""
    spent = events.filter("event = 'model_call'").groupBy(F.coalesce("run_id", F.lit("")).alias("run_id")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_calls"),
        F.sum(F.coalesce("cost_usd", F.lit(default))).alias("spent_usd"),
    )
    return spent.withColumn("remaining_usd", F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("spent_usd"))).withColumn(
        "stop", F.col("spent_usd") >= F.lit(float(budget))
    )


def stream_runs(events: DataFrame) -> DataFrame:
    """Runs and whether they have finished; an open run is reported, never closed for it (M6)."""
    run = F.coalesce("run_id", F.get_json_object("detail", "$.run_id"))
    rows = events.withColumn("run_id", run).filter("run_id IS NOT NULL")
    at = lambda e: F.when(F.col("event") == e, F.col("seq"))
    return rows.groupBy("run_id").agg(
        F.max(at("run_started")).alias("started_seq"), F.max(at("run_finished")).alias("finished_seq"), F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event") == "refused").alias("refusals"),
    ).withColumn("open", F.col("started_seq").isNotNull() & ~F.coalesce(F.col("finished_seq") > F.col("started_seq"), F.lit(False)))


def update_table(running: DataFrame, path: str, checkpoint: str):
    """Start a query that writes each batch's changed rows under their batch number."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return running.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each key of an update table."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


def drain(running: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a running total over everything available and read the result back."""
    spark = running.sparkSession
    path, mark = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    query = update_table(running, path, mark)
    query.awaitTermination()
    return current_rows(spark, path, keys)


# --- incremental projection ----------------------------------------------------------------------------
_PARTS = ("nodes", "edges", "agents", "node_acts", "edge_acts", "edge_moves")


def project_batch(batch: DataFrame, store: str, epoch: int) -> None:
    """Fold one micro-batch on its own and add the partial tables to the store."""
    batch = batch.persist()
    parts = {
        "nodes": pj.fold_nodes(batch), "edges": pj.fold_edges(batch), "agents": pj.fold_agents(batch),
        "node_acts": pj.node_acts(batch), "edge_acts": pj.edge_acts(batch), "edge_moves": pj.edge_move_acts(batch),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{store}/{name}/epoch={epoch}")
    batch.unpersist()


def stream_project(events: DataFrame, store: str, checkpoint: str):
    """Incremental projection (M2): partial folds are merged on read, so late or unordered events give
    the same graph as a replay."""
    return events.writeStream.foreachBatch(lambda b, e: project_batch(b, store, e)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_graph(spark: SparkSession, store: str) -> pj.Graph:
    part = {name: spark.read.parquet(f"{store}/{name}").drop("epoch") for name in _PARTS}
    nodes = pj.finish_nodes(pj.merge_nodes(part["nodes"]))
    edges = pj.finish_edges(pj.merge_edges(part["edges"]))
    return pj.Graph(
        nodes, edges, pj.settle_node_acts(part["node_acts"], nodes.select("id", "created_seq")),
        part["edge_acts"].unionByName(pj.settle_edge_moves(part["edge_moves"], edges)), pj.finish_agents(pj.merge_agents(part["agents"])),
    )


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Merge all partial folds into one set under a new store path; the old one is left alone."""
    merge = {"nodes": pj.merge_nodes, "edges": pj.merge_edges, "agents": pj.merge_agents}
    for name in _PARTS:
        rows = spark.read.parquet(f"{store}/{name}")
        top = rows.agg(F.max("epoch")).first()[0]
        merge.get(name, lambda d: d)(rows.drop("epoch")).write.mode("errorifexists").parquet(f"{target}/{name}/epoch={top}")


# --- streaks ---------------------------------------------------------------------------------------------
_REFUSED = "authored_by STRING, seq BIGINT, rule STRING, attempted STRING, node_id STRING"
_NAMED = "ARRAY<STRUCT<seq: BIGINT, name: STRING>>"
_RUN = f"authored_by STRING, chunk BIGINT, rule STRING, count BIGINT, first_seq BIGINT, last_seq BIGINT, attempted {_NAMED}, node_ids {_NAMED}, leads BOOLEAN, trails BOOLEAN"


def _folded(refused: DataFrame) -> DataFrame:
    """Runs of one rule within each author's rows of one chunk; whether a run is the first or last there."""
    key = ["authored_by", "chunk"]
    w = Window.partitionBy(*key).orderBy("seq")  # a chunk holds at most `span` sequence numbers
    marked = refused.withColumn("_new", (~F.lag("rule").over(w).eqNullSafe(F.col("rule")) | (F.row_number().over(w) == 1)).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = runs.groupBy(*key, "_run").agg(F.first("rule").alias("rule"), F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    size = size.withColumn("_runs", F.max("_run").over(Window.partitionBy(*key)))

    def named(column: str, out: str) -> DataFrame:
        firsts = runs.filter(F.col(column).isNotNull()).groupBy(*key, "_run", column).agg(F.min("seq").alias("seq"))
        return firsts.groupBy(*key, "_run").agg(F.array_sort(F.collect_list(F.struct("seq", F.col(column).alias("name")))).alias(out))

    j = size.join(named("attempted", "attempted"), [*key, "_run"], "left").join(named("node_id", "node_ids"), [*key, "_run"], "left")
    none = F.array().cast(_NAMED)
    return j.select(
        *key, "rule", "count", "first_seq", "last_seq", F.coalesce("attempted", none).alias("attempted"), F.coalesce("node_ids", none).alias("node_ids"),
        (F.col("_run") == 1).alias("leads"), (F.col("_run") == F.col("_runs")).alias("trails"),
    )


def streak_batch(refused: DataFrame, store: str, epoch: int, span: int = SPAN) -> None:
    """One micro-batch of refusals, in any order and however late, folded into the store.

    Refusals are kept by chunk of the sequence. A batch folds again, whole, just those chunks it has rows
    in, from all batches up to its own; other chunks keep the runs they have. A repeated sequence number
    counts once, and a batch that is run again writes the same folders."""
    spark = refused.sparkSession
    rows = refused.select("authored_by", F.col("seq").cast("bigint").alias("seq"), "rule", "attempted", "node_id")
    rows.withColumn("chunk", F.floor(F.col("seq") / span)).write.mode("overwrite").partitionBy("chunk").parquet(f"{store}/refused/epoch={epoch}")
    held = spark.read.schema(f"{_REFUSED}, epoch INT, chunk BIGINT").parquet(f"{store}/refused").filter(F.col("epoch") <= epoch)
    touched = held.filter(F.col("epoch") == epoch).select("chunk").distinct()
    again = held.join(touched, "chunk", "left_semi").drop("epoch").dropDuplicates(["seq"])
    _folded(again).write.mode("overwrite").parquet(f"{store}/runs/epoch={epoch}")


def stream_streaks(refused: DataFrame, store: str, checkpoint: str, span: int = SPAN):
    """Streaks over an arriving log (M5)."""
    return refused.writeStream.foreachBatch(lambda b, e: streak_batch(b, store, e, span)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_streaks(spark: SparkSession, store: str, min_len: int = 2) -> DataFrame:
    """The streaks as they stand: each chunk's newest runs, those at its ends joined to the next chunk's."""
    runs = spark.read.schema(f"{_RUN}, epoch INT").parquet(f"{store}/runs")
    runs = runs.join(runs.groupBy("chunk").agg(F.max("epoch").alias("epoch")), ["chunk", "epoch"])
    outer = F.col("leads") | F.col("trails")
    w = Window.partitionBy("authored_by").orderBy("first_seq")  # two runs a chunk at most
    joins = F.lag("rule").over(w).eqNullSafe(F.col("rule")) & (F.lag("chunk").over(w) < F.col("chunk"))
    ends = runs.filter(outer).withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    ends = ends.withColumn("_streak", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = lambda c: F.array_distinct(F.transform(F.array_sort(F.flatten(F.collect_list(c))), lambda x: x["name"])).alias(c)
    long = ends.groupBy("authored_by", "_streak").agg(
        F.first("rule").alias("rule"), F.sum("count").alias("count"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), names("attempted"), names("node_ids"))
    inner = runs.filter(~outer)
    plain = lambda c: F.transform(c, lambda x: x["name"]).alias(c)
    cols = ["authored_by", "rule", "count", "first_seq", "last_seq", "attempted", "node_ids"]
    every = long.select(cols).unionByName(inner.select(*cols[:5], plain("attempted"), plain("node_ids")))
    return every.filter(F.col("count") >= min_len).select("authored_by", "rule", rule_category("rule").alias("category"), *cols[2:])


# --- admission ----------------------------------------------------------------------------------------------
def admit_batch(log: DataFrame, batch: DataFrame, store: str, epoch: int) -> None:
    """Judge a micro-batch of proposed events against the log; keep the admitted and the refused apart."""
    from vidimus.operators.audit import admit

    admitted, refused = admit(log, batch)
    admitted.write.mode("overwrite").parquet(f"{store}/admitted/epoch={epoch}")
    if refused is not None:
        refused.write.mode("overwrite").parquet(f"{store}/refused/epoch={epoch}")
