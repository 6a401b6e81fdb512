"""Reads over the log itself: refusals, streaks, model calls, runs, spend."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidimus import schemas
from vidimus.functions import text as tx
from vidimus.functions.frames import SPAN, carry_forward, latest_per, literal_map, running_total, tail

UNKNOWN_CALL_COST = 0.01


def rule_category(rule: Column | str) -> Column:
    """Category of a refusal rule name; a name nobody knows is `unclassified`."""
    rule = F.col(rule) if isinstance(rule, str) else rule
    return literal_map(schemas.RULE_CATEGORY, rule, "unclassified")


def refusals(ev: DataFrame, limit: int | None = None, run_id: str | None = None) -> DataFrame:
    """Refused writes, oldest first when limited to the newest `limit`."""
    field = lambda k, d: F.coalesce(F.get_json_object("detail", f"$.{k}"), F.lit(d)).alias(k)
    rows = ev.filter("event = 'refused'")
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    out = rows.select(
        "seq", "at", "authored_by", field("attempted", "unknown"), field("rule", "unknown"), field("message", ""),
        "node_id", "edge_id", "node_type", "edge_type", "model_call_id",
    )
    return out if limit is None else tail(out, "seq", limit)


def refusal_streaks(refused: DataFrame, min_len: int = 2, span: int = SPAN) -> DataFrame:
    """Runs of one rule within one author's own sequence (W1), longest first then by first seq.

    Change points come from a chunked carry of the previous rule and islands from a chunked running
    sum, so an author with most of the log is still spread over many tasks.
    """
    seen = carry_forward(refused, ["authored_by"], "seq", ["rule"], span)
    flagged = seen.withColumn(
        "_new", F.when(F.col("prev_rule").eqNullSafe(F.col("rule")), F.lit(0)).otherwise(F.lit(1))
    )
    islands = running_total(flagged, ["authored_by"], "seq", "_new", "_island", span)
    size = islands.groupBy("authored_by", "_island").agg(
        F.first("rule").alias("rule"), F.count(F.lit(1)).alias("count"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
    ).filter(F.col("count") >= min_len)

    def in_order(column: str, out: str) -> DataFrame:
        firsts = islands.filter(F.col(column).isNotNull()).groupBy("authored_by", "_island", column).agg(
            F.min("seq").alias("_s")
        )
        return firsts.groupBy("authored_by", "_island").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_s", column))), lambda x: x[column]).alias(out)
        )

    none = F.array().cast("array<string>")
    return (
        size.join(in_order("attempted", "attempted"), ["authored_by", "_island"], "left")
        .join(in_order("node_id", "node_ids"), ["authored_by", "_island"], "left")
        .select(
            "authored_by", "rule", rule_category("rule").alias("category"), "count", "first_seq", "last_seq",
            F.coalesce("attempted", none).alias("attempted"), F.coalesce("node_ids", none).alias("node_ids"),
        )
    )


def streak_totals(streaks: DataFrame) -> DataFrame:
    return streaks.agg(
        F.count(F.lit(1)).alias("streaks"), F.coalesce(F.sum("count"), F.lit(0)).alias("streaked_count"),
        F.coalesce(F.max("count"), F.lit(0)).alias("longest"),
    )


def refusal_census(refused: DataFrame) -> DataFrame:
    """Counts by rule, author, attempted write and category in one pass over the refusals (A4).

    `dimension, value, n, expressions`; a category that never fired is present with 0, so an empty
    log yields five zeros. The whole log is counted, never a tail.
    """
    tagged = refused.select(
        "rule", F.col("authored_by").alias("author"), "attempted", rule_category("rule").alias("category")
    )
    dims = ["rule", "author", "attempted", "category"]
    long = tagged.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])).alias("d")
    ).select("d.*")
    counted = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    every = refused.sparkSession.createDataFrame(
        [("category", c, 0) for c in schemas.REFUSAL_CATEGORIES], "dimension STRING, value STRING, n BIGINT"
    )
    return counted.unionByName(every).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def census_summary(refused: DataFrame) -> DataFrame:
    """Total, share that may indict the tools, first and last time (A4)."""
    return refused.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(rule_category("rule") == "expression").alias("expression_count"),
        F.min_by("at", "seq").alias("first_at"), F.max_by("at", "seq").alias("last_at"),
    )


def model_call_summary(ev: DataFrame, by_run: bool = False) -> DataFrame:
    """Calls, tokens, latency and cost, nulls counted as zero (A3)."""
    calls = ev.filter("event = 'model_call'")
    total = lambda c, out: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(out)
    aggs = [
        F.count(F.lit(1)).alias("calls"), total("input_tokens", "total_input_tokens"),
        total("output_tokens", "total_output_tokens"), total("latency_ms", "total_latency_ms"),
        total("cost_usd", "total_cost_usd"),
    ]
    return calls.groupBy("run_id").agg(*aggs) if by_run else calls.agg(*aggs)


def run_history(ev: DataFrame, limit: int | None = None) -> DataFrame:
    """Every run: roster, budget, events, refusals, how it ended; open runs keep null ends (A5).

    The start that counts is the last one logged for the id, and the finish the last one after it.
    """
    run = F.when(
        F.col("event").isin("run_started", "run_finished"),
        F.coalesce("run_id", F.get_json_object("detail", "$.run_id"), F.lit("")),
    ).otherwise(F.col("run_id"))
    rows = ev.withColumn("_run", run).filter("_run IS NOT NULL")
    d = lambda k: F.get_json_object("detail", f"$.{k}")
    started, finished = F.col("event") == "run_started", F.col("event") == "run_finished"
    folded = rows.groupBy("_run").agg(
        F.max_by(
            F.struct("seq", "at", d("agents").alias("agents"), d("budget_usd").cast("double").alias("budget_usd"), d("question_id").alias("question_id")),
            F.when(started, F.col("seq")),
        ).alias("s"),
        F.max_by(
            F.struct("seq", "at", d("state").alias("state"), d("spent_usd").cast("double").alias("spent_usd"),
                     d("calls").cast("bigint").alias("calls"), d("error").alias("error")),
            F.when(finished, F.col("seq")),
        ).alias("f"),
        F.count_if(F.col("run_id").isNotNull()).alias("events"),
        F.count_if((F.col("event") == "refused") & F.col("run_id").isNotNull()).alias("refusals"),
    ).filter("s.seq IS NOT NULL")
    done = F.col("f.seq") > F.col("s.seq")
    out = folded.select(
        F.col("_run").alias("run_id"), F.col("s.at").alias("started_at"), "s.question_id",
        F.when(done, F.col("f.at")).alias("finished_at"), F.when(done, F.col("f.state")).alias("state"),
        "s.agents", "s.budget_usd", F.when(done, F.col("f.spent_usd")).alias("spent_usd"),
        F.when(done, F.coalesce("f.calls", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("calls"),
        "events", "refusals", F.when(done, F.col("f.error")).alias("error"),
    )
    return out if limit is None else out.orderBy(F.desc("started_at"), "run_id").limit(limit)


def tool_calls(ev: DataFrame) -> DataFrame:
    """Tool actions with their results; pending when none came back."""
    d = lambda k: F.get_json_object("detail", f"$.{k}")
    acts = ev.filter("event = 'tool_action'").select(
        "seq", "run_id", F.col("authored_by").alias("agent_id"), d("tool").alias("tool"), d("reason").alias("reason"), d("args").alias("args")
    )
    results = ev.filter("event = 'tool_result'").select(
        d("action_seq").cast("bigint").alias("action_seq"), "seq",
        d("is_error").cast("boolean").alias("is_error"), d("result").alias("result"),
    ).filter("action_seq IS NOT NULL")
    last = latest_per(results, ["action_seq"], ["seq"]).drop("seq")
    return acts.join(last, acts.seq == last.action_seq, "left").select(
        "run_id", "agent_id", "seq", "tool", "reason", "args",
        F.col("action_seq").isNull().alias("pending"), "is_error", "result",
    )


def last_analysis(ev: DataFrame) -> DataFrame:
    return ev.filter("event = 'analysis' AND run_id IS NOT NULL").groupBy(
        "run_id", F.col("authored_by").alias("agent_id")
    ).agg(F.max_by(F.get_json_object("detail", "$.text"), "seq").alias("analysis"))


def run_activity(ev: DataFrame) -> DataFrame:
    """Per run and agent: numbered tool calls with outcome counts, and the last analysis."""
    calls = tool_calls(ev).filter("run_id IS NOT NULL")
    per = calls.groupBy("run_id", "agent_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("pending").alias("pending"),
        F.count_if(F.coalesce("is_error", F.lit(False))).alias("errors"),
        F.max_by("tool", "seq").alias("last_tool"),
    )
    return per.join(last_analysis(ev), ["run_id", "agent_id"], "full_outer")


# The result fields an activity summary keeps.
KEPT_RESULT_FIELDS = (
    "uid", "uid_a", "uid_b", "nearest_unit_tally", "longest_shared_run", "witnesses", "passages",
    "withheld_extra", "margin", "first", "second", "ref", "start", "end", "total_characters",
    "returned", "limit", "order", "id", "type", "status", "authorship", "created_by",
)


def activity_summary(calls: DataFrame) -> DataFrame:
    """Results reduced to a fixed list of fields; hits become references and windows the neighbour
    ids (P14). Text excerpts are dropped."""
    r = lambda k: F.get_json_object("result", f"$.{k}")
    hits = F.transform(F.from_json(r("hits"), "array<struct<ref:string>>"), lambda h: h["ref"])
    shown = F.from_json(r("shown"), "array<struct<neighbors:array<struct<uid:string>>>>")
    near = F.flatten(F.transform(shown, lambda w: F.transform(w["neighbors"], lambda n: n["uid"])))
    kept = F.map_filter(
        F.create_map(*[x for k in KEPT_RESULT_FIELDS for x in (F.lit(k), r(k))]), lambda _, v: v.isNotNull()
    )
    return calls.select("run_id", "agent_id", "seq", "tool", "pending", "is_error", kept.alias("kept"), hits.alias("hit_refs"), near.alias("neighbour_uids"))


def spend_steps(ev: DataFrame, budget: float | None, default: float = UNKNOWN_CALL_COST, span: int = SPAN) -> DataFrame:
    """Running spend per run; unpriced calls are charged a fixed amount."""
    calls = ev.filter("event = 'model_call' AND run_id IS NOT NULL").select(
        "run_id", "seq", F.coalesce("cost_usd", F.lit(default)).alias("charged"),
        F.col("cost_usd").isNotNull().alias("cost_reported"),
    )
    steps = running_total(calls, ["run_id"], "seq", "charged", "spent", span)
    return steps.withColumn("over", F.col("spent") >= F.lit(budget) if budget is not None else F.lit(False))


def spend(ev: DataFrame, budget: float | None, default: float = UNKNOWN_CALL_COST, span: int = SPAN) -> DataFrame:
    """Spend totals per run: calls, unpriced calls, what remains, and the first call at which the
    budget is used up (A12)."""
    if budget is not None and budget <= 0:
        raise ValueError(f"budget must be positive, got {budget}")
    steps = spend_steps(ev, budget, default, span)
    out = steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("cost_reported")).alias("unpriced_calls"),
        F.sum("charged").alias("spent_usd"), F.min(F.when(F.col("over"), F.col("seq"))).alias("exhausted_at_seq"),
    )
    left = F.lit(None).cast("double") if budget is None else F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("spent_usd"))
    return out.withColumn("remaining_usd", left)


def roster_clashes(ev: DataFrame) -> DataFrame:
    """Runs whose roster has two or more agents of one model family."""
    rosters = ev.filter("event = 'run_started'").select(
        F.coalesce("run_id", F.get_json_object("detail", "$.run_id")).alias("run_id"), "seq",
        F.get_json_object("detail", "$.agents").alias("agents"),
    )
    latest = latest_per(rosters, ["run_id"], ["seq"])
    agents = latest.select(
        "run_id", F.explode(F.from_json("agents", "array<struct<agent_id:string,model:string>>")).alias("a")
    ).select("run_id", F.col("a.agent_id").alias("agent_id"), tx.model_family("a.model").alias("family"))
    return (
        agents.distinct().groupBy("run_id", "family")
        .agg(F.count(F.lit(1)).alias("agents"), F.array_sort(F.collect_list("agent_id")).alias("agent_ids"))
        .filter("agents > 1")
    )


def threads(ev: DataFrame, marker: str) -> DataFrame:
    """One run per conversation: the one with most messages, the later one on a tie.

    `marker` is the line that opens a stored context in the analyst's instructions. A context counts
    only as version 1 with a list of messages that each have a role and a content; any other is none.
    """
    analysts = ev.filter("event = 'run_started'").select(
        F.coalesce("run_id", F.get_json_object("detail", "$.run_id")).alias("run_id"), "seq",
        F.from_json(
            F.get_json_object("detail", "$.agents"), "array<struct<role:string,instructions:string>>"
        ).alias("agents"),
    )
    first = F.try_element_at(F.filter("agents", lambda a: a["role"] == "analyst"), F.lit(1))["instructions"]
    ctx = F.regexp_extract(F.coalesce(first, F.lit("")), rf"(?s)^\Q{marker}\E\n(\{{.*?\}})\n\n", 1)
    said = F.from_json(F.get_json_object("ctx", "$.messages"), "array<struct<role:string,content:string>>")
    whole = F.forall(said, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    n = F.when((F.get_json_object("ctx", "$.version") == "1") & whole, F.size(said))
    rows = analysts.select("run_id", "seq", ctx.alias("ctx")).select(
        F.coalesce(F.get_json_object("ctx", "$.conversation_id"), F.col("run_id")).alias("conversation_id"),
        "run_id", "seq", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias("messages"),
    )
    return latest_per(rows, ["conversation_id"], ["messages", "seq"]).drop("seq")


def inquiry_runs(recorded: DataFrame, in_memory: DataFrame, current: DataFrame) -> DataFrame:
    """Run lists merged by id with the later source winning; runs of analysts only are left out."""
    from vidimus.functions.frames import merge_histories

    merged = merge_histories([recorded, in_memory, current])
    roles = F.transform(F.from_json("agents", "array<struct<role:string>>"), lambda a: a["role"])
    # no agents at all also counts as "every agent is an analyst"
    only = F.forall(F.coalesce(roles, F.array().cast("array<string>")), lambda r: F.coalesce(r == "analyst", F.lit(False)))
    return merged.filter(~only)


def activity_overlay(ev: DataFrame) -> DataFrame:
    """Units a worker touched, from recorded tool results only (G15): one row per run, agent, unit and
    action, in call order."""
    calls = tool_calls(ev).filter("NOT pending AND run_id IS NOT NULL")
    a = lambda k: F.get_json_object("args", f"$.{k}")
    r = lambda k: F.get_json_object("result", f"$.{k}")
    failed = F.coalesce("is_error", F.lit(False))
    one = lambda uid, kind: F.array(F.struct(uid.alias("uid"), kind.alias("kind")))
    none = F.array().cast("array<struct<uid:string,kind:string>>")
    near = F.flatten(F.transform(
        F.from_json(r("shown"), "array<struct<neighbors:array<struct<uid:string>>>>"),
        lambda w: F.transform(w["neighbors"], lambda n: n["uid"]),
    ))
    tally = F.transform(F.from_json(r("nearest_unit_tally"), "array<array<string>>"), lambda t: F.get(t, F.lit(0)))
    empty = F.array().cast("array<string>")
    cands = F.array_distinct(F.concat(F.coalesce(tally, empty), F.coalesce(near, empty)))
    cited = F.from_json(r("witnesses"), "array<string>")
    units = (
        F.when(
            F.col("tool") == "semantic_neighbors",
            F.concat(
                one(a("uid"), F.when(failed, F.lit("search failed")).otherwise(F.lit("similarity search"))),
                F.when(failed, none).otherwise(
                    F.transform(cands, lambda u: F.struct(u.alias("uid"), F.lit("candidate returned").alias("kind")))
                ),
            ),
        )
        .when(
            F.col("tool") == "align_passages",
            F.transform(
                F.array_distinct(F.array(a("uid_a"), a("uid_b"))),
                lambda u: F.struct(u.alias("uid"), F.when(failed, F.lit("comparison failed")).otherwise(F.lit("wording compared")).alias("kind")),
            ),
        )
        .when(
            F.col("tool") == "attribution_evidence",
            one(a("uid"), F.when(failed, F.lit("calculation failed")).otherwise(F.lit("vocabulary compared"))),
        )
        .when(
            (F.col("tool") == "find_attestations") & ~failed,
            F.transform(
                F.coalesce(cited, empty),
                lambda w: F.struct(F.regexp_replace(w, "^witness:", "").alias("uid"), F.lit("citation recorded").alias("kind")),
            ),
        )
        .otherwise(none)
    )
    return (
        calls.withColumn("u", F.explode(units)).filter("u.uid IS NOT NULL AND u.uid <> ''")
        .select("run_id", "agent_id", "u.uid", "seq", "u.kind", "reason")
    )


def overlay_units(overlay: DataFrame) -> DataFrame:
    """Nodes of the overlay: actions per run, agent and unit."""
    return overlay.groupBy("run_id", "agent_id", "uid").agg(
        F.count(F.lit(1)).alias("actions"), F.min("seq").alias("first_seq"), F.max_by("kind", "seq").alias("last_kind")
    )
