"""The layered editorial run behind a pluggable scorer: parsing, quality gate, packaging, costs, stage states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.display import error_summary

#: A scorer adds a layer's columns to a table; a model call is a mapInPandas behind the same signature.
Scorer = Callable[[DataFrame], DataFrame]

CLIPS = "array<struct<start_time:double,end_time:double,title:string,reason:string,interest_score:double,content_type:string>>"
MOMENTS = "array<struct<rough_start:string,rough_end:string,core_idea:string,why_interesting:string,interest_score:string,content_type:string>>"
PASS, REVISE, MOVE = 0.7, 0.4, 15.0
#: Dollars for a million tokens in and out, by layer.
PRICES = ((1, 2.50, 10.00), (2, 2.50, 10.00), (3, 0.15, 0.60), (4, 0.15, 0.60))


def parse_clips(df: DataFrame, column: str = "response", least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows of a model's clip list: those with times and a title and of a valid length; ids by position in the list."""
    rows = df.select(*[c for c in df.columns if c != column], F.posexplode(F.from_json(column, CLIPS)).alias("pos", "c"))
    length = F.col("c.end_time") - F.col("c.start_time")
    ok = F.col("c.start_time").isNotNull() & F.col("c.end_time").isNotNull() & F.col("c.title").isNotNull() & (length >= 8.0)
    ok = ok & (length >= least) if least is not None else ok
    ok = ok & (length <= most) if most is not None else ok
    kept = [c for c in df.columns if c != column]
    return rows.where(ok).select(*kept, F.format_string("clip_%03d", F.col("pos") + 1).alias("id"), "c.start_time", "c.end_time", length.alias("duration"), "c.title", F.coalesce("c.reason", F.lit("")).alias("reason"), F.coalesce("c.interest_score", F.lit(0.5)).alias("interest_score"), F.coalesce("c.content_type", F.lit("general")).alias("content_type"))


def parse_moments(df: DataFrame, column: str = "response") -> DataFrame:
    """Rows of a model's moment list whose five fields can all be read."""
    kept = [c for c in df.columns if c != column]
    rows = df.select(*kept, F.posexplode(F.from_json(column, MOMENTS)).alias("pos", "m"))
    number = lambda c: F.col(f"m.{c}").try_cast("double").alias(c)
    out = rows.select(*kept, F.col("pos").cast("long").alias("pos"), number("rough_start"), number("rough_end"), "m.core_idea", "m.why_interesting", number("interest_score"), F.coalesce("m.content_type", F.lit("general")).alias("content_type"))
    return out.dropna(subset=["rough_start", "rough_end", "core_idea", "why_interesting", "interest_score"])


def gate(thoughts: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Verdict, reason and bounds of each thought after at most two looks.

    thoughts: expanded_start, expanded_end and, for looks 1 and 2, start_k, end_k, score_k, reason_k. A limit of 0 counts
    as none. Rejected thoughts keep the bounds that they were looked at with.
    """

    def too(k: int) -> Column:
        length = F.col(f"end_{k}") - F.col(f"start_{k}")
        short = length < least if least else F.lit(False)
        return short | (length > most) if most else short

    moved = (F.abs(F.col("expanded_start") - F.col("start_1")) > MOVE) | (F.abs(F.col("expanded_end") - F.col("end_1")) > MOVE)
    out = lambda verdict, reason, bounds: F.struct(F.lit(verdict).alias("verdict"), reason.cast("string").alias("rejection_reason"), (F.col("expanded_start") if bounds == 0 else F.col(f"start_{bounds}")).cast("double").alias("refined_start"), (F.col("expanded_end") if bounds == 0 else F.col(f"end_{bounds}")).cast("double").alias("refined_end"), F.col("score_1" if look == 1 else "score_2").cast("double").alias("standalone_score"))
    none, timing = F.lit(None), F.lit("duration_constraint")
    look = 2
    second = F.when(too(2), out("REJECT", timing, 1)).when(F.col("score_2") >= PASS, out("PASS", none, 2)).when(F.col("score_2") >= REVISE, out("REVISE", none, 2)).otherwise(out("REJECT", F.col("reason_2"), 1))
    look = 1
    first = F.when(too(1), out("REJECT", timing, 0)).when(F.col("score_1") >= PASS, out("PASS", none, 1)).when(F.col("score_1") < REVISE, out("REJECT", F.col("reason_1"), 0)).when(moved, out("REJECT", F.coalesce("reason_1", F.lit("structural_issue")), 0)).otherwise(second)
    return thoughts.withColumn("_v", first).select(*thoughts.columns, "_v.*")


def gate_stats(gated: DataFrame) -> DataFrame:
    """Verdict counts, pass rate, and how many of those that pass or nearly pass kept their bounds."""
    same = (F.col("verdict") == "PASS") & (F.col("refined_start") == F.col("expanded_start")) & (F.col("refined_end") == F.col("expanded_end"))
    n = {v: F.count_if(F.col("verdict") == v) for v in ("PASS", "REVISE", "REJECT")}
    return gated.agg(n["PASS"].alias("passed"), n["REVISE"].alias("revised"), n["REJECT"].alias("rejected"), F.count_if(same).alias("no_changes_needed"), F.try_divide(n["PASS"], F.count("*")).alias("pass_rate"), F.try_divide(F.count_if(same), n["PASS"] + n["REVISE"]).alias("boundary_quality_rate"))


def editorial(df: DataFrame, detect: Scorer, expand: Scorer, refine: Scorer, package: Scorer, n: int, least: float | None = None, most: float | None = None) -> DataFrame:
    """Detect, expand, refine, gate, package what passes, and the n best of each video by 0.6 interest + 0.4 quality."""
    passed = gate(refine(expand(detect(df))), least, most).where("verdict = 'PASS'")
    return best(package(passed), n)


def best(df: DataFrame, n: int) -> DataFrame:
    score = 0.6 * F.col("interest_score") + 0.4 * F.col("standalone_score")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(score.desc(), "id")).cast("long")
    return df.withColumn("weighted", score).withColumn("rank", rank).where(F.col("rank") <= n)


def costs(usage: DataFrame) -> DataFrame:
    """Calls, tokens and dollars of each layer. usage: layer, tokens_in, tokens_out. Prices are four rows."""
    prices = usage.sparkSession.createDataFrame(list(PRICES), "layer int, price_in double, price_out double")
    sums = usage.groupBy("layer").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return sums.join(F.broadcast(prices), "layer").select("layer", "calls", "tokens_in", "tokens_out", (F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")).alias("dollars"))


def stage_states(events: DataFrame) -> DataFrame:
    """Status and progress of each stage of a run after all its updates. events: run, at, seq, stage, progress and, if
    there is one, failed.

    A stage's first update starts it and is not recorded; starting a stage completes the one before if it still runs;
    an update of 100 or more completes; progress is kept within 0 and 100. A failing update changes no progress and starts
    nothing; the stage stays failed until an update of 100 or more.
    """
    failed = F.coalesce("failed", F.lit(False)) if "failed" in events.columns else F.lit(False)
    e = events.withColumn("failed", failed)
    first = F.row_number().over(Window.partitionBy("run", "stage", "failed").orderBy("at", "seq"))
    order = F.row_number().over(Window.partitionBy("run").orderBy("at", "seq"))
    e = e.withColumn("k", first).withColumn("o", order)
    update = ~F.col("failed") & (F.col("k") > 1)
    later = F.when(update, F.struct("o", F.least(F.greatest("progress", F.lit(0.0)), F.lit(100.0)).alias("p")))
    done, fault = F.when(update & (F.col("progress") >= 100), F.col("o")), F.when(F.col("failed"), F.col("o"))
    s = e.groupBy("run", "stage").agg(F.min(F.when(~F.col("failed"), F.col("o"))).alias("started"), F.max(later).alias("last"), F.min(done).alias("done"), F.max(done).alias("done_last"), F.min(fault).alias("fault"), F.max(fault).alias("fault_last"))
    s = s.withColumn("next", F.when(F.col("started").isNotNull(), F.lead("started").over(Window.partitionBy("run").orderBy(F.col("started").asc_nulls_last()))))
    before = lambda c: F.col(c).isNotNull() & (F.col(c) < F.col("next"))
    closed = F.col("next").isNotNull() & ~before("done") & ~before("fault")
    bad = F.col("fault_last").isNotNull() & (F.col("done_last").isNull() | (F.col("done_last") < F.col("fault_last")))
    progress = F.when(closed & (F.col("last").isNull() | (F.col("last.o") < F.col("next"))), 100.0).otherwise(F.coalesce("last.p", F.lit(0.0)))
    status = F.when(bad, "failed").when(closed | F.col("done").isNotNull(), "completed").otherwise("in_progress")
    return s.select("run", "stage", status.alias("status"), progress.alias("progress"))


def run_progress(states: DataFrame) -> DataFrame:
    """run, overall (completed stages as a part of all, in per cent), failed (stages), summary of these by name."""
    rows = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.struct("stage", F.concat(F.lit("stopped at "), F.floor("progress").cast("string"), F.lit("%")).alias("said")))))
    g = states.groupBy("run").agg((F.count_if(F.col("status") == "completed") / F.count("*") * 100).alias("overall"), rows.alias("xs"))
    return g.select("run", "overall", F.size("xs").alias("failed"), error_summary(F.transform("xs", lambda x: x["stage"]), F.transform("xs", lambda x: x["said"])).alias("summary"))
