"""Model calls: prompts as rows, a pluggable scorer that answers them, and what is made of the answers.

A scorer takes a table with a ``prompt`` and adds a ``response`` (null where the call failed), so a model can be a service
(``caller``), or one of the deterministic stand-ins below, which are column expressions and need no network.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.functions.intervals import clamp
from tidemark.functions.text import estimated_tokens, shorten
from tidemark.operators import editorial, folds, scoring, talk
from tidemark.operators.chunks import token_chunks
from tidemark.operators.editorial import Scorer
from tidemark.sources.shared import materialize

#: Tokens of a transcript that a model takes at once, and attempts of a call.
MOST_TOKENS, ATTEMPTS = 21000, 5
#: Times the wanted number that is asked for: by the whole run, by the analysis, by the first layer, and by a chunk of a
#: longer transcript (clips, moments).
OVER_RUN, OVER_ANALYSIS, OVER_LAYER, OVER_CHUNK, OVER_CHUNK_MOMENTS = 2, 2, 2.5, 2, 1.5
THOUGHT = "expanded_start double, expanded_end double, thought_summary string, confidence double"
LOOK = "refined_start double, refined_end double, standalone_score double, editor_notes string, rejection_reason string"
PACKAGE = "title string, description string, hashtags array<string>, thumbnail_time double"


def answer(call: Callable[[str], str], prompt: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int]:
    """The answer and the number of attempts. Only a rate limit is tried again, after the wait that its message asks for
    and one second, else twice two to the attempt; any other error, and the last attempt's, give no answer."""
    for k in range(attempts):
        try:
            return call(prompt), k + 1
        except Exception as e:  # noqa: BLE001 - whatever a service raises
            said = str(e)
            if "rate_limit_exceeded" not in said and "429" not in said:
                return None, k + 1
            asked = re.search(r"try again in (\d+\.?\d*)s", said)
            if k + 1 < attempts:
                sleep(float(asked[1]) + 1 if asked else 2.0 * 2**k)
    return None, attempts


def caller(call: Callable[[str], str], attempts: int = ATTEMPTS) -> Scorer:
    """A scorer that asks a service, one prompt at a time in each task; adds response and attempts. It is not asked again
    for a prompt of the same batch."""

    def score(df: DataFrame) -> DataFrame:
        at = df.columns.index("prompt")
        schema = StructType([*df.schema.fields, StructField("response", StringType()), StructField("attempts", LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prompts = batch.column(at).to_pylist()
                known = {p: answer(call, p, attempts) if p is not None else (None, 0) for p in dict.fromkeys(prompts)}
                own = [pa.array([known[p][k] for p in prompts], t) for k, t in ((0, pa.string()), (1, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "response", "attempts"])

        return df.mapInArrow(run, schema)

    return score


def usage(answered: DataFrame, layer: int) -> DataFrame:
    """layer, tokens_in and tokens_out of each answered prompt, estimated."""
    rows = answered.where("response IS NOT NULL")
    return rows.select(F.lit(layer).alias("layer"), estimated_tokens(F.col("prompt")).alias("tokens_in"), estimated_tokens(F.col("response")).alias("tokens_out"))


# Deterministic stand-ins: they read nothing but the prompt.


def _timed_lines(prompt: Column, every: int) -> Column:
    """Start seconds and length of the prompt's lines of which the length is a multiple."""
    picked = F.filter(F.split(prompt, "\n"), lambda x: (F.length(x) % every == 0) & x.rlike(r"^\[\d+:\d\d\] "))
    part = lambda x, k: F.regexp_extract(x, r"^\[(\d+):(\d\d)\]", k).cast("int")
    return F.transform(picked, lambda x: F.struct((part(x, 1) * 60 + part(x, 2)).alias("at"), F.length(x).alias("n")))


def stand_in(kind: str) -> Scorer:
    """A stand-in for a layer's model: clips, moments, thought, look, package or title. A prompt of a length divisible by eleven
    fails (clips and moments)."""
    p = F.col("prompt")
    n = F.length(p)
    if kind == "clips":
        body = F.to_json(F.transform(_timed_lines(p, 3), lambda x: F.struct(x["at"].alias("start_time"), (x["at"] + 15 + x["n"] % 40).alias("end_time"), F.concat(F.lit("clip at "), x["at"].cast("string")).alias("title"), F.concat(F.lit("line of "), x["n"].cast("string")).alias("reason"), (x["n"] * 7 % 100 / 100.0).alias("interest_score"), F.lit("talk").alias("content_type"))))
        reply = F.when(n % 11 != 0, body)
    elif kind == "moments":
        body = F.to_json(F.transform(_timed_lines(p, 4), lambda x: F.struct(x["at"].alias("rough_start"), (x["at"] + 10 + x["n"] % 30).alias("rough_end"), F.concat(F.lit("idea at "), x["at"].cast("string")).alias("core_idea"), F.lit("length").alias("why_interesting"), (x["n"] * 13 % 100 / 100.0).alias("interest_score"))))
        reply = F.when(n % 11 != 0, body)
    elif kind == "thought":
        reply = F.to_json(F.struct(F.greatest(F.col("rough_start") - n % 7, F.lit(0.0)).alias("expanded_start"), (F.col("rough_end") + n % 11).alias("expanded_end"), F.concat(F.lit("thought of "), n.cast("string")).alias("thought_summary"), (n % 100 / 100.0).alias("confidence")))
    elif kind == "look":
        reply = F.to_json(F.struct((F.col("start") + n % 5 - 2).alias("refined_start"), (F.col("end") + n % 7 - 3).alias("refined_end"), (n * 37 % 100 / 100.0).alias("standalone_score"), F.lit("notes").alias("editor_notes"), F.when(n % 3 == 0, "needs_context").alias("rejection_reason")))
    elif kind == "package":
        words = F.filter(F.split(p, " "), lambda w: w != "")
        reply = F.to_json(F.struct(p.alias("title"), F.concat(F.size(words).cast("string"), F.lit(" words")).alias("description"), F.transform(F.slice(words, 1, 7), lambda w: F.concat(F.lit("#"), w)).alias("hashtags"), (F.col("start") + n % 90 - 5).alias("thumbnail_time")))
    elif kind == "title":
        reply = F.concat(F.lit('"'), p, F.lit('"'))
    else:
        raise ValueError(f"no stand-in for {kind}")
    return lambda df: df.withColumn("response", reply)


# What is asked, and what is made of the answers.


def chunk_prompts(segments: DataFrame, budget: int = MOST_TOKENS) -> DataFrame:
    """video_id, chunk, chunks, prompt: the transcript lines of each chunk of at most ``budget`` tokens (one chunk where
    all of it fits)."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("seg_id")).cast("long")
    rows = segments.withColumn("place", place)
    chunks = token_chunks(talk.line_tokens(segments), budget)
    n = chunks.groupBy("video_id").agg(F.count("*").alias("chunks"))
    each = chunks.join(n, "video_id").withColumn("place", F.explode(F.sequence("first", "last"))).select("video_id", "chunk", "chunks", "place")
    lines = each.join(rows, ["video_id", "place"])
    return lines.groupBy("video_id", "chunk", "chunks").agg(talk.joined_text("place", talk.line(), "\n").alias("prompt"))


def _merged(found: DataFrame, threshold: float, n: int | None) -> DataFrame:
    """Of transcripts in one chunk all that was found, in order; of longer ones the best n after merging duplicates."""
    one = found.where("chunks = 1").withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("id")).cast("long"))
    many = scoring.top(folds.merge_duplicates(found.where("chunks > 1"), threshold).withColumn("tie", F.struct("start", "id")), "interest_score", n or 1 << 30, tie="tie").drop("tie")
    return one.unionByName(many)


def detect_clips(segments: DataFrame, ask: Scorer, n: int, least: float | None = None, most: float | None = None, budget: int = MOST_TOKENS) -> DataFrame:
    """video_id, rank, id, start, end, title, reason, interest_score, content_type: clips that a model finds."""
    answers = ask(chunk_prompts(segments, budget)).select("video_id", "chunk", "chunks", "response")
    rows = editorial.parse_clips(answers, least=least, most=most).withColumnRenamed("id", "name")
    rows = rows.withColumn("id", F.struct("chunk", F.substring("name", 6, 20).cast("long").alias("place"))).withColumnRenamed("start_time", "start").withColumnRenamed("end_time", "end")
    merged = _merged(rows, 0.7, n)
    name = F.when(F.col("chunks") == 1, F.col("name")).otherwise(F.format_string("clip_%03d", "rank"))
    return merged.select("video_id", "rank", name.alias("id"), "start", "end", "title", "reason", "interest_score", "content_type")


def detect_moments(segments: DataFrame, ask: Scorer, n: int, budget: int = MOST_TOKENS) -> DataFrame:
    """video_id, id (moment_001, ...), rough_start, rough_end, core_idea, interest_score, content_type."""
    answers = ask(chunk_prompts(segments, budget)).select("video_id", "chunk", "chunks", "response")
    rows = editorial.parse_moments(answers).withColumn("id", F.struct("chunk", "pos")).withColumnRenamed("rough_start", "start").withColumnRenamed("rough_end", "end")
    one = scoring.top(rows.where("chunks = 1"), "interest_score", 1 << 30)
    many = _merged(rows.where("chunks > 1"), 0.5, n)
    both = one.unionByName(many.select(*one.columns))
    return both.select("video_id", F.format_string("moment_%03d", "rank").alias("id"), F.col("start").alias("rough_start"), F.col("end").alias("rough_end"), "core_idea", "interest_score", "content_type")


def _read(df: DataFrame, schema: str, needed: list[str]) -> DataFrame:
    """The fields of answers; rows without a needed one drop out."""
    rows = df.withColumn("_r", F.from_json("response", schema)).select(*[c for c in df.columns if c not in ("prompt", "response")], "_r.*")
    return rows.dropna(subset=needed)


def expand(moments: DataFrame, segments: DataFrame, ask: Scorer, reach: float = 60.0) -> DataFrame:
    """moments with expanded_start, expanded_end, thought_summary, confidence; those without any text around drop out."""
    around = talk.context_window(moments.select("video_id", "id", F.col("rough_start").alias("start"), F.col("rough_end").alias("end")), segments, reach)
    asked = moments.join(around.withColumnRenamed("text", "prompt"), ["video_id", "id"])
    return _read(ask(asked), THOUGHT, ["expanded_start", "expanded_end", "thought_summary", "confidence"])


def expansion(thoughts: DataFrame) -> DataFrame:
    """Thoughts, and the mean of how much longer they are than their moments (a moment of no length does not count)."""
    ratio = F.try_divide(F.col("expanded_end") - F.col("expanded_start"), F.col("rough_end") - F.col("rough_start"))
    return thoughts.agg(F.count("*").alias("thoughts_analyzed"), F.avg(ratio).alias("avg_expansion_ratio"))


def _look(thoughts: DataFrame, segments: DataFrame, ask: Scorer, k: int, start: str, end: str) -> DataFrame:
    """One look at each thought: start_k, end_k, score_k, reason_k."""
    ranges = thoughts.select("video_id", "id", F.col(start).alias("start"), F.col(end).alias("end"))
    asked = ranges.join(talk.text_in(ranges, segments), ["video_id", "id"], "left").select("video_id", "id", "start", "end", F.coalesce("text", F.lit("")).alias("prompt"))
    said = _read(ask(asked), LOOK, ["standalone_score", "editor_notes"])
    said = said.select("video_id", "id", F.coalesce("refined_start", "start").alias(f"start_{k}"), F.coalesce("refined_end", "end").alias(f"end_{k}"), F.col("standalone_score").alias(f"score_{k}"), F.col("rejection_reason").alias(f"reason_{k}"))
    return thoughts.join(said, ["video_id", "id"])


def refine(thoughts: DataFrame, segments: DataFrame, ask: Scorer) -> DataFrame:
    """thoughts with two looks each, the second at the bounds that the first gave; the gate says which one counts. The
    first look is written once."""
    once = materialize(_look(thoughts, segments, ask, 1, "expanded_start", "expanded_end"), "looks")
    return _look(once, segments, ask, 2, "start_1", "end_1")


def package(passed: DataFrame, segments: DataFrame, ask: Scorer) -> DataFrame:
    """Clips with title (at most 60 characters), description, at most five hashtags, and a thumbnail time within the clip;
    those without text drop out. The layers' own results stay as structs. passed: as the gate gives them."""
    ranges = passed.withColumn("start", F.col("refined_start")).withColumn("end", F.col("refined_end"))
    asked = ranges.join(talk.text_in(ranges.select("video_id", "id", "start", "end"), segments).withColumnRenamed("text", "prompt"), ["video_id", "id"]).where("prompt <> ''")
    p = _read(ask(asked), PACKAGE, ["title", "description", "hashtags", "thumbnail_time"])
    return p.select(
        "video_id", "id", "start", "end", (F.col("end") - F.col("start")).alias("duration"), shorten(F.col("title"), 60).alias("title"), "description", F.slice("hashtags", 1, 5).alias("hashtags"), clamp(F.col("thumbnail_time"), F.col("start"), F.col("end")).alias("thumbnail_time"),
        "interest_score", "standalone_score", "content_type",
        F.struct("rough_start", "rough_end", "core_idea", "interest_score", "content_type").alias("layer1"), F.struct("expanded_start", "expanded_end", "thought_summary", "confidence").alias("layer2"), F.struct("refined_start", "refined_end", "standalone_score", "verdict").alias("layer3"),
    )


def four_layers(segments: DataFrame, n: int, least: float | None = None, most: float | None = None, ask: Callable[[str], Scorer] = stand_in, budget: int = MOST_TOKENS) -> DataFrame:
    """The n best clips of each video by the four layers, in the form of single-layer clips, with their metadata. Each
    layer's result is written once, as a model should not be asked again and the next layers read it more than once."""
    best = editorial.editorial(
        segments,
        detect=lambda s: materialize(detect_moments(s, ask("moments"), int(n * OVER_LAYER), budget), "moments"),
        expand=lambda m: materialize(expand(m, segments, ask("thought")), "thoughts"),
        refine=lambda t: refine(t, segments, ask("look")),
        package=lambda p: package(materialize(p, "passed"), segments, ask("package")),
        n=n, least=least, most=most,
    )
    return single_form(best)


def single_form(packaged: DataFrame) -> DataFrame:
    """Packaged clips as single-layer ones: numbered by rank, the description as reason, the rest as metadata."""
    more = F.struct("standalone_score", "hashtags", "thumbnail_time", "layer1", "layer2", "layer3")
    return packaged.select("video_id", "rank", F.format_string("clip_%03d", "rank").alias("id"), "start", "end", "duration", "title", F.col("description").alias("reason"), "interest_score", "content_type", more.alias("metadata"))
