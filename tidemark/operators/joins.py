"""Interval and as-of joins, keyed by video.

A range condition alone would be a nested-loop join, and one key a hot task; both sides are therefore cut into time bins
and joined on (video, bin), and a pair counts only in the bin where its common part begins. Running values over a video's
rows are two-level: over its bins (a row each), then inside each bin, so no task sorts a whole video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.intervals import overlaps


#: An interval with a far or wrong end would be copied into very many bins; beyond so many it is refused.
MOST_BINS = 100_000


def bins(start: Column, end: Column, width: float) -> Column:
    """The bins of an interval (none of one that ends before it begins, or is null)."""
    first, last = F.floor(start / width), F.floor(end / width)
    checked = F.when(last - first > MOST_BINS, F.raise_error(F.format_string(f"interval %s to %s has more than {MOST_BINS} bins of {width}", start.cast("string"), end.cast("string"))).cast("bigint")).otherwise(last)
    return F.explode(F.when(last >= first, F.sequence(first, checked)))


def overlap_join(left: DataFrame, right: DataFrame, width: float, inclusive: bool = False) -> DataFrame:
    """Pairs of overlapping intervals of one video. left: video_id, start, end, ...; right: video_id, r_start, r_end, ..."""
    a = left.withColumn("_bin", bins(F.col("start"), F.col("end"), width))
    b = right.withColumn("_bin", bins(F.col("r_start"), F.col("r_end"), width))
    begins = F.col("_bin") == F.floor(F.greatest("start", "r_start") / width)
    meet = (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) if inclusive else overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    return a.join(b, ["video_id", "_bin"]).where(begins & meet).drop("_bin")


def asof(left: DataFrame, right: DataFrame, at: str, time: str, payload: list[str], prefix: str, forward: bool = False, within: float | None = None, width: float = 600.0) -> DataFrame:
    """left with the payload of right's nearest row at or before ``at`` (after, if forward) within a distance; of equal
    times the smallest payload. Linear however many rows match, and a long video is many keys: within a distance, rows
    meet in its bin or the one beside; without one, the last row of each bin is carried on over the bins."""
    back = -1 if forward else 1
    size = within if within else width
    one = right.groupBy("video_id", F.col(time).alias("_t")).agg(F.min(F.struct(*payload)).alias("_p"))
    one = one.where("_t IS NOT NULL").withColumn("_bin", F.floor(F.col("_t") / size))
    order = F.col("_t").desc() if forward else F.col("_t")
    if within is None:
        end = F.max_by if not forward else F.min_by
        last = one.groupBy("video_id", "_bin").agg(end(F.struct(F.col("_t").alias("t"), F.col("_p").alias("p")), "_t").alias("_far"))
        step = Window.partitionBy("video_id").orderBy(F.col("_bin").desc() if forward else F.col("_bin")).rowsBetween(Window.unboundedPreceding, -1)
        asked = left.select("video_id", F.floor(F.col(at) / size).alias("_bin")).distinct()
        far = asked.join(last, ["video_id", "_bin"], "full").withColumn("_carried", F.last("_far", ignorenulls=True).over(step)).select("video_id", "_bin", "_carried")
        both = one.withColumn("_near", F.lit(0))
    else:
        both = one.withColumn("_bin", F.explode(F.array("_bin", F.col("_bin") + back)))
    names = left.columns
    probes = left.withColumn("_t", F.col(at).cast("double")).withColumn("_bin", F.floor(F.col(at) / size)).withColumn("_p", F.lit(None).cast(one.schema["_p"].dataType)).withColumn("_left", F.lit(True))
    both = probes.unionByName(both.withColumn("_left", F.lit(False)).drop("_near"), allowMissingColumns=True)
    found = F.struct(F.col("_t").alias("t"), F.col("_p").alias("p"))
    window = Window.partitionBy("video_id", "_bin").orderBy(order, "_left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_hit", F.last(F.when(~F.col("_left"), found), ignorenulls=True).over(window)).where("_left")
    if within is None:
        out = out.join(far, ["video_id", "_bin"], "left").withColumn("_hit", F.coalesce("_hit", "_carried"))
        near = F.col("_hit").isNotNull()
    else:
        near = F.abs(F.col("_hit.t") - F.col(at)) <= within
    picked = [F.when(near, F.col("_hit.t")).alias(f"{prefix}_time"), *(F.when(near, F.col(f"_hit.p.{c}")).alias(f"{prefix}_{c}") for c in payload)]
    return out.select(*names, *picked)


def running_max(df: DataFrame, order: list[str], value: Column, out: str, width: float, key: str = "video_id") -> DataFrame:
    """df with the largest value among the key's rows before each row. order: a time and tie-breaking columns."""
    rows = df.withColumn("_v", value).withColumn("_bin", F.floor(F.col(order[0]) / width))
    over = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy(key, "_bin").agg(F.max("_v").alias("_most")).withColumn("_earlier", F.max("_most").over(over)).drop("_most")
    inside = Window.partitionBy(key, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_here", F.max("_v").over(inside)).join(earlier, [key, "_bin"])
    return both.withColumn(out, F.greatest("_here", "_earlier")).select(*df.columns, out)


def islands(df: DataFrame, order: list[str], end: Column, apart: float = 0.0, width: float = 600.0) -> DataFrame:
    """df with ``island``: the time at which a run of rows begins that nothing before reaches (by ``apart`` or more)."""
    start = F.col(order[0])
    rows = running_max(df, order, end, "_reach", width)
    new = F.col("_reach").isNull() | (start - F.col("_reach") >= apart)
    rows = running_max(rows.withColumn("_first", F.when(new, start)), order, F.col("_first"), "_before", width)
    return rows.withColumn("island", F.coalesce("_first", "_before")).drop("_reach", "_first", "_before")
