import random

from pyspark.sql import functions as F

from tidemark.operators import pipelines, talk


def _whole_tables(spark):
    rnd = random.Random(5)
    segs = [(v, i, s := rnd.uniform(-900, 3000), s + rnd.choice([0, 3, 70, 900]), f"t{v}.{i} ") for v in (1, 2) for i in range(300)]
    asks = [(v, i, s := rnd.uniform(-900, 3000), s + rnd.choice([0, 5, 120, 1500])) for v in (1, 2, 3) for i in range(120)]
    ranges = spark.createDataFrame(asks, "video_id long, id long, start double, end double")
    return segs, asks, ranges, spark.createDataFrame(segs, "video_id long, seg_id long, start double, end double, text string")


def test_texts_of_ranges_equal_all_pairs(spark):
    segs, asks, ranges, segments = _whole_tables(spark)
    for contained in (False, True):
        want = {}
        for v, i, s, e in asks:
            hit = [x.strip() for w, _, a, b, x in segs if w == v and a < e and s < b and (not contained or (a >= s and b <= e))]
            if hit:
                want[v, i] = " ".join(hit)
        got = {(r.video_id, r.id): r.text for r in talk.text_in(ranges, segments, contained).collect()}
        assert got == want


def test_no_pair_of_range_and_text_is_shuffled(spark):
    """A text meets its stretch's ranges as one row: the join of ranges lies above the grouping, not below it."""
    _, _, ranges, segments = _whole_tables(spark)
    plan = talk.text_in(ranges, segments)._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.strip(" :+-|") for x in plan.splitlines()]
    assert next(i for i, x in enumerate(lines) if x.startswith("Join")) < next(i for i, x in enumerate(lines) if x.startswith("Aggregate"))


def test_titles_are_cut_before_they_are_joined(spark):
    segments = spark.createDataFrame([(1, i, i * 10.0, i * 10.0 + 9, f"{'long ' * 30}{i}.") for i in range(9)], "video_id long, seg_id long, start double, end double, text string")
    clips = segments.selectExpr("video_id", "seg_id AS id", "start + 1 AS start", "start + 30 AS end", "'old' AS title")
    said = pipelines.align_all(clips, segments, retitle=lambda rows: rows.withColumn("response", F.col("prompt")))
    plan = said.select("video_id", "id", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert "..." not in plan[: plan.index("Join ")]
    assert {len(r.title) for r in said.collect()} == {60}
