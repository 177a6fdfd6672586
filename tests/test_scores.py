from tidemark.operators import reports, scoring


def test_rank_by_rounded_score_takes_a_half_as_a_half(spark):
    rows = spark.createDataFrame([(1, 1, 0.54), (1, 0, 0.5349999999999999), (1, 2, float("nan")), (1, 3, 1e12)], "video_id long, id long, combined double")
    got = {r.id: (r.combined, r["rank"]) for r in scoring.ranked_scores(rows).collect()}
    assert got[0] == (0.54, 3) and got[1] == (0.54, 4) and got[3] == (1e12, 2) and got[2][1] == 1


def test_means_at_a_half_do_not_hang_on_the_order_of_rows(spark):
    scores = [0.65, 0.85, 0.8, 0.55]  # a mean of 0.7125, in floating point 0.7124999999999999 in this order
    rows = [(v, i, s, s, 0.0, False) for v, order in ((1, scores), (2, scores[::-1]), (3, sorted(scores))) for i, s in enumerate(order)]
    scored = spark.createDataFrame(rows, "video_id long, id long, interest_score double, hybrid_score double, energy_boost double, has_high_energy boolean").coalesce(1)
    stats = scoring.hybrid_stats(scored, spark.createDataFrame([], "video_id long")).collect()
    assert {(r.avg_ai_score, r.avg_hybrid_score, r.avg_energy_boost) for r in stats} == {(0.713, 0.713, 0.0)}


def test_report_lines_take_a_half_as_a_half(spark):
    clips = spark.createDataFrame([(1, 1, "a", 0.0, 24.0, 0.5, 0.5344999999999999, True, 1, 0.5, 0.25)], "video_id long, rank long, title string, start double, end double, interest_score double, hybrid_score double, has_high_energy boolean, overlapping_segments long, max_energy double, overlap_ratio double")
    stats = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5, 0)], "video_id long, total_ai_clips long, total_hybrid_clips long, total_energy_segments long, clips_with_high_energy long, clips_with_energy_boost long, avg_ai_score double, avg_hybrid_score double, avg_energy_boost double, max_hybrid_score double, ranking_changes long")
    lines = [r.line for r in reports.hybrid_report(clips, stats).collect()]
    assert "      Hybrid Score: 0.535 (+6.9%)" in lines
