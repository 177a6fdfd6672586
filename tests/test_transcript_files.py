import os

from pyspark.sql import functions as F

from tidemark.sources import files


def _segments(spark):
    text = " ".join(f"word{k % 7}" for k in range(3000))
    return spark.createDataFrame([(1, 0, 0.0, 3000.0, text), (1, 1, 3001.0, 3002.0, "a b"), (2, 0, 0.0, 1.0, "x")], "video_id long, seg_id long, start double, end double, text string")


def test_documents_are_written_packed_and_read_back(spark, tmp_path):
    docs = files.transcript_documents(_segments(spark))
    files.write_documents(docs, f"{tmp_path}/d")
    on_disk = sum(os.path.getsize(f"{tmp_path}/d/{n}") for n in os.listdir(f"{tmp_path}/d"))
    assert on_disk < docs.agg(F.sum(F.length("value"))).first()[0] / 4
    assert files.transcript_segments(files.read_transcripts(spark, f"{tmp_path}/d", lines=True)).count() == 3


def test_words_of_segments_need_no_rows_of_words(spark, tmp_path):
    words = lambda s: F.transform(F.split(s["text"], " "), lambda w, k: F.struct(w.alias("word"), (s["start"] + k).alias("start"), (s["start"] + k + 1).alias("end")))
    rows = _segments(spark).select("video_id", "seg_id", "start", F.posexplode(F.split("text", " ")).alias("k", "word"))
    rows = rows.select("video_id", (F.col("seg_id") * 100000 + F.col("k")).alias("word_idx"), "word", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + 1).alias("end"))
    one, other = files.transcript_documents(_segments(spark), words), files.transcript_documents(_segments(spark), rows)
    assert sorted(r.value for r in one.collect()) == sorted(r.value for r in other.collect())
