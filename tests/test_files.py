"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from answerloom.sources import readers, sinks
from answerloom.streaming import running


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_annotation_shapes(spark, tmp_path):
    rows = [{"file_name": "a.mp4", "aggressor": ["x", "y"], "victim": 3}, {"file_name": "b.mp4", "aggressor": "z"}]
    listed = readers.read_annotations(spark, put(tmp_path / "l.json", rows)).collect()
    wrapped = readers.read_annotations(spark, put(tmp_path / "w.json", {"annotations": rows})).collect()
    single = readers.read_annotations(spark, put(tmp_path / "s.json", rows[0])).collect()
    assert [r.file_name for r in listed] == ["a.mp4", "b.mp4"] == [r.file_name for r in wrapped]
    assert (listed[0].aggressor, listed[0].victim, single[0].aggressor) == ('["x", "y"]', "3", '["x", "y"]')
    with pytest.raises(PySparkException):
        readers.read_annotations(spark, put(tmp_path / "e.json", {"other": 1})).collect()


def test_nested_annotations(spark, tmp_path):
    path = put(tmp_path / "n.json", [[{"file_name": "a"}], "x", 5, {"file_name": "b"}, [{"file_name": "c"}, 7]])
    assert sorted(r.file_name for r in readers.read_nested_annotations(spark, path).collect()) == ["a", "b", "c"]


def test_bank_forms(spark, tmp_path):
    q = {"video_name": "v", "question_type": "primary_action", "prompt": "p", "answers": ["a", "b"], "correct_index": 1}
    flat = {k: v for k, v in q.items() if k != "answers"} | {"all_answers": ["a", "b"]}
    mapped = readers.read_bank(spark, put(tmp_path / "m.json", {"metadata": {}, "questions_by_video": {"v": [q, q]}})).collect()
    other = readers.read_bank(spark, put(tmp_path / "f.json", [flat])).collect()
    assert [r.question_index for r in mapped] == [0, 1] and other[0].answers == ["a", "b"] == mapped[0].answers


def test_results_name_their_model(spark, tmp_path):
    good = {"video_name": "v", "prompt": "p", "is_correct": True}
    put(tmp_path / "m1_combined.json", {"results": [good, {"video_name": "v", "prompt": "p"}, {"prompt": "p", "is_correct": True}]})
    put(tmp_path / "m2.json", [good])
    rows = readers.read_results(spark, str(tmp_path)).collect()
    assert sorted(r.model for r in rows) == ["m1", "m2"]
    assert readers.read_results(spark, str(tmp_path), keep_unscored=True).count() == 4


def test_checkpoints_tolerant_and_void(spark, tmp_path):
    line = lambda v: json.dumps({"video_name": v, "timestamp": "t", "num_questions": 1, "results": [{"video_name": v, "question_type": "q", "prompt": "p", "is_correct": True}]})
    put(tmp_path / "a.jsonl", "\n".join([line("v1"), '{"video_name": "v2", "res', line("v3")]))
    put(tmp_path / "b.jsonl", line("v4"))
    path = str(tmp_path)
    assert sorted(r.clip for r in readers.read_checkpoints(spark, path).collect()) == ["v1", "v3", "v4"]
    assert [r.clip for r in readers.read_checkpoints(spark, path, on_bad="void").collect()] == ["v4"]
    assert sorted((r.lines, r.bad_lines) for r in readers.bad_line_counts(spark, path).collect()) == [(1, 0), (3, 1)]


def test_parent_groups(spark, tmp_path):
    doc = {"punch": {"punch_1": ["punch_1_trim_0.mp4", "punch_1_trim_1.mp4"], "no_group": ["punch_solo_001.mp4"]}, "kick": {"kick_2": ["k.mp4"]}}
    got = {r.clip: r.group_id for r in readers.read_groups(spark, put(tmp_path / "g.json", doc)).collect()}
    assert got["punch_1_trim_0.mp4"] == "punch/punch_1" and got["punch_solo_001.mp4"] == "punch/__solo__/punch_solo_001.mp4" and len(got) == 4


def test_log_needs_a_type_before_each_status(spark, tmp_path):
    put(tmp_path / "w.log", "\n".join([
        "Status: CORRECT", "[1/2] Processing a.mp4", "Type: t1", "x", "Status: CORRECT", "Status: WRONG", "Type: t1", "Type: t2",
        "Status: WRONG", "Type: t1", "[2/2] Processing b.mp4", "Status: CORRECT", "Type: t1", "[GPU 1] Status:  WRONG"]))
    got = {r.qtype: (r.total, r.correct) for r in readers.log_accuracy(spark, str(tmp_path)).collect()}
    assert got == {"t1": (2, 1), "t2": (1, 0)}


def test_media_and_shards(spark, tmp_path):
    for name in ("a.mp4", "b.MKV", "c.txt", "r_part2.json", "r_part1.json", "s.json", "s_part1.json"):
        put(tmp_path / name, "x")
    assert sorted(r.clip for r in readers.list_media(spark, str(tmp_path)).collect()) == ["a.mp4", "b.MKV"]
    names = lambda stem: [p.rsplit("/", 1)[-1] for p in readers.find_shards(spark, str(tmp_path), stem)]
    assert names("r") == ["r_part1.json", "r_part2.json"] and names("s") == ["s.json"]


def test_shard_folders(spark, tmp_path):
    df = spark.range(6).withColumn("shard", F.col("id") % 2)
    sinks.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("shard = 1").count() == 3


def test_stream_dedup_with_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("c", "p", "2024-01-01 00:00:00"), ("c", "p", "2024-01-01 00:05:00"), ("d", "p", "2024-01-01 00:01:00")], "clip string, prompt string, at string")
    rows.select("clip", "prompt", F.to_timestamp("at").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("clip string, prompt string, at timestamp").parquet(str(tmp_path / "in"))
    once = running.once_per_question(stream, event_time="at", delay="1 hour").select("clip", "prompt")
    running.append_to(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.clip for r in spark.read.json(str(tmp_path / "out")).collect()) == ["c", "d"]


def test_restarted_stream_appends_nothing_twice(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    for _ in range(2):
        running.append_to(read(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_totals_survive_a_crash_at_any_point(spark, tmp_path):
    path, table = f"{tmp_path}/totals", lambda n: spark.createDataFrame([("m", n)], "model string, total int")
    store = running.store_totals(path)
    with pytest.raises(FileNotFoundError):
        running.latest_totals(spark, path)
    store(table(1), 0)
    table(99).write.parquet(f"{path}/batch-1")  # a crash before batch 1 is named
    assert running.latest_totals(spark, path).first().total == 1
    store(table(2), 1)  # replayed
    assert running.latest_totals(spark, path).first().total == 2
    store(table(50), 1)  # replayed once more after it was named: the stored table stays
    assert running.latest_totals(spark, path).first().total == 2
    store(table(3), 2)
    assert running.latest_totals(spark, path).first().total == 3


def test_running_totals_go_on_after_a_restart(spark, tmp_path):
    schema = "model string, qtype string, is_correct boolean, selected int"
    rows = lambda n: spark.createDataFrame([("m", "t", i % 2 == 0, i) for i in range(n)], schema).coalesce(1)
    source, path = f"{tmp_path}/in", f"{tmp_path}/totals"
    for turn, n in enumerate((4, 6)):
        rows(n).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        running.keep_latest(running.running_accuracy(stream), path, f"{tmp_path}/checkpoint").awaitTermination()
        assert running.latest_totals(spark, path).first().total == (4, 10)[turn]
