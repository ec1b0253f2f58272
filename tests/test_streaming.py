"""Streams over files, processed until nothing is left."""

import json

from pyspark.sql import functions as F

from tessella.streaming import records


def write(folder, name, rows):
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_running_rates(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    ok = {"success": True, "is_correct": True, "inference_result": {"success": True, "finish_reason": "stop"}}
    cut = {"success": False, "inference_result": {"success": True, "finish_reason": "length"}}
    write(source, "a.jsonl", [{"category": "x", "eval_result": ok}, {"category": "y", "eval_result": cut}])
    run = lambda: records.write_available(records.running_rates(records.records(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    write(source, "b.jsonl", [{"subset": "x", "eval_result": ok}])
    run()
    got = {r["category"]: (r["correct"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out/rates")).collect()}
    assert got == {"x": (2, 2), "y": (0, 1), "__overall__": (2, 3)}


def test_running_usage(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.jsonl", [{"uid": "1", "role": "core"}, {"uid": "1", "role": "fill"}, {"uid": "2", "role": "alt"}])
    stream = spark.readStream.schema("uid string, role string").json(str(source))
    seen = []
    records.running_usage(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).foreachBatch(lambda df, i: seen.extend(df.collect())).start().awaitTermination()
    assert {(r["uid"], r["core_count"], r["alt_count"], r["fill_count"]) for r in seen} == {("1", 1, 0, 1), ("2", 0, 1, 0)}


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "t string, c string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in records.windowed_outcomes(rows, "t", "c").collect()) == [1, 2]


def test_cooldown_as_a_stream_equals_the_batch(spark, tmp_path):
    from tessella.operators import sampling
    from tessella.streaming import cooldown

    source = tmp_path / "in"
    source.mkdir()
    rows = [{"event": i, "user": i * 7 % 3, "kind": f"k{i * i % 11}"} for i in range(120)]
    seen = {}
    run = lambda: cooldown.running_recent(spark.readStream.schema("event long, user long, kind string").json(str(source)), "user", "event", "kind", 5).writeStream.option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).foreachBatch(lambda df, i: seen.update({(r["user"], r["event"]): sorted(r["recent"]) for r in df.collect()})).start().awaitTermination()
    for k, part in enumerate((rows[:50], rows[50:51], rows[51:])):
        write(source, f"{k}.jsonl", part)
        run()
    batch = sampling.recent(spark.createDataFrame(rows, "event long, user long, kind string"), "user", "event", "kind", 5)
    assert seen == {(r["user"], r["event"]): sorted(r["recent"]) for r in batch.collect()}


def test_a_stopped_stream_gives_the_records_of_a_batch_run(spark, tmp_path, monkeypatch):
    import pytest

    from tessella.sources import writers
    from tessella.streaming import once

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rows = [{"id": i, "status": "ok" if i % 3 else "bad"} for i in range(60)]
    for k in range(6):
        write(source, f"{k}.jsonl", rows[k * 10 : k * 10 + 10])
    schema = "id long, status string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    counts = {"bad": F.count_if(F.col("status") == "bad")}
    real, marks = writers.write_text, []

    def breaks(session, path, content):
        marks.append(path)
        if len(marks) == 3:  # a batch is written, its mark isn't
            raise OSError("stopped")
        real(session, path, content)

    monkeypatch.setattr(writers, "write_text", breaks)
    with pytest.raises(Exception, match="stopped"):
        once.write_once(stream(), out, str(tmp_path / "state"), counts).awaitTermination()
    assert once.written(spark, out, schema).count() == 20 and len(list((tmp_path / "out/records").iterdir())) == 3
    once.write_once(stream(), out, str(tmp_path / "state"), counts).awaitTermination()
    once.write_once(stream(), out, str(tmp_path / "state"), counts).awaitTermination()
    assert sorted(r["id"] for r in once.written(spark, out, schema).collect()) == list(range(60))
    assert sorted((r["counts"]["n"], r["counts"]["bad"]) for r in once.manifest(spark, out).collect()) == sorted((10, sum(not x["id"] % 3 for x in rows[k * 10 : k * 10 + 10])) for k in range(6))


def test_counts_come_with_the_write(spark, tmp_path):
    from tessella.sources import writers

    records = spark.createDataFrame([(i, 0, "x" if i % 4 else "y") for i in range(21)], "sample_index long, trial_id int, status string")
    assert writers.write_records(records, str(tmp_path), {"y": F.count_if(F.col("status") == "y")}) == {"n": 21, "y": 6}
    assert len((tmp_path / "eval_records.jsonl").read_text().splitlines()) == 21
