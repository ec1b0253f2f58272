"""Reading what others write, and going on from checkpoints."""

import json

from pyspark.sql import functions as F

from tessella.operators import relational, usage
from tessella.sources import readers, resume, writers


def test_annotations_keep_their_order_and_their_text(spark, tmp_path):
    lines = [{"image": "a.jpg", "question": "q0", "answer": "20"}, {"file_name": "b.jpg", "subset": "s", "question": "q1", "options": None, "answer": "7"}, {"image": "c.jpg", "question": "q2", "options": "A. x", "answer": "A", "category": "NaN"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = readers.annotations(spark, str(tmp_path / "a.jsonl")).orderBy("sample_index").collect()
    assert [(r["sample_index"], r["question"], r["answer"]) for r in rows] == [(0, "q0", "20"), (1, "q1", "7"), (2, "q2", "A")]
    assert rows[1]["options"] is None and rows[2]["category"] is None


def test_image_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('image,question,img_width,img_height,bbox\na.jpg,"say ""hi""\nthere",10,20,"[1, 2, 3, 4]"\nb.jpg,None,5,5,\n')
    (tmp_path / "b.csv").write_text("image,img_width,img_height,core_count\nc.jpg,7,x,3\n")
    rows = readers.image_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).orderBy(F.col("uid").cast("int")).collect()
    assert [r["uid"] for r in rows] == ["0", "1", "2"] and [r["image"] for r in rows] == ["a.jpg", "b.jpg", "c.jpg"]
    assert rows[0]["question"] == 'say "hi"\nthere' and rows[1]["question"] is None and rows[2]["img_height"] is None
    assert [r["core_count"] for r in rows] == [0, 0, 3]


def test_missing_columns_are_only_warned_about(spark, caplog):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert relational.pruned(df, ["a", "z"]).columns == ["a"]
    assert "z" in caplog.text


def test_sidecars_of_both_forms(spark, tmp_path):
    new = {"canvas": {"width": 10, "height": 20, "grid": 4}, "layouts": [{"src_img": "a", "image_type": "core"}, {"src_img": "b", "image_type": "FILL"}]}
    old = {"width": 5, "height": 6, "placements": [{"image": "a", "image_type": "alt", "object_bbox": [1, 2, 3, 4]}]}
    (tmp_path / "0").mkdir()
    (tmp_path / "0/1.json").write_text(json.dumps(new, indent=1))
    (tmp_path / "0/2.json").write_text(json.dumps(old))
    (tmp_path / "0/3.json").write_text("{broken")
    found = readers.sidecars(spark, str(tmp_path))
    assert {(r["width"], r["height"]) for r in found.collect()} == {(10, 20), (5, 6)}
    counts = {r["image"]: tuple(r[c] for c in usage.COUNTS) for r in usage.counts_from_layouts(found).collect()}
    assert counts == {"a": (1, 1, 0), "b": (0, 0, 1)}


def test_output_index(spark, tmp_path):
    for name in ("0/3.jpg", "0/x.jpg", "1/1000.JPG", "1/7.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert tuple(readers.output_index(spark, str(tmp_path)).first()) == (1000, 3)
    (tmp_path / "none").mkdir()
    assert tuple(readers.output_index(spark, str(tmp_path / "none")).first()) == (-1, 0)


def test_resolved_images(spark):
    wanted = spark.createDataFrame([("d/a.gif",), ("d/b.jpg",), ("d/c.jpg",)], "image string")
    there = spark.createDataFrame([("d/a.png",), ("d/a.jpeg",), ("d/b.jpg",)], "path string")
    assert {r["image"]: r["found"] for r in readers.resolved_images(wanted, there).collect()} == {"d/a.gif": "d/a.jpeg", "d/b.jpg": "d/b.jpg", "d/c.jpg": None}


def images(spark):
    return spark.createDataFrame([("0", "a"), ("1", "b"), ("2", "b")], "uid string, image string")


def test_resume_from_counts_by_image(spark, tmp_path):
    (tmp_path / "checkpoints").mkdir()
    (tmp_path / "checkpoints/counts_round_1.csv").write_text("image,core_count,alt_count,fill_count\na,1,2,3\nb,4,0,0\n")
    out, start = resume.prepare(images(spark), str(tmp_path))
    assert {r["uid"]: r["core_count"] for r in out.collect()} == {"0": 1, "1": 4, "2": 4} and start == 0


def test_latest_counts_prefers_the_final_ones(spark, tmp_path):
    (tmp_path / "checkpoints").mkdir()
    (tmp_path / "checkpoints/counts_round_9.csv").write_text("uid\n")
    assert readers.latest_counts(spark, str(tmp_path)).endswith("counts_round_9.csv")
    (tmp_path / "counts_latest.csv").write_text("uid\n")
    assert readers.latest_counts(spark, str(tmp_path)).endswith("counts_latest.csv")
    (tmp_path / "final_counts.csv").write_text("uid\n")
    assert readers.latest_counts(spark, str(tmp_path)).endswith("final_counts.csv")
    assert readers.latest_counts(spark, str(tmp_path / "nowhere")) is None


def test_merge_overwrites_where_known_and_adds_repeats(spark):
    saved = spark.createDataFrame([("0", 1, None, 3), ("0", 1, None, 0)], "uid string, core_count long, alt_count long, fill_count long")
    base = images(spark).withColumn("alt_count", F.lit(9))
    got = {r["uid"]: (r["core_count"], r["alt_count"], r["fill_count"]) for r in usage.merge_counts(base, saved).collect()}
    assert got == {"0": (2, 9, 3), "1": (0, 9, 0), "2": (0, 9, 0)}


def test_records_round_trip(spark, tmp_path):
    folder = writers.trial_folder(str(tmp_path), "a/b", "d", 0)
    rows = spark.createDataFrame([(1, "q1", 0), (0, "q0", 0)], "sample_index long, question string, trial_id int")
    writers.write_records(rows, folder)
    text = (tmp_path / "a/b/d/trial_0/eval_records.jsonl").read_text()
    assert [json.loads(x) for x in text.splitlines()] == [{"question": "q0"}, {"question": "q1"}]
    assert not (tmp_path / "a/b/d/trial_0/_eval_records").exists()
    back = readers.eval_records(spark, str(tmp_path)).collect()
    assert [(r["question"], r["setting"], r["dataset"], r["trial_id"]) for r in back] == [("q0", "a/b", "d", 0), ("q1", "a/b", "d", 0)]
