"""Runs that break: nothing half-written, nothing asked twice, nothing opened that isn't named."""

from __future__ import annotations

import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import inference, rendering
from tessella.plans import commands
from tessella.sources import sink


def samples(spark, n=24):
    return spark.createDataFrame([(i, f"q{i}", None, f"a{i}") for i in range(n)], "sample_index long, question string, options string, answer string")


class Counting:
    """Notes each call in a file; fails for questions from a number on."""

    model = "counting"

    def __init__(self, folder, broken_from=10**9, wait=0.0):
        self.folder, self.broken_from, self.wait = str(folder), broken_from, wait

    def complete(self, request):
        import uuid

        open(f"{self.folder}/{request.key.replace('/', '-')}.{uuid.uuid4().hex}", "w").close()
        time.sleep(self.wait)
        if int(request.key.split("/")[0]) >= self.broken_from:
            raise RuntimeError("the service is down")
        return [inference.Choice(f"r{request.key}")] * request.n


def calls(folder):
    return sorted(int(p.name.split(".")[0]) for p in folder.iterdir())


def test_a_run_broken_at_half_asks_only_the_rest(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir(), second.mkdir()
    journal = str(tmp_path / "journal")
    got = inference.infer(samples(spark), Counting(first, broken_from=12), [0, 1], journal=journal, in_flight=4).collect()
    assert calls(first) == list(range(24)) and sum(r["result"]["success"] for r in got) == 24 and len(got) == 48
    again = inference.infer(samples(spark), Counting(second), [0, 1], journal=journal, in_flight=4).collect()
    assert calls(second) == list(range(12, 24))
    assert {(r["sample_index"], r["trial_id"]): r["result"]["last_message_content"] for r in again} == {(i, t): f"r{i}" for i in range(24) for t in (0, 1)}
    # another question, or another setting, is another call
    third = tmp_path / "third"
    third.mkdir()
    inference.infer(samples(spark, 2), Counting(third), [0, 1], system_prompt="think", journal=journal).collect()
    assert calls(third) == [0, 1]


def test_a_task_that_dies_keeps_what_was_answered(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    journal = str(tmp_path / "journal")

    class Dying(Counting):
        def complete(self, request):
            if int(request.key) == 20:
                import os

                os._exit(3)  # the worker is lost
            return super().complete(request)

    with pytest.raises(Exception):  # noqa: B017
        inference.infer(samples(spark).coalesce(1).orderBy("sample_index"), Dying(folder), [0], journal=journal, concurrency=2).collect()
    before = len(calls(folder))
    assert before >= 18
    rest = tmp_path / "rest"
    rest.mkdir()
    out = inference.infer(samples(spark), Counting(rest), [0], journal=journal).collect()
    assert len(out) == 24 and set(calls(rest)) < set(range(24)) and len(calls(rest)) <= 6


class Gauge(Counting):
    """How many calls are under way at once, over all workers, from files that come and go."""

    def complete(self, request):
        import os

        mark = f"{self.folder}/now.{os.getpid()}.{threading.get_ident()}"
        open(mark, "w").close()
        seen = len([x for x in os.listdir(self.folder) if x.startswith("now.")])
        open(f"{self.folder}/seen.{seen}", "w").close()
        time.sleep(0.1)
        os.remove(mark)
        return [inference.Choice("x")] * request.n


def test_calls_in_flight_are_bounded_over_all_tasks(spark, tmp_path):
    inference.infer(samples(spark, 40).repartition(8), Gauge(tmp_path), [0], in_flight=3).collect()
    assert max(int(p.name.split(".")[1]) for p in tmp_path.iterdir() if p.name.startswith("seen.")) <= 3


class Flaky:
    def __init__(self, failures, error=OSError):
        self.left, self.error, self.calls = failures, error, 0

    def complete(self, request):
        self.calls += 1
        if self.calls <= self.left:
            raise self.error("busy")
        return [inference.Choice("ok")] * request.n


def test_calls_are_tried_again_if_that_may_help():
    request = inference.Request("1", [inference.user_message("q")])
    flaky = Flaky(2)
    assert inference.Retrying(flaky, 4, 0.001).complete(request)[0].content == "ok" and flaky.calls == 3
    for backend, n in ((Flaky(9), 3), (Flaky(1, ValueError), 1)):
        with pytest.raises((OSError, ValueError)):
            inference.Retrying(backend, 3, 0.001).complete(request)
        assert backend.calls == n
    from urllib.error import HTTPError

    assert [inference.may_pass(HTTPError("u", code, "", {}, None)) for code in (401, 404, 429, 503)] == [False, False, True, True]


def test_only_named_images_are_opened_and_large_ones_are_resized(spark, tmp_path):
    rng = np.random.default_rng(0)
    for name, sides in (("small.png", (8, 6)), ("large.png", (60, 40))):
        (tmp_path / name).write_bytes(rendering.png(rng.integers(0, 255, (*sides[::-1], 3)).astype(np.uint8)))
    for name in ("broken.png", "unread.png"):
        (tmp_path / name).write_bytes(b"\x89PNG but broken")
    (tmp_path / "unread.png").chmod(0)
    rows = spark.createDataFrame([(0, "q", None, "a", "small.png"), (1, "q", None, "a", "large.png"), (2, "q", None, "a", "broken.png"), (3, "q", None, "a", "missing.png"), (4, "q", None, "a", None)], "sample_index long, question string, options string, answer string, image string")
    asked = commands.with_images(rows, F.concat(F.lit(f"{tmp_path}/"), "image"), 600)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "unread" not in plan and "Exchange hashpartitioning(image_data" not in plan

    class Sees:
        model = "sees"

        def complete(self, request):
            part = next((p for p in request.messages[-1]["content"] if p["type"] == "image_url"), None) if isinstance(request.messages[-1]["content"], list) else None
            if part is None:
                return [inference.Choice("none")]
            import base64

            return [inference.Choice("x".join(map(str, inference.image_sides(base64.b64decode(part["image_url"]["url"].split(",", 1)[1])))))]

    got = {r["sample_index"]: (r["result"]["last_message_content"], r["result"]["fail_reason"]) for r in inference.infer(asked, Sees(), [0], max_pixels=600).collect()}
    assert got[0] == ("8x6", "") and got[3] == (None, "image_error") and got[4] == ("none", "")
    w, h = map(int, got[1][0].split("x"))
    assert w * h <= 600 and w == 30 and got[2][1] in ("image_error", "")


def test_sides_of_files():
    assert inference.image_sides(rendering.png(np.zeros((5, 9, 3), np.uint8))) == (9, 5)
    assert inference.image_sides(b"GIF89a\x07\x00\x03\x00") == (7, 3)
    jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03"
    assert inference.image_sides(jpeg) == (32, 16) and inference.image_sides(b"text") is None and inference.image_sides(jpeg[:9]) is None


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    files = spark.range(40).select(F.concat(F.lit("images/0/"), "id", F.lit(".png")).alias("path"), F.when(F.col("id") < 39, F.lit("x")).otherwise(F.raise_error(F.lit("broken"))).alias("content"))
    with pytest.raises(Exception, match="broken"):
        sink.write_files(files.repartition(4), str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    sink.write_files(files.where("id < 39"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(f"{i}.png" for i in range(39))
    assert not (tmp_path / "out/_pending").exists()


def test_images_and_sidecars_appear_together(spark, tmp_path):
    canvas = "struct<width:int,height:int,bg_color:array<int>>"
    layout = "array<struct<layout_id:int,layout_bbox:array<int>,src_img:string,img_crop_region:array<int>,image_type:string,canvas_object_bbox:array<int>>>"
    made = spark.createDataFrame([(7, (30, 20, [255, 255, 255]), [(1, [0, 0, 10, 10], "a.png", None, "core", None)])], f"collage_index long, canvas {canvas}, layouts {layout}")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.png").write_bytes(rendering.png(np.zeros((10, 10, 3), np.uint8)))
    assert commands.render(spark, made, str(tmp_path / "out"), str(tmp_path / "src")) == 1
    assert sorted(p.name for p in (tmp_path / "out/images/0").iterdir()) == ["7.json", "7.png"]
    assert json.loads((tmp_path / "out/images/0/7.json").read_text())["canvas"]["width"] == 30
