"""Outcomes, rates and whole evaluations with a model that is made up."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import bandjoin, evaluation, inference, rendering, sampling
from tessella.plans import commands
from tessella.sources import checkpoints, readers, writers


@pytest.mark.parametrize(
    "success, correct, inferred, reason, status",
    [
        (False, None, False, "", "invalid"),
        (False, None, True, "length", "incomplete"),
        (True, True, True, "stop", "correct"),
        (False, None, True, "stop", "invalid"),
        (True, False, True, "stop", "wrong"),
        (None, None, None, None, "invalid"),
        (False, None, True, None, "incomplete"),
    ],
)
def test_status(spark, success, correct, inferred, reason, status):
    row = spark.createDataFrame([(success, correct, inferred, reason)], "s boolean, c boolean, i boolean, r string")
    assert row.select(evaluation.status(F.col("s"), F.col("c"), F.col("i"), F.col("r")).alias("x")).first()["x"] == status


def test_rates_without_a_base_are_zero(spark):
    rows = spark.createDataFrame([("a", "invalid"), ("b", "correct"), (None, "wrong")], "category string, status string")
    got = {r["category"]: r for r in evaluation.rollup(rows).collect()}
    assert set(got) == {"a", "b", "unknown", evaluation.OVERALL}
    assert got["a"]["completion_rate"] == 0.0 and got["a"]["accuracy"] == 0.0
    assert got[evaluation.OVERALL]["total"] == 3
    assert evaluation.rollup(rows.limit(0)).where("category <> '__overall__'").count() == 0


def test_category_of_one_trial_is_averaged_over_it(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.0), (1, "b", 0.5)], "trial_id int, category string, accuracy double")
    got = {r["category"]: r for r in evaluation.over_trials(rows, "category", values=("accuracy",)).collect()}
    assert (got["a"]["accuracy_mean"], got["a"]["accuracy_std"], got["a"]["num_trials"]) == (0.5, 0.5, 2)
    assert (got["b"]["accuracy_mean"], got["b"]["accuracy_std"], got["b"]["num_trials"]) == (0.5, 0.0, 1)


def test_zip_of_unequal_lengths_fails(spark):
    row = spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="different lengths"):
        row.select(evaluation.zipped(F.col("a"), F.col("b"))).collect()


def samples(spark):
    rows = [(i, "q", "A. x\nB. y" if i % 2 else None, "A" if i % 2 else f"gt{i % 3}", "c" if i % 4 else None, "s") for i in range(60)]
    return spark.createDataFrame(rows, "sample_index long, question string, options string, answer string, category string, subset string")


def expected(i):
    """The outcome for a sample, from the rules of the made-up model and judge."""
    said, answer = ("A" if i % 3 == 0 else "B", "A") if i % 2 else (f"gt{i % 5}", f"gt{i % 3}")
    if i % 11 == 0:
        return "invalid"
    if i % 7 == 0:
        return "incomplete"
    if said == answer:
        return "correct"
    return "wrong" if i % 2 else "correct" if i % 4 == 0 else "wrong"


def test_evaluate(spark):
    out = inference.evaluate(samples(spark), inference.ArithmeticBackend(), inference.ArithmeticJudge(), [0, 1])
    got = out.select("sample_index", "trial_id", evaluation.record_status(F.col("eval_result")).alias("status"), "eval_result.fail_reason").collect()
    assert len(got) == 120
    for r in got:
        assert r["status"] == expected(r["sample_index"]), r
        assert (r["fail_reason"] is None) == (r["status"] in ("correct", "wrong"))


class Failing:
    def complete(self, request):
        raise OSError("no network")


class Empty:
    def complete(self, request):
        return [inference.Choice(None)] * request.n


def test_failures_stay_with_their_rows(spark):
    out = inference.evaluate(samples(spark), inference.ArithmeticBackend(), Failing(), [0])
    reasons = {r[0] for r in out.select("eval_result.fail_reason").collect()}
    assert reasons == {None, "inference_failed", "finish_reason:length", "answer_extraction_failed"}
    out = inference.evaluate(samples(spark), Empty(), Failing(), [0])
    assert {r[0] for r in out.select("eval_result.inference_result.fail_reason").collect()} == {"failed_to_parse_response"}


def test_a_whole_run(spark, tmp_path):
    model, judge = inference.ArithmeticBackend(), inference.ArithmeticJudge()
    args = {"model": "m", "api_key": "sk-123", "max_completion_tokens": 5}
    for name in ("d1", "d2"):
        commands.evaluate(spark, samples(spark), model, judge, str(tmp_path), "org/m", name, 2, settings=args)
    assert json.loads((tmp_path / "org/m/d1/args.json").read_text()) == {"model": "m", "api_key": "[redacted]", "max_completion_tokens": 5}
    metrics = json.loads((tmp_path / "org/m/d1/trial_1/eval_metrics.json").read_text())
    assert metrics["overall_stats"]["total"] == 60 and set(metrics["category_stats"]) == {"c", "s"}
    assert metrics["overall_stats"]["correct"] == sum(expected(i) == "correct" for i in range(60))
    assert {r["trial_id"] for r in readers.done_trials(spark, str(tmp_path / "org/m/d1")).collect()} == {0, 1}
    summary = json.loads((tmp_path / "org/m/d1/summary_metrics.json").read_text())
    assert summary["num_trials"] == 2 and summary["overall_accuracy"]["std"] == 0.0
    # everything is done: nothing is asked again, and the summary is made anew
    commands.evaluate(spark, samples(spark), Failing(), Failing(), str(tmp_path), "org/m", "d1", 2)
    matrix = commands.gather(spark, str(tmp_path), ["org/m", "other"], ["d1", "d2"]).toPandas().set_index("setting")
    assert matrix.loc["other", "d1"] == "N/A" and matrix.loc["org/m", "d1"].endswith("@2")
    single = commands.gather(spark, str(tmp_path), ["org/m"], ["d1"]).toPandas()
    assert {"d1", "d1-c", "d1-s"} <= set(single.columns)


def test_sweep(spark, tmp_path):
    models = {"org/a": inference.ArithmeticBackend(), "b": Failing()}
    out = commands.sweep(spark, models, {"x": samples(spark), "y": samples(spark).limit(0)}, inference.ArithmeticJudge(), str(tmp_path), by_model={"org": {"max_answer_length": 3}}).toPandas().set_index("setting")
    right = sum(expected(i) == "correct" for i in range(60)) / 60
    assert out.loc["org/a", "x"] == f"{right * 100:.1f}±0.0 @1" and out.loc["b", "x"] == "0.0±0.0 @1"
    assert out.loc["org/a", "y"] == "0.0±0.0 @1" or out.loc["org/a", "y"] == "N/A"


def test_errors_name_the_model_but_no_key():
    request = inference.Request("1", [inference.user_message("q", "data:image/jpeg;base64,AAAA")])
    said = inference.error_message(OSError("x"), inference.HttpBackend("m", "http://h/v1"), request, detailed=True)
    assert '"m" at http://h/v1' in said and "AAAA" not in said and "[pruned]" in said


def test_secrets_are_blacked_out():
    assert writers.redacted({"judge_api_key": "x", "api_key": None, "token": "t", "max_tokens": 3}) == {"judge_api_key": "[redacted]", "api_key": None, "token": "[redacted]", "max_tokens": 3}


def test_images_are_resized_without_an_image_library(spark, tmp_path):
    pixels = np.zeros((30, 40, 3), np.uint8)
    pixels[:, 20:] = 200
    (tmp_path / "a.png").write_bytes(rendering.png(pixels))
    url = inference.prepare_pixels(pixels, None, 300)
    assert url.startswith("data:image/png;base64,")
    (tmp_path / "small").mkdir()
    (tmp_path / "small/b.png").write_bytes(base64.b64decode(url.partition(",")[2]))
    back = readers.images(spark, str(tmp_path / "small"), decoded=True).select("image.*").first()
    assert (back["width"], back["height"]) == (20, 15) == inference.resized_sides(40, 30, None, 300)
    assert inference.prepare_image((tmp_path / "a.png").read_bytes()).startswith("data:image/png;base64,")
    assert inference.prepare_image(b"\xff\xd8\xff\xe0").startswith("data:image/jpeg;base64,")
    with pytest.raises(ValueError, match="decoded"):
        inference.prepare_image((tmp_path / "a.png").read_bytes(), None, 300)
    with pytest.raises(ValueError, match="kind"):
        inference.prepare_image(b"text")


class Seen:
    """Answers with the kind of image that it was sent."""

    def complete(self, request):
        return [inference.Choice(next(p["image_url"]["url"][:22] for p in request.messages[-1]["content"] if p["type"] == "image_url"))]


def test_decoded_images_reach_the_model_and_bad_ones_fail_their_row(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(rendering.png(np.zeros((30, 40, 3), np.uint8)))
    decoded = readers.images(spark, str(tmp_path), decoded=True).select(F.lit(0).cast("long").alias("sample_index"), F.col("image").alias("image_data"))
    rows = samples(spark).where("sample_index = 0").join(decoded, "sample_index")
    assert inference.infer(rows, Seen(), [0], max_pixels=100).first()["result"]["last_message_content"] == "data:image/png;base64,"
    bad = samples(spark).where("sample_index < 2").withColumn("image_bytes", F.when(F.col("sample_index") == 0, F.lit(b"text")).otherwise(F.lit(b"\xff\xd8\xff")))
    got = {r["sample_index"]: r["result"] for r in inference.infer(bad, Seen(), [0]).collect()}
    assert got[0]["fail_reason"] == "image_error" and got[1]["last_message_content"] == "data:image/jpeg;base64"


class Noted:
    def __init__(self, path):
        self.path = path

    def __call__(self, entry):
        with open(self.path, "a") as f:
            f.write(json.dumps(entry) + "\n")


def test_calls_are_told_to_a_log(spark, tmp_path):
    inference.evaluate(samples(spark), inference.ArithmeticBackend(), inference.ArithmeticJudge(), [0], call_log=Noted(str(tmp_path / "log"))).count()
    keys = [json.loads(x)["key"] for x in (tmp_path / "log").read_text().splitlines()]
    assert sum("/" not in k for k in keys) == sum(expected(i) != "invalid" for i in range(60)) and any(k.endswith("/judge") for k in keys)


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 250])
def test_the_hard_threshold_is_the_exact_quantile(spark, rows):
    h = np.random.default_rng(rows).normal(size=rows)
    got = sampling.hard_threshold(spark.createDataFrame([(float(x),) for x in h] + [(None,)], "hardness double")).first()["threshold"]
    want = None if not rows else h.max() if rows <= 2 else np.quantile(h, 0.66)
    assert got == want or abs(got - want) < 1e-12


def test_nearest_in_small_blocks_equals_one_block(spark):
    panels = spark.range(50).select(F.col("id").alias("panel_id"), (F.lit(0.4) + F.col("id") % 22 * 0.1).alias("panel_ratio"))
    images = spark.range(300).select(F.col("id").alias("uid"), (F.lit(0.3) + F.col("id") % 37 * 0.07).alias("ratio"), (F.col("id") % 3).alias("used"))
    a, b = (sorted(map(tuple, bandjoin.nearest_by_score(panels, images, 5, block=n).collect())) for n in (7, 4096))
    assert a == b and len(a) == 250


def test_an_unset_folder_on_a_cluster_is_an_error():
    class Unset:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Unset(), type("Context", (), {"master": "yarn"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints.shared_folder(Session)
