"""Questions that share a number: each has its own result."""

from __future__ import annotations

import pytest

from tessella.operators import inference


@pytest.mark.parametrize("kept", [False, True])
def test_questions_of_one_number_are_not_multiplied(spark, tmp_path, kept):
    rows = [(12, "turn 12 of 0", "A. yes\nB. no", "A"), (12, "turn 2 of 1", None, "gt1"), (12, "turn 2 of 1", None, "gt1"), (13, "q", None, "gt3"), (11, "refused", None, "gt1"), (11, "refused too", None, "gt1")]
    samples = spark.createDataFrame(rows, "sample_index long, question string, options string, answer string")
    options = {"journal": str(tmp_path / "journal")} if kept else {}
    found = inference.evaluate(samples, inference.ArithmeticBackend(), inference.ArithmeticJudge(), trials=[0, 1], **options)
    assert found.columns == ["sample_index", "question", "options", "answer", "trial_id", "eval_result"]
    got = sorted((r["sample_index"], r["question"], r["trial_id"], r["eval_result"]["is_correct"]) for r in found.collect())
    one = [(11, "refused", None), (11, "refused too", None), (12, "turn 12 of 0", True), (12, "turn 2 of 1", True), (12, "turn 2 of 1", True), (13, "q", True)]
    assert got == sorted([(i, q, t, right) for i, q, right in one for t in (0, 1)], key=lambda r: r[:3])


def test_lines_like_options_within_a_question_are_no_options(spark):
    rows = [(3, "one\nA. two\nthree", None, "gt3"), (5, "A. two\nB. three", "A. yes\nB. no", "A")]
    samples = spark.createDataFrame(rows, "sample_index long, question string, options string, answer string")
    found = inference.infer(samples, inference.ArithmeticBackend(), [0])
    assert {r["sample_index"]: r["result"]["last_message_content"] for r in found.collect()} == {3: "<answer>gt3</answer>", 5: "<answer>B</answer>"}
