"""Schemas of what the engine reads and writes, as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

#: M1, M2: an annotated question about an image.  Everything textual is a string, so that numeric answers stay text.
ANNOTATION = _struct(
    question_id=_S, image=_S, file_name=_S, question=_S, options=_S, answer=_S, category=_S, subset=_S,
    layout_infos=T.MapType(_S, _struct(bbox=T.ArrayType(_D))), target_layouts=T.ArrayType(_I), explanation=_S,
)

#: M6: one part of a message, and a message whose content was a string or a list of parts.
IMAGE_URL = _struct(url=_S, detail=_S)
PART = _struct(type=_S, text=_S, image_url=IMAGE_URL)
MESSAGE = _struct(role=_S, content_text=_S, content_parts=T.ArrayType(PART))

#: M3 to M5: what inference and evaluation give for a question in a trial.
CONVERSATION = _struct(agent=_S, messages=T.ArrayType(MESSAGE))
INFERENCE_RESULT = _struct(success=_B, fail_reason=_S, finish_reason=_S, conversations=T.ArrayType(CONVERSATION), last_message_content=_S)
EVAL_RESULT = _struct(sample_index=_L, success=_B, fail_reason=_S, inference_result=INFERENCE_RESULT, extracted_answer=_S, is_correct=_B)

#: M7: an evaluated question; the trial it belongs to is part of its path.
EVAL_RECORD = T.StructType([*ANNOTATION.fields, T.StructField("eval_result", EVAL_RESULT)])

#: M8: rates and counts of a trial.  Categories are map keys: inferred, they would become fields.
RATES, STATS = T.MapType(_S, _D), T.MapType(_S, _L)
METRICS = _struct(
    overall_success_rate=_D, overall_completion_rate=_D, overall_accuracy=_D, overall_stats=STATS,
    category_success_rate=RATES, category_completion_rate=RATES, category_accuracy=RATES, category_stats=T.MapType(_S, STATS),
)

#: M9: means and standard deviations over trials.
SPREAD = _struct(mean=_D, std=_D)
SUMMARY = _struct(
    num_trials=_I, overall_success_rate=SPREAD, overall_completion_rate=SPREAD, overall_accuracy=SPREAD,
    category_success_rate=T.MapType(_S, SPREAD), category_completion_rate=T.MapType(_S, SPREAD), category_accuracy=T.MapType(_S, SPREAD),
)

#: Source images with how often each was used, by role.
SOURCE_IMAGE = _struct(image=_S, question=_S, answer=_S, img_width=_L, img_height=_L, bbox=_S, bbox_ratio=_D, core_count=_L, alt_count=_L, fill_count=_L)
USAGE = _struct(uid=_S, core_count=_L, alt_count=_L, fill_count=_L)

#: Rectangles, placed images and canvases.
RECT = _struct(x0=_L, y0=_L, x1=_L, y1=_L)
BBOX = _struct(x0=_D, y0=_D, x1=_D, y1=_D)
LAYOUT = _struct(
    layout_id=_I, layout_bbox=T.ArrayType(_L), layout_area=_L, layout_bbox_ratio=_D, src_dataset=_S, src_idx=_S, src_img=_S, scale_ratio=_D,
    img_crop_region=T.ArrayType(_L), object_bbox=T.ArrayType(_D), object_bbox_ratio=_D, image_type=_S, r_out=_D,
    canvas_object_bbox=T.ArrayType(_L), canvas_object_bbox_ratio=_D, question=_S, answer=_S,
)
CANVAS = _struct(width=_L, height=_L, aspect_ratio=_D, grid=_L, margin_g=_L, bg_color=T.ArrayType(_I), layout_count=_L, core_count=_L, alt_count=_L, fill_count=_L)

#: M15 as read: the present form has ``canvas`` and ``layouts``, the earlier one is flat with ``placements``.
_ANY_LAYOUT = T.StructType([*[T.StructField(f.name, _S if f.name == "object_bbox" else f.dataType) for f in LAYOUT.fields], T.StructField("image", _S)])
SIDECAR = _struct(
    canvas=CANVAS, layouts=T.ArrayType(_ANY_LAYOUT), width=_L, height=_L, grid=_L, margin_g=_L, bg_color=T.ArrayType(_I), placements=T.ArrayType(_ANY_LAYOUT),
)

#: Where a run goes on.
RESUME = _struct(produced_total=_L, next_index=_L)

#: A training row.
TRAINING = _struct(
    data_source=_S, prompt=T.ArrayType(_struct(role=_S, content=_S)), images=T.ArrayType(_struct(image=_S)),
    reward_model=_struct(ground_truth=_S, style=_S), extra_info=_struct(bboxes=T.ArrayType(T.ArrayType(_D))), agent_name=_S,
)
