"""Asking models: inference on questions about images, and judging what rules can't decide.

Model calls run in Python workers, one session for each task; everything else is
column expressions.  Results are written to the shared folder after each model
stage, so a later failure, or a second action, repeats no paid call.
"""

from __future__ import annotations

import base64
import json
import logging
import math
import os
import re
import struct
import time
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..schemas import CONVERSATION, EVAL_RESULT, INFERENCE_RESULT, MESSAGE
from ..sources.checkpoints import shipped, staged
from ..sources.writers import logged
from . import journals, rendering

log = logging.getLogger(__name__)

#: Fixed value: tokens that a judge may answer with.
JUDGE_TOKENS = 2048


@dataclass
class Request:
    """A call: the messages, how many choices are wanted, and a key that is the same on every retry."""

    key: str
    messages: list[dict]
    n: int = 1
    settings: dict = field(default_factory=dict)


@dataclass
class Choice:
    content: str | None
    finish_reason: str = "stop"
    role: str = "assistant"


class Backend(Protocol):
    """Answers a request with its choices, or raises."""

    def complete(self, request: Request) -> list[Choice]: ...


@dataclass(frozen=True)
class HttpBackend:
    """A chat-completions endpoint.  The key is read from the environment where the call is made; it is never part of a plan or a file."""

    model: str
    base_url: str | None = None
    key_variable: str = "OPENAI_API_KEY"
    timeout: float = 600.0

    def complete(self, request: Request) -> list[Choice]:
        url = (self.base_url or os.environ.get("OPENAI_BASE_URL") or "https://api.openai.com/v1").rstrip("/") + "/chat/completions"
        body = {"model": self.model, "messages": request.messages, "n": request.n, **request.settings}
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}", "Idempotency-Key": request.key}
        timeout = float(os.environ.get("OPENAI_CLIENT_TIMEOUT") or self.timeout)
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
            found = json.load(reply)["choices"]
        return [Choice(c["message"].get("content"), c.get("finish_reason") or "", c["message"].get("role", "")) for c in found]


#: Options at the end of what is asked; a question's own text may hold lines like theirs.
OFFERED = re.compile(r"\nA\. [^\n]*(\n[B-Z]\. [^\n]*)+\Z")


class ArithmeticBackend:
    """A deterministic model for tests: what it does follows from the number in the key."""

    def complete(self, request: Request) -> list[Choice]:
        i = int(request.key.split("/")[0])
        if i % 11 == 0:
            raise RuntimeError("refused")
        asked = "".join(p.get("text") or "" for p in request.messages[-1]["content"])
        said = ("A" if i % 3 == 0 else "B") if OFFERED.search(asked) else f"gt{i % 5}"
        return [Choice(f"<answer>{said}</answer>", "length" if i % 7 == 0 else "stop") for _ in range(request.n)]


class ArithmeticJudge:
    """A deterministic judge: it repeats the answer, and finds every fourth open one correct."""

    def complete(self, request: Request) -> list[Choice]:
        i, step = int(request.key.split("/")[0]), request.key.rpartition("/")[2]
        if step == "judge":
            return [Choice("<correct>" if i % 4 == 0 else "<wrong>")]
        asked = request.messages[-1]["content"][0]["text"]
        return [Choice(asked.rpartition(": ")[2])]


def user_message(query: str, image_url: str | None = None, image_settings: dict | None = None) -> dict:
    """H8: a user's message as the endpoint takes it; the image goes first."""
    parts = [{"type": "text", "text": query}]
    if image_url:
        parts.insert(0, {"type": "image_url", "image_url": {"url": image_url, **(image_settings or {})}})
    return {"role": "user", "content": parts}


#: How files of the usual kinds begin, and their types.
BEGINNINGS = {b"\xff\xd8\xff": "image/jpeg", b"\x89PNG\r\n\x1a\n": "image/png", b"GIF8": "image/gif", b"BM": "image/bmp"}


def resized_sides(width: int, height: int, min_pixels: int | None, max_pixels: int | None) -> tuple[int, int]:
    """The sides brought up to ``min_pixels``, then down to ``max_pixels``, which wins."""
    w, h = width, height
    if min_pixels and w * h < min_pixels:
        s = (min_pixels / (w * h)) ** 0.5
        w, h = math.ceil(w * s), math.ceil(h * s)
    if max_pixels and w * h > max_pixels:
        s = (max_pixels / (w * h)) ** 0.5
        w, h = max(1, int(w * s)), max(1, int(h * s))
    return w, h


def _as_url(content: bytes, mime: str) -> str:
    return f"data:{mime};base64,{base64.b64encode(content).decode()}"


def prepare_pixels(pixels: np.ndarray, min_pixels: int | None = None, max_pixels: int | None = None) -> str:
    """RGB pixels (rows, columns, 3), resized, as the data URL of a PNG file."""
    height, width, _ = pixels.shape
    w, h = resized_sides(width, height, min_pixels, max_pixels)
    return _as_url(rendering.png(pixels if (w, h) == (width, height) else rendering.resized(pixels, w, h)), "image/png")


def prepare_image(content: bytes, min_pixels: int | None = None, max_pixels: int | None = None) -> str:
    """A file's bytes as a data URL of the type that they begin with.

    Bytes can't be resized here, as decoding them takes an image library; with a
    bound on pixels this raises.  Spark decodes images itself: pass those
    (``readers.images(..., decoded=True)``) in a column ``image`` instead.
    """
    if min_pixels or max_pixels:
        raise ValueError("encoded images can't be resized; pass decoded ones in a column image")
    mime = next((m for start, m in BEGINNINGS.items() if content.startswith(start)), None)
    if mime is None:
        raise ValueError("not an image of a known kind")
    return _as_url(content, mime)


def image_sides(head: bytes) -> tuple[int, int] | None:
    """Width and height from the beginning of a PNG, GIF, BMP or JPEG file; None if it doesn't say."""
    if head.startswith(b"\x89PNG") and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head.startswith(b"GIF8") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head.startswith(b"BM") and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    at = 2
    while head.startswith(b"\xff\xd8") and at + 9 <= len(head) and head[at] == 0xFF:
        kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
            return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def opened(path: str) -> bytes:
    """A file's bytes, from any store that Arrow knows; of a path without a scheme, from a folder that all machines see."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with store.open_input_file(name) as f:
        return f.read()


def image_url_of(path: str, min_pixels: int | None = None, max_pixels: int | None = None) -> str:
    """The data URL of an image file, read where it is sent from.

    A file within the bounds goes as it is.  One that has to be resized is decoded
    with Pillow, if the workers have it; without it this raises.
    """
    content = opened(path)
    if not (min_pixels or max_pixels):
        return prepare_image(content)
    sides = image_sides(content)
    if sides and resized_sides(*sides, min_pixels, max_pixels) == tuple(sides):
        return prepare_image(content)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError(f"{path} has to be resized, which takes Pillow, or an image that Spark decoded") from e
    import io

    return prepare_pixels(np.asarray(Image.open(io.BytesIO(content)).convert("RGB")), min_pixels, max_pixels)


def _shown(message: dict) -> dict:
    """A message with the content split by its kind, image data left out."""
    content = message.get("content")
    if content is None or isinstance(content, str):
        return {"role": message.get("role"), "content_text": content, "content_parts": None}
    parts = [{"type": p.get("type"), "text": p.get("text"), "image_url": {"url": "[pruned]", "detail": p["image_url"].get("detail")} if "image_url" in p else None} for p in content]
    return {"role": message.get("role"), "content_text": None, "content_parts": parts}


def error_message(error: Exception, backend: Backend, request: Request, detailed: bool = False) -> str:
    """what failed where; in detail with the messages, their image data left out.  A backend's key isn't part of it."""
    where = f'"{getattr(backend, "model", type(backend).__name__)}" at {getattr(backend, "base_url", None)}'
    out = f"failed to query {where}: {error!r}"
    return out + "\n  messages: " + json.dumps([_shown(m) for m in request.messages], ensure_ascii=False) if detailed else out


def failed(why: str) -> dict:
    """An inference result that failed."""
    return {"success": False, "fail_reason": why, "finish_reason": "", "conversations": [], "last_message_content": None}


@dataclass(frozen=True)
class Logged:
    """A backend that tells a log of each call that was answered."""

    backend: Backend
    call_log: Callable[[dict], None]

    @property
    def model(self) -> str:
        return getattr(self.backend, "model", type(self.backend).__name__)

    @property
    def base_url(self) -> str | None:
        return getattr(self.backend, "base_url", None)

    def complete(self, request: Request) -> list[Choice]:
        return logged(self.backend.complete, self.call_log)(request)


def ask(backend: Backend, request: Request) -> list[dict]:
    """The request's choices as inference results; any error makes all of them failed ones."""
    try:
        choices = backend.complete(request)
    except Exception as e:
        log.warning(error_message(e, backend, request))
        return [failed("api_error")] * request.n
    if len(choices) != request.n:
        return [failed("wrong_number_of_choices")] * request.n
    out = []
    for c in choices:
        if c.role != "assistant" or c.content is None:
            out.append(failed("failed_to_parse_response"))
            continue
        said = [*map(_shown, request.messages), {"role": c.role, "content_text": c.content, "content_parts": None}]
        out.append({"success": True, "fail_reason": "", "finish_reason": c.finish_reason, "conversations": [{"agent": "main", "messages": said}], "last_message_content": c.content})
    return out


def may_pass(error: Exception) -> bool:
    """Whether an error may be gone at the next attempt: of the network, of a busy service, or of the service itself."""
    code = getattr(error, "code", None)
    return isinstance(error, OSError) and (not isinstance(code, int) or code in (408, 409, 425, 429) or code >= 500)


@dataclass(frozen=True)
class Retrying:
    """A backend whose failed calls are tried again, after pauses that double; which errors pass is for ``transient`` to say."""

    backend: Backend
    attempts: int = 4
    pause: float = 1.0
    transient: Callable[[Exception], bool] = may_pass

    @property
    def model(self) -> str:
        return getattr(self.backend, "model", type(self.backend).__name__)

    @property
    def base_url(self) -> str | None:
        return getattr(self.backend, "base_url", None)

    def complete(self, request: Request) -> list[Choice]:
        for n in range(self.attempts):
            try:
                return self.backend.complete(request)
            except Exception as e:
                if n + 1 == self.attempts or not self.transient(e):
                    raise
                # requests that failed together don't come back together
                time.sleep(self.pause * 2**n * (0.5 + zlib.crc32(f"{request.key}/{n}".encode()) / 2**33))
        raise AssertionError("no attempt was made")


def _in_pool(rows: list, call: Callable, concurrency: int) -> list:
    with ThreadPoolExecutor(max(1, min(concurrency, len(rows) or 1))) as pool:
        return list(pool.map(call, rows))


def infer(samples: DataFrame, backend: Backend, trials: list[int], system_prompt: str | None = None, call_settings: dict | None = None, image_settings: dict | None = None, concurrency: int = 8, separate: bool = False, max_pixels: int | None = None, min_pixels: int | None = None, call_log: Callable[[dict], None] | None = None, journal: str | None = None, in_flight: int | None = None) -> DataFrame:
    """A row (sample_index, trial_id, result) for each question and trial.

    Where questions share a sample_index, a column ``nth`` that tells them apart
    goes with the results.

    Choices of one request stand for the trials; with ``separate``, each trial
    is a request of its own.  ``concurrency`` is for each task; ``in_flight``, if
    given, bounds the calls of all tasks together: questions are dealt to no more
    tasks than that, and each makes its share at a time.

    Images come from a column ``image_data`` (what Spark's image source decodes;
    brought to the bounds on pixels), ``image_bytes`` (sent as they are),
    ``image_path`` (opened in the thread that sends it, so that only named files
    are read and a task holds one for each call) or ``image_url``, if there is
    one; a question whose image can't be prepared has a failed result.
    ``call_log`` is told of each call that was answered (K12), in the tasks.

    With ``journal``, a folder that all tasks reach, each answer is written there
    as it comes, under a key made of all that was asked.  What the journal has
    isn't asked again, by a task that runs twice or by a later run; failed calls
    are.
    """
    spark = shipped(samples.sparkSession)
    have = [c for c in ("image_data", "image_bytes", "image_path", "image_url") if c in samples.columns]
    number = [c for c in ("nth",) if c in samples.columns]
    asked = samples.select("sample_index", *number, text.prompt(F.col("question"), F.col("options")).alias("prompt"), *have)
    model = getattr(backend, "model", type(backend).__name__)
    backend = Logged(backend, call_log) if call_log else backend
    names = ["sample_index", *number, "trial_id", "result"]
    schema = f"sample_index bigint, {'nth int, ' if number else ''}trial_id int, result {INFERENCE_RESULT.simpleString()}"

    def one(row: dict) -> list[dict]:
        url, data = row.get("image_url"), row.get("image_data")
        try:
            if data is not None:
                url = prepare_pixels(rendering.rgb(data["data"], data["height"], data["width"], data["nChannels"]), min_pixels, max_pixels)
            elif row.get("image_bytes") is not None:
                url = prepare_image(row["image_bytes"], min_pixels, max_pixels)
            elif row.get("image_path") is not None:
                url = image_url_of(row["image_path"], min_pixels, max_pixels)
        except (ValueError, OSError) as e:
            log.warning("no image for question %s: %s", row["sample_index"], e)
            return [failed("image_error")] * len(trials)
        messages = [{"role": "system", "content": system_prompt}] if system_prompt else []
        messages.append(user_message(row["prompt"] or "", url, image_settings if image_settings is not None else {"detail": "high"}))
        key = str(row["sample_index"])
        if separate:
            return [r for t in trials for r in ask(backend, Request(f"{key}/{t}", messages, 1, call_settings or {}))]
        return ask(backend, Request(key, messages, len(trials), call_settings or {}))

    tasks = min(in_flight, spark.sparkContext.defaultParallelism) if in_flight else None
    at_a_time = max(1, in_flight // tasks) if in_flight else concurrency

    def results(rows: list[dict]) -> pd.DataFrame:
        found = _in_pool(rows, one, at_a_time)
        return pd.DataFrame([{"sample_index": r["sample_index"], **{c: r[c] for c in number}, "trial_id": t, "result": x} for r, each in zip(rows, found, strict=True) for t, x in zip(trials, each, strict=True)], columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield results(frame.to_dict("records"))

    if journal is None:
        return (asked.repartition(tasks) if tasks else asked).mapInPandas(run, schema)
    fixed = json.dumps([model, trials, system_prompt, call_settings, image_settings, separate, min_pixels, max_pixels], sort_keys=True, default=str)
    shown = [F.sha2(F.col("image_bytes"), 256) if c == "image_bytes" else F.sha2(F.to_json(F.struct("image_data")), 256) if c == "image_data" else F.col(c) for c in have]
    keyed = asked.withColumn("key", F.sha2(F.to_json(F.struct(F.lit(fixed).alias("fixed"), F.col("sample_index"), F.col("prompt"), *[c.alias(f"i{n}") for n, c in enumerate(shown)])), 256))
    left = keyed.join(journals.answered(spark, journal).where("final").select("key"), "key", "left_anti")

    def answer(rows: list[dict]) -> list[tuple[str, list[dict], bool]]:
        found = _in_pool(rows, one, at_a_time)
        return [(r["key"], each, all(x["success"] for x in each)) for r, each in zip(rows, found, strict=True)]

    journals.fill(left.repartition(tasks) if tasks else left, answer, journal, at_a_time)
    known = journals.answered(spark, journal).groupBy("key").agg(F.max_by("results", "final").alias("results"))  # answered twice: any answer
    each = F.posexplode(F.from_json("results", T.ArrayType(INFERENCE_RESULT)))
    trial = F.get(F.array(*[F.lit(t) for t in trials]), F.col("n"))
    return keyed.select("sample_index", *number, "key").join(known, "key").select("sample_index", *number, each.alias("n", "result")).select("sample_index", *number, trial.cast("int").alias("trial_id"), "result")


def judge(rows: DataFrame, backend: Backend, templates: dict[str, str] | None = None, concurrency: int = 8, strict: bool = False, call_log: Callable[[dict], None] | None = None, in_flight: int | None = None) -> DataFrame:
    """What rules couldn't decide: one call for multiple choice, two for open questions.

    Takes sample_index, trial_id, question, options, answer and raw; returns the
    first two with extracted_answer, is_correct and fail_reason (null if it worked).
    """
    shipped(rows.sparkSession)
    backend = Logged(backend, call_log) if call_log else backend
    t = {"choice": text.CHOICE_TEMPLATE, "open": text.OPEN_TEMPLATE, "judge": text.JUDGE_TEMPLATE, **(templates or {})}
    choice = text.has_options(F.col("options"))
    first = F.when(choice, text.filled(t["choice"], question=F.col("question"), options=F.col("options"), model_answer=F.col("raw"))).otherwise(text.filled(t["open"], question=F.col("question"), model_response=F.col("raw")))
    marker = "\x00extracted\x00"
    second = text.filled(t["judge"], question=F.col("question"), gt_answer=F.col("answer"), model_answer=F.lit(marker))
    number = [c for c in ("nth",) if c in rows.columns]
    asked = rows.select("sample_index", *number, "trial_id", "answer", choice.alias("choice"), first.alias("first"), second.alias("second"))
    tasks = min(in_flight, rows.sparkSession.sparkContext.defaultParallelism) if in_flight else None
    at_a_time = max(1, in_flight // tasks) if in_flight else concurrency

    def call(row: dict, step: str, query: str) -> str:
        got = backend.complete(Request(f"{row['sample_index']}/{row['trial_id']}/{step}", [user_message(query)], 1, {"max_completion_tokens": JUDGE_TOKENS}))[0].content
        if got is None:
            raise ValueError("empty reply")
        return got

    def one(row: dict) -> tuple:
        try:
            extracted = call(row, "extract", row["first"])
        except Exception:
            return None, None, "answer_extraction_failed"
        if row["choice"]:
            return extracted.strip(), extracted.strip() == row["answer"], None
        try:
            reply = call(row, "judge", row["second"].replace(marker, extracted)).lower()
        except Exception:
            return None, None, "judge_failed"
        return extracted, "<correct>" in reply if strict else "correct" in reply, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = _in_pool(frame.to_dict("records"), one, at_a_time)
            yield pd.DataFrame({"sample_index": frame["sample_index"], **{c: frame[c] for c in number}, "trial_id": frame["trial_id"], "extracted_answer": [r[0] for r in results], "is_correct": [r[1] for r in results], "fail_reason": [r[2] for r in results]})

    asked = asked.repartition(tasks) if tasks else asked
    return asked.mapInPandas(run, f"sample_index bigint, {'nth int, ' if number else ''}trial_id int, extracted_answer string, is_correct boolean, fail_reason string")


def evaluate(samples: DataFrame, main: Backend, judging: Backend, trials: list[int], max_answer_length: int = 1000, strict: bool = False, templates: dict[str, str] | None = None, **options) -> DataFrame:
    """Every question in every trial with its ``eval_result``.

    A failed call, or a response that was cut off, ends there.  An answer that
    equals the true one verbatim is correct without a judge.  The rest is cut to
    its end and judged.  ``samples`` needs sample_index, question, options and answer.
    Questions that share a sample_index are numbered, each has its own result.
    """
    columns, number = samples.columns, []
    if samples.groupBy("sample_index").count().where(F.col("count") > 1).limit(1).count():
        number = ["nth"]
        samples = samples.withColumn("nth", F.row_number().over(Window.partitionBy("sample_index").orderBy(F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))))
    one = ["sample_index", *number]
    results = staged(infer(samples, main, trials, **options), "inference")
    joined = samples.select(*one, "question", "options", "answer").join(results, one)
    stopped = F.col("result.success") & (F.col("result.finish_reason") == "stop")
    raw = text.rule_answer(F.col("result.last_message_content"))
    ruled = joined.withColumn("raw", F.when(stopped, raw)).withColumn("exact", F.coalesce(F.col("raw") == F.col("answer"), F.lit(False)))
    rest = ruled.where(stopped & ~F.col("exact")).withColumn("raw", text.left_crop(F.col("raw"), max_answer_length))
    judged = staged(judge(rest, judging, templates, options.get("concurrency", 8), strict, options.get("call_log"), options.get("in_flight")), "judged").withColumnRenamed("fail_reason", "judge_reason")
    every = ruled.join(judged, [*one, "trial_id"], "left")
    reason = F.when(~F.col("result.success"), "inference_failed").when(~stopped, F.concat(F.lit("finish_reason:"), "result.finish_reason")).otherwise(F.col("judge_reason"))
    outcome = F.struct(
        F.col("sample_index").cast("long").alias("sample_index"),
        (stopped & F.col("judge_reason").isNull()).alias("success"),
        reason.alias("fail_reason"),
        F.col("result").alias("inference_result"),
        F.when(F.col("exact"), F.col("raw")).otherwise(F.col("extracted_answer")).alias("extracted_answer"),
        F.when(F.col("exact"), F.lit(True)).otherwise(F.col("is_correct")).alias("is_correct"),
    ).cast(EVAL_RESULT)
    return samples.join(every.select(*one, "trial_id", outcome.alias("eval_result")), one).select(*columns, "trial_id", "eval_result")


__all__ = ["ArithmeticBackend", "ArithmeticJudge", "Backend", "CONVERSATION", "Choice", "HttpBackend", "MESSAGE", "Request", "ask", "evaluate", "infer", "judge", "prepare_image", "user_message"]
