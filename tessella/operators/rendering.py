"""Rendering collages without an image library: Spark decodes the sources, numpy scales and pastes, zlib packs PNG files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.checkpoints import shipped

#: The colours of the edges of each kind of layout, and of an object's box.
EDGES = {"core": (255, 0, 0), "alt": (0, 128, 255), "fill": (0, 200, 0)}
BOX = (255, 0, 0)
#: What Spark's image source decodes, by path.
DECODED = "path string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: Lobes of the scaling filter.
LOBES = 3


def lanczos(size: int, new: int) -> np.ndarray:
    """The weights by which ``new`` pixels are made of ``size``; shrinking widens the filter, so nothing is skipped."""
    scale = size / new
    wide = LOBES * max(1.0, scale)
    centres = (np.arange(new) + 0.5) * scale
    x = (np.arange(size) + 0.5 - centres[:, None]) / max(1.0, scale)
    weights = np.where(np.abs(x) * max(1.0, scale) < wide, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels (rows, columns, 3) scaled to a size."""
    rows = np.tensordot(lanczos(pixels.shape[0], height), pixels.astype(float), (1, 0))
    both = np.tensordot(lanczos(pixels.shape[1], width), rows, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """RGB pixels as a PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """What Spark's image source decodes (BGR, BGRA or grey) as RGB."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def outlined(canvas: np.ndarray, box: list[int], colour: tuple[int, int, int], width: int) -> None:
    """Draw a rectangle's edge inside its bounds."""
    x0, y0, x1, y1 = (int(v) for v in box)
    for part in (np.s_[y0 : y0 + width, x0:x1], np.s_[max(y0, y1 - width) : y1, x0:x1], np.s_[y0:y1, x0 : x0 + width], np.s_[y0:y1, max(x0, x1 - width) : x1]):
        canvas[part] = colour


def render(collages: DataFrame, images: DataFrame, edges: bool = False, boxes: bool = False) -> DataFrame:
    """Each collage as (collage_index, path, content), in shards of a thousand.

    ``images`` has path and the struct that Spark's image source decodes.  One
    row for each layout meets its image in a join; the layouts of a canvas, some
    tens at most, are pasted together.  A layout whose image is missing stays blank.
    """
    shipped(collages.sparkSession)
    placed = collages.select("collage_index", "canvas", F.explode("layouts").alias("x")).withColumn("src", F.col("x.src_img"))
    decoded = images.select(F.col("path").alias("src"), F.col("image.data").alias("data"), F.col("image.height").alias("ih"), F.col("image.width").alias("iw"), F.col("image.nChannels").alias("channels"))
    rows = placed.join(decoded, "src", "left").select(
        "collage_index", F.col("canvas.width").alias("w"), F.col("canvas.height").alias("h"), F.col("canvas.bg_color").alias("bg"), F.col("x.layout_id").alias("n"), F.col("x.layout_bbox").alias("at"),
        F.col("x.img_crop_region").alias("crop"), F.col("x.image_type").alias("kind"), F.col("x.canvas_object_bbox").alias("box"), "data", "ih", "iw", "channels",
    )
    schema = T.StructType([T.StructField("collage_index", T.LongType()), T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n", kind="stable")
        first = frame.iloc[0]
        canvas = np.empty((int(first["h"]), int(first["w"]), 3), np.uint8)
        canvas[:] = np.array(first["bg"], np.uint8)
        for r in frame.to_dict("records"):
            x0, y0, x1, y1 = (int(v) for v in r["at"])
            if r["data"] is not None:
                pixels = rgb(r["data"], int(r["ih"]), int(r["iw"]), int(r["channels"]))
                if r["crop"] is not None:
                    a, b, c, d = (int(v) for v in r["crop"])
                    pixels = pixels[max(0, b) : max(0, d), max(0, a) : max(0, c)]
                if pixels.size:
                    canvas[y0:y1, x0:x1] = resized(pixels, x1 - x0, y1 - y0)
            if edges:
                outlined(canvas, r["at"], EDGES.get(str(r["kind"]).lower(), (0, 0, 0)), 3)
            if boxes and r["box"] is not None:
                outlined(canvas, r["box"], BOX, 5)
        i = int(first["collage_index"])
        return pd.DataFrame({"collage_index": [i], "path": [f"images/{i // 1000}/{i}.png"], "content": [png(canvas)]})

    return rows.groupBy("collage_index").applyInPandas(run, schema)


def write(files: DataFrame, folder: str) -> int:
    """K6: write files (path, content) under a folder of any store that Arrow knows; how many there are.

    A file is written under another name and then moved, so it is whole or not
    there, and a task that runs again writes the same.
    """
    shipped(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                target = f"{root.rstrip('/')}/{path}"
                store.create_dir(target.rpartition("/")[0])
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, target)
            yield pd.DataFrame({"path": frame["path"]})

    return files.select("path", "content").mapInPandas(run, "path string").count()


def missing_images(collages: DataFrame, listing: DataFrame) -> DataFrame:
    """Source images that collages name but that aren't there."""
    named = collages.select(F.explode("layouts.src_img").alias("image")).distinct()
    return named.join(listing.select(F.col("path").alias("image")), "image", "left_anti").withColumn("extension", text.extension(F.col("image")))
