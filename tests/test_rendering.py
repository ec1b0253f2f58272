"""Scaling, packing and pasting of images."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import collage, rendering
from tessella.sources import readers


def test_scaling_keeps_flat_areas_and_sums_weights():
    flat = np.full((7, 9, 3), 130, np.uint8)
    for w, h in ((3, 2), (20, 30), (9, 7)):
        assert (rendering.resized(flat, w, h) == 130).all() and rendering.resized(flat, w, h).shape == (h, w, 3)
    same = np.random.default_rng(1).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert (rendering.resized(same, 5, 6) == same).all()


def test_rendered_files_decode_to_what_was_pasted(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    red, blue = np.zeros((10, 20, 3), np.uint8), np.zeros((8, 8, 3), np.uint8)
    red[:, :10], red[:, 10:], blue[:] = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    (source / "a.png").write_bytes(rendering.png(red))
    (source / "b.png").write_bytes(rendering.png(blue))
    blank = {f.name: None for f in collage.COLLAGE["layouts"].dataType.elementType.fields}
    layouts = [
        {**blank, "layout_id": 1, "layout_bbox": [0, 0, 40, 20], "src_img": "a.png", "img_crop_region": [10, 0, 20, 10], "image_type": "core", "canvas_object_bbox": [2, 2, 8, 8]},
        {**blank, "layout_id": 2, "layout_bbox": [40, 0, 60, 30], "src_img": "b.png", "image_type": "fill"},
        {**blank, "layout_id": 3, "layout_bbox": [0, 20, 40, 30], "src_img": "gone.png", "image_type": "alt"},
    ]
    canvas = {"width": 60, "height": 30, "aspect_ratio": 2.0, "grid": 1, "margin_g": 0, "bg_color": [255, 255, 255], "layout_count": 3, "core_count": 1, "alt_count": 1, "fill_count": 1}
    made = spark.createDataFrame([(1234, canvas, layouts)], collage.COLLAGE)
    images = readers.images(spark, str(source), decoded=True).withColumn("path", F.regexp_extract("image.origin", "([^/]+)$", 1))
    out = rendering.render(made, images, edges=True).first()
    assert out["path"] == "images/1/1234.png"
    (tmp_path / "out").mkdir()
    (tmp_path / "out/1234.png").write_bytes(out["content"])
    back = readers.images(spark, str(tmp_path / "out"), decoded=True).select("image.*").first()
    pixels = rendering.rgb(bytes(back["data"]), back["height"], back["width"], back["nChannels"])
    assert pixels.shape == (30, 60, 3)
    assert tuple(pixels[10, 20]) == (0, 255, 0) and tuple(pixels[15, 50]) == (0, 0, 255) and tuple(pixels[25, 20]) == (255, 255, 255)
    assert tuple(pixels[0, 5]) == (255, 0, 0) and tuple(pixels[29, 45]) == (0, 200, 0)
    assert [r["image"] for r in rendering.missing_images(made, images.select("path")).collect()] == ["gone.png"]
