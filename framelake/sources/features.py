"""Feature rows of photos: one pass over decoded pixels, one over raw contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import parse_exif_time, parse_f_number
from . import kernels

FEATURES = (
    "key string, phash_hex string, sharpness double, exposure_score double, orb array<binary>, histogram array<int>, hsv_histogram array<double>, grid_sharps array<double>"
)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded photos; files that cannot be decoded are left out."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.concat(F.lit("file:"), "image.origin").alias("key"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def extract(photos: DataFrame) -> DataFrame:
    """Features of decoded photos (key, height, width, channels, data in BGR), measured on at most 640 pixels a side."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                img = kernels.shrink(np.repeat(img, 3, 2) if r.channels == 1 else img[..., :3]).round().astype(np.uint8)
                sharp, grid = kernels.sharpness(img)
                score, hist = kernels.exposure(img)
                rows.append((r.key, kernels.phash(img), sharp, score, kernels.descriptors(img), hist, kernels.hsv_histogram(img), grid))
            yield pd.DataFrame(rows, columns=["key", "phash_hex", "sharpness", "exposure_score", "orb", "histogram", "hsv_histogram", "grid_sharps"])

    return photos.mapInPandas(run, FEATURES)


def exif_of(files: DataFrame) -> DataFrame:
    """(key, f_number, shutter, iso, captured_at) of files with content; only the first 256 KB is looked at."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([{"key": k, **kernels.exif(c)} for k, c in zip(part["key"], part["content"], strict=True)], columns=["key", "f_number", "shutter", "iso", "time"])

    raw = files.select("key", F.substring("content", 1, 256 << 10).alias("content")).mapInPandas(run, "key string, f_number string, shutter string, iso string, time string")
    return raw.select("key", parse_f_number(F.col("f_number")).alias("f_number"), "shutter", "iso", parse_exif_time(F.col("time")).alias("captured_at"))


def previews(files: DataFrame) -> DataFrame:
    """(key, content) with the longest embedded preview of raw files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "content": [kernels.embedded_jpeg(c) for c in part["content"]]})

    return files.select("key", "content").mapInPandas(run, "key string, content binary")


def focus_masks(photos: DataFrame) -> DataFrame:
    """(key, mask_png) of decoded photos, at full size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            masks = [kernels.mask_png(kernels.focus_mask(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[..., :3])) for r in part.itertuples()]
            yield pd.DataFrame({"key": part["key"], "mask_png": masks})

    return photos.mapInPandas(run, "key string, mask_png binary")
