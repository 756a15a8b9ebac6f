"""Face and eye rules over arrays of detections, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def main_faces(faces: Column, share: float = 0.25) -> Column:
    """Faces whose area is at least `share` of the largest one's; a face is a struct with w and h."""
    largest = F.array_max(F.transform(faces, lambda f: f.w * f.h))
    return F.filter(faces, lambda f: f.w * f.h >= share * largest)


def primary_face(faces: Column) -> Column:
    """The face of the largest area, the first of equals."""
    largest = F.array_max(F.transform(faces, lambda f: f.w * f.h))
    return F.get(F.filter(faces, lambda f: f.w * f.h == largest), F.lit(0))


def eyes_closed(left: Column, right: Column) -> Column:
    """By probabilities of open eyes: both known and their mean under 0.4 or one under 0.2; or the one known under 0.4."""
    both = left.isNotNull() & right.isNotNull()
    return F.coalesce(F.when(both, ((left + right) / 2 < 0.4) | (left < 0.2) | (right < 0.2)).otherwise(F.coalesce(left, right) < 0.4), F.lit(False))


def face_quality(faces: Column) -> Column:
    """Best face: the mean of its known probabilities (smile, left_open, right_open), within 0 and 1; 0 without any."""

    def one(f: Column) -> Column:
        parts = F.filter(F.array(f.smile, f.left_open, f.right_open), lambda x: x.isNotNull())
        return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))

    best = F.array_max(F.filter(F.transform(faces, one), lambda x: x.isNotNull()))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0))))


def face_summary(faces: Column) -> Column:
    """Over a photo's faces: mean sharpness, mean of positive eye sharpness, any eyes closed, all with both eyes, least open eye."""
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))
    opened = F.transform(faces, lambda f: F.coalesce(F.least(f.left_open, f.right_open), f.left_open, f.right_open))
    return F.struct(
        mean(F.transform(faces, lambda f: f.sharpness)).alias("face_sharpness"),
        mean(F.filter(F.transform(faces, lambda f: f.eye_sharpness), lambda x: x > 0)).alias("eye_sharpness"),
        F.exists(faces, lambda f: eyes_closed(f.left_open, f.right_open)).alias("eyes_closed"),
        F.forall(faces, lambda f: f.left_open.isNotNull() & f.right_open.isNotNull()).alias("both_eyes_detected"),
        F.array_min(F.filter(opened, lambda x: x.isNotNull())).alias("eye_open"),
    )


def portrait_blend(sharpness: Column, has_face: Column, face_sharpness: Column, eye_sharpness: Column, closed: Column) -> Column:
    """Sharpness of a portrait: the face's where known, blended with the eyes' where known, a fifth of it with closed eyes."""
    faced = F.when(has_face & (face_sharpness > 0), face_sharpness).otherwise(sharpness)
    eyed = F.when(has_face & (eye_sharpness > 0), 0.4 * faced + 0.6 * eye_sharpness).otherwise(faced)
    return F.when(has_face & closed, eyed * 0.2).otherwise(eyed)


def mean_top4(cells: Column) -> Column:
    """Mean of the four largest cells."""
    return F.aggregate(F.slice(F.sort_array(cells, asc=False), 1, 4), F.lit(0.0), lambda s, x: s + x) / 4


def top4_cells(cells: Column) -> Column:
    """Indexes (from 0) of the four largest cells, largest first, the first of equals."""
    pairs = F.transform(cells, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs), 1, 4), lambda p: p.i)


def exposure_score(hist: Column, mean: Column) -> Column:
    """(1 - clipped share)(1 - 0.15 |mean - 127| / 127) of a histogram of 256 bins; clipped are bins 0-5 and 250-255."""
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda s, x: s + x)
    clipped = F.aggregate(F.concat(F.slice(hist, 1, 6), F.slice(hist, 251, 6)), F.lit(0).cast("long"), lambda s, x: s + x)
    score = (1 - clipped / total) * (1 - 0.15 * F.abs(mean - 127) / 127)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
