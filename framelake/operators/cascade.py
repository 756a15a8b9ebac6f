"""Faces and eyes that a cascade of detectors finds, rolled up to photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rules: least sides of a face and an eye, width from which a face without eyes counts as closed, share of
#: the largest face that a main face has, and the eyes' sharpness that counts as full.
FACE, EYE, CLOSED_WIDTH, MAIN_SHARE, FULL = 48, 16, 120, 0.25, 1000.0


def cascade_faces(detections: DataFrame, key: str = "key") -> DataFrame:
    """(key, face, x, y, w, h, sharpness, primary, n_eyes, eyes_closed, both_eyes, eye_total, n_sharp): main faces with what their eyes say.

    `detections`: key, id, kind ('face' or 'eye'), x, y, w, h, sharpness (of the region). Eyes belong to each main face of their photo that
    contains their whole box, so to several where faces overlap. Too small faces and eyes, and those with a null box, are none.
    """
    sided = lambda kind, least: detections.where((F.col("kind") == kind) & (F.col("w") >= least) & (F.col("h") >= least) & F.col("x").isNotNull() & F.col("y").isNotNull())
    faces = sided("face", FACE).select(key, F.col("id").alias("face"), "x", "y", "w", "h", "sharpness", (F.col("w") * F.col("h")).alias("area"))
    # The largest face, the first of equals, as far as ids order them.
    largest = faces.groupBy(key).agg(F.max("area").alias("top"), F.max_by("face", F.struct("area", -F.col("face"))).alias("first"))
    main = faces.join(largest, key).where(F.col("area") >= F.col("top") * MAIN_SHARE).withColumn("primary", F.col("face") == F.col("first")).drop("area", "top", "first")
    eyes = sided("eye", EYE).select(F.col(key).alias("photo"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("w").alias("ew"), F.col("h").alias("eh"), F.col("sharpness").alias("es"))
    inside = (F.col("ex") >= F.col("x")) & (F.col("ey") >= F.col("y")) & (F.col("ex") + F.col("ew") <= F.col("x") + F.col("w")) & (F.col("ey") + F.col("eh") <= F.col("y") + F.col("h"))
    met = main.join(eyes, (F.col(key) == F.col("photo")) & inside, "left")
    sharp = F.col("es") > 0
    told = met.groupBy(key, "face").agg(
        *[F.first(c).alias(c) for c in ("x", "y", "w", "h", "sharpness", "primary")], F.count("photo").alias("n_eyes"),
        F.coalesce(F.sum(F.when(sharp, F.col("es"))), F.lit(0.0)).alias("eye_total"), F.count_if(sharp).alias("n_sharp"),
    )
    return told.withColumn("eyes_closed", (F.col("n_eyes") == 0) & (F.col("w") >= CLOSED_WIDTH)).withColumn("both_eyes", F.col("n_eyes") >= 2)


def cascade_photos(photos: DataFrame, detections: DataFrame, key: str = "key") -> DataFrame:
    """`photos` with has_face, face_x, face_y, face_w, face_h (of the primary face), n_faces, face_sharpness (mean), eyes_closed (any), both_eyes (all), eye_sharpness
    (mean of those above 0, a thousandth, within 0 and 1; null without). Photos without a face have false and nulls."""
    faces = cascade_faces(detections, key)
    box = F.max_by(F.struct("x", "y", "w", "h"), F.col("primary").cast("int"))
    eye = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum("eye_total") / F.sum("n_sharp") / FULL))
    rolled = faces.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_faces"), box.alias("box"), F.avg("sharpness").alias("face_sharpness"), F.max("eyes_closed").alias("eyes_closed"),
        F.min("both_eyes").alias("both_eyes"), F.when(F.sum("n_sharp") > 0, eye).alias("eye_sharpness"),
    )
    met = photos.join(rolled, key, "left")
    sides = {f"face_{c}": F.col(f"box.{c}") for c in "xywh"}
    no = F.lit(False)
    return met.withColumns({"has_face": F.col("n_faces").isNotNull(), **sides, "n_faces": F.coalesce("n_faces", F.lit(0)), "eyes_closed": F.coalesce("eyes_closed", no), "both_eyes": F.coalesce("both_eyes", no)}).drop("box")
