"""Boxes, landmarks and pixel arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.groups import edges, whole_groups


def good_faces(faces: DataFrame, score: float = 0.65, side: float = 80, yaw: float = 40) -> DataFrame:
    """Faces (det_score, x1, y1, x2, y2, yaw) good enough to learn from."""
    least = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return faces.where((F.col("det_score") >= score) & (least >= side) & (F.abs("yaw") <= yaw))


def padded_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.25, least: float = 16) -> Column:
    """H9: a box padded by a share of its longer side, at least `least` wide and high, clamped to the frame: struct (x, y, w, h)."""
    p = F.greatest(w, h) * pad
    w2, h2 = F.greatest(w + 2 * p, F.lit(float(least))), F.greatest(h + 2 * p, F.lit(float(least)))
    x2, y2 = F.greatest(F.lit(0.0), x + w / 2 - w2 / 2), F.greatest(F.lit(0.0), y + h / 2 - h2 / 2)
    return F.struct(x2.alias("x"), y2.alias("y"), (F.least(width, x2 + w2) - x2).alias("w"), (F.least(height, y2 + h2) - y2).alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (x, y, w, h) over their union plus 1e-7."""
    over = lambda p, q: F.greatest(F.lit(0.0), F.least(a[p] + a[q], b[p] + b[q]) - F.greatest(a[p], b[p]))
    both = over("x", "w") * over("y", "h")
    return both / (a["w"] * a["h"] + b["w"] * b["h"] - both + 1e-7)


def sharpness(pixels: DataFrame) -> DataFrame:
    """H8: (image, sharpness): variance of the four-neighbour Laplacian over inner pixels of rows (image, x, y, v)."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    near = [F.lag("v").over(row), F.lead("v").over(row), F.lag("v").over(column), F.lead("v").over(column)]
    lap = pixels.withColumn("l", sum(near[1:], near[0]) - 4 * F.col("v")).where("l is not null")  # at a rim a neighbour is null
    return lap.groupBy("image").agg(F.greatest(F.lit(0.0), F.avg(F.col("l") * F.col("l")) - F.pow(F.avg("l"), F.lit(2))).alias("sharpness"))


def non_max_suppression(boxes: DataFrame, score: float = 0.5, overlap: float = 0.4) -> DataFrame:
    """The kept (image, box_id) of detections (image, box_id, score, x, y, w, h): best first, those that overlap a kept one go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "image"):
            at = edges(pdf["image"].to_numpy())
            end = np.repeat(at[1:], np.diff(at))
            x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
            left = np.ones(len(pdf), bool)
            for k in range(len(pdf)):
                if left[k] and k + 1 < end[k]:
                    rest = slice(k + 1, end[k])
                    both = np.maximum(0, np.minimum(x[k] + w[k], x[rest] + w[rest]) - np.maximum(x[k], x[rest])) * np.maximum(0, np.minimum(y[k] + h[k], y[rest] + h[rest]) - np.maximum(y[k], y[rest]))
                    left[rest] &= both / (w[k] * h[k] + w[rest] * h[rest] - both + 1e-7) <= overlap
            yield pdf[left][["image", "box_id"]]

    best = boxes.select("image", "box_id", F.col("score").cast("double").alias("score"), *"xywh").where(F.col("score") >= score)
    return best.repartition("image").sortWithinPartitions("image", F.isnan("score"), F.desc("score"), "box_id").mapInPandas(run, "image long, box_id long")


def similarity_transform(points: DataFrame) -> DataFrame:
    """I16: (face, a, b, tx, ty) of the best rotation with scale and shift from landmarks (face, x, y) to a template (u, v); the identity if degenerate.

    u = a x - b y + tx and v = b x + a y + ty; sums per face give the closed form.
    """
    s = points.groupBy("face").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyuv"], F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("q"),
                                   F.sum(F.col("x") * F.col("u") + F.col("y") * F.col("v")).alias("p"), F.sum(F.col("x") * F.col("v") - F.col("y") * F.col("u")).alias("r"))
    spread = F.col("q") - F.col("n") * (F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    a = (F.col("p") - F.col("n") * (F.col("mx") * F.col("mu") + F.col("my") * F.col("mv"))) / spread
    b = (F.col("r") - F.col("n") * (F.col("mx") * F.col("mv") - F.col("my") * F.col("mu"))) / spread
    fits = s.withColumn("ok", spread > 1e-9).withColumn("a", F.when(F.col("ok"), a).otherwise(1.0)).withColumn("b", F.when(F.col("ok"), b).otherwise(0.0))
    tx = F.col("mu") - F.col("a") * F.col("mx") + F.col("b") * F.col("my")
    ty = F.col("mv") - F.col("b") * F.col("mx") - F.col("a") * F.col("my")
    return fits.select("face", "a", "b", F.when(F.col("ok"), tx).otherwise(0.0).alias("tx"), F.when(F.col("ok"), ty).otherwise(0.0).alias("ty"))
