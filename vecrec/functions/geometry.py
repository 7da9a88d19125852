"""Box and keypoint measures as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: feature order
FEATURE_NAMES = (
    "face_aspect",
    "eye_spacing",
    "eye_position_y",
    "nose_length",
    "philtrum",
    "chin_length",
    "mouth_width",
    "mouth_to_eye_ratio",
    "nose_offset_x",
    "lower_face_ratio",
)
MIN_LENGTH = 1e-6


def box_metrics(box: str, width: str, height: str) -> dict[str, Column]:
    """Clipped box width and height, and its share of the picture area."""
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    w, h = F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0)
    return {"box_width": w, "box_height": h, "area_ratio": w * h / F.greatest(F.lit(1.0), F.col(width) * F.col(height))}


def detection_quality(score: Column, area_ratio: Column) -> Column:
    return F.round(score * F.least(F.lit(1.0), area_ratio * 10.0), 4)


def keypoint_features(df: DataFrame, box: str, points: str, out: str = "features") -> DataFrame:
    """Ten ratios from a box and five points (two eyes, nose, two mouth corners) after levelling the eyes.

    ``points`` is ``array<array<double>>``. Null when there are not five points or a length is degenerate.
    """
    def xy(i: int) -> tuple[Column, Column]:
        p = F.get(points, F.lit(i))
        return F.get(p, F.lit(0)), F.get(p, F.lit(1))

    (lx, ly), (rx, ry) = xy(0), xy(1)
    gap = F.sqrt((rx - lx) ** 2 + (ry - ly) ** 2)
    usable = (F.size(points) == 5) & (gap >= MIN_LENGTH)
    turned = df.withColumn("__a", -F.atan2(ry - ly, rx - lx)).withColumn("__mx", (lx + rx) / 2).withColumn("__my", (ly + ry) / 2)
    cos, sin = F.cos("__a"), F.sin("__a")

    def level(x: Column, y: Column) -> Column:
        dx, dy = x - F.col("__mx"), y - F.col("__my")
        return F.struct((cos * dx - sin * dy).alias("x"), (sin * dx + cos * dy).alias("y"))

    b = [F.get(box, F.lit(i)) for i in range(4)]
    corners = [level(b[i], b[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
    turned = turned.withColumn("__p", F.array(*[level(*xy(i)) for i in range(5)])).withColumn("__c", F.array(*corners))
    turned = (
        turned.withColumn("__x0", F.array_min(F.transform("__c", lambda c: c["x"])))
        .withColumn("__x1", F.array_max(F.transform("__c", lambda c: c["x"])))
        .withColumn("__y0", F.array_min(F.transform("__c", lambda c: c["y"])))
        .withColumn("__y1", F.array_max(F.transform("__c", lambda c: c["y"])))
        .withColumn("__w", F.col("__x1") - F.col("__x0"))
        .withColumn("__h", F.col("__y1") - F.col("__y0"))
    )
    p = [F.get("__p", F.lit(i)) for i in range(5)]
    w, h = F.col("__w"), F.col("__h")

    def length(a: Column, c: Column) -> Column:
        return F.sqrt((a["x"] - c["x"]) ** 2 + (a["y"] - c["y"]) ** 2)

    # guarded divisor: ANSI division by zero must not fail rows that end as null
    safe_w, safe_h = F.greatest(w, F.lit(MIN_LENGTH)), F.greatest(h, F.lit(MIN_LENGTH))
    eye = length(p[1], p[0])
    eye_y, mouth_y = (p[0]["y"] + p[1]["y"]) / 2, (p[3]["y"] + p[4]["y"]) / 2
    rel = lambda y: (y - F.col("__y0")) / safe_h
    middle = F.greatest(rel(p[2]["y"]) - rel(eye_y), F.lit(MIN_LENGTH))
    lower = F.greatest(1.0 - rel(mouth_y), F.lit(MIN_LENGTH))
    mouth = length(p[4], p[3])
    values = [
        w / safe_h,
        eye / safe_w,
        rel(eye_y),
        middle,
        F.greatest(rel(mouth_y) - rel(p[2]["y"]), F.lit(0.0)),
        lower,
        mouth / safe_w,
        mouth / F.greatest(eye, F.lit(MIN_LENGTH)),
        (p[2]["x"] - (p[0]["x"] + p[1]["x"]) / 2) / safe_w,
        lower / middle,
    ]
    fine = usable & (w >= MIN_LENGTH) & (h >= MIN_LENGTH)
    built = turned.withColumn(out, F.when(fine, F.struct(*[v.alias(n) for n, v in zip(FEATURE_NAMES, values)])))
    return built.drop(*[c for c in built.columns if c.startswith("__")])
