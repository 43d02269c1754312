"""Label augmentation. Random choices are hashes of ids, so a plan is the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxspark.functions.geometry import clipped
from boxspark.operators.stats import hash_unit


def augmented(labels: DataFrame, n: int = 2, seed: int = 7, shift: float = 0.1) -> DataFrame:
    """labels with variant 0 (as they are) to n: each variant of an image may flip (half of a half), and may move by up
    to ``shift`` of the width; centres are cut to the image."""
    rows = labels.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n))))
    chance = lambda what: hash_unit(F.col("image_id"), F.col("variant"), F.lit(what), F.lit(seed))
    own = F.col("variant") > 0
    flip = own & (chance("flip") < 0.25)
    moves = own & (chance("move") < 0.5)
    cx = F.when(flip, F.lit(1.0) - F.col("cx")).otherwise(F.col("cx"))
    cx = F.when(moves, cx + (chance("by") * 2.0 - 1.0) * F.lit(shift)).otherwise(cx)
    return rows.withColumn("cx", F.when(own, clipped(cx)).otherwise(F.col("cx")))


def mosaic(labels: DataFrame, images: DataFrame, fix: bool = False, seed: int = 7) -> DataFrame:
    """mosaic_id, tile, and labels on it: images in fours by a seeded hash (inside hash buckets, so no global sort).

    Tiles 1 to 3 put their centres into their quadrant; with ``fix`` tile 0 does too and sizes are halved."""
    bucket = F.substring(F.md5(F.concat_ws("|", F.col("image_id").cast("string"), F.lit(str(seed))).cast("binary")), 1, 2)
    at = F.row_number().over(Window.partitionBy("bucket").orderBy(F.md5(F.col("image_id").cast("string").cast("binary")), "image_id")) - 1
    quads = images.select("image_id", bucket.alias("bucket")).withColumn("_at", at)
    quads = quads.select("image_id", F.concat_ws("-", "bucket", F.expr("cast(_at div 4 as string)")).alias("mosaic_id"), (F.col("_at") % 4).alias("tile"))
    rows = labels.join(quads, "image_id")
    right, low, first = F.col("tile") % 2, F.expr("cast(tile div 2 as int)"), (F.col("tile") == 0) & F.lit(not fix)
    half = 2.0 if fix else 1.0
    return rows.select(
        "mosaic_id", "tile", "image_id", "box_idx", "class_id",
        F.when(first, F.col("cx")).otherwise((F.col("cx") + right) / 2).alias("cx"), F.when(first, F.col("cy")).otherwise((F.col("cy") + low) / 2).alias("cy"),
        (F.col("w") / half).alias("w"), (F.col("h") / half).alias("h"),
    )


def mixup(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """mix_id and the boxes of both images of each pair (mix_id, a, b)."""
    sides = pairs.select("mix_id", F.explode(F.array("a", "b")).alias("image_id"))
    return labels.join(sides, "image_id")
