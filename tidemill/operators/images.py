"""Image inventory: type, size, dimensions, conversion plans and metadata summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import (
    extension_for,
    file_extension,
    image_height,
    image_width,
    operation_list,
    output_format,
    saved_share,
    sniff_type,
    upload_problem,
)

# Metadata keys worth showing, and EXIF tag numbers with their names.
INFO_KEYS = ["dpi", "jfif", "jfif_version", "jfif_unit", "jfif_density", "software", "comment"]
EXIF_NAMES = {
    "270": "image_description",
    "271": "make",
    "272": "model",
    "305": "software",
    "306": "date_time",
}


def inventory(files: DataFrame) -> DataFrame:
    """``(path, length, content)`` rows to one row per file; the bytes go no further than here."""
    kind = sniff_type(F.col("content"))
    return files.select(
        "path",
        file_extension(F.col("path")).alias("extension"),
        F.col("length").cast("long").alias("file_size"),
        kind.alias("format"),
        image_width(F.col("content")).alias("width"),
        image_height(F.col("content")).alias("height"),
        F.coalesce(
            upload_problem("image", F.col("path"), F.col("length")), F.when(kind.isNull(), F.lit("content"))
        ).alias("problem"),
    )


def format_plan(images: DataFrame) -> DataFrame:
    """Target format, file name, steps and save options per image.

    Input columns: original_format, requested_format, resize, resize_width, resize_height,
    compression, compression_quality. A target that is not supported leaves the plan null.
    """
    original = F.lower(F.col("original_format"))
    target = output_format(F.col("requested_format"), original)
    lossy = target.isin("jpeg", "webp")
    ok = target.isNotNull()
    return images.withColumns(
        {
            "result_format": F.upper(target),
            "processed_name": F.when(ok, F.concat(F.lit("processed"), extension_for(target))),
            "operations": F.when(ok, operation_list(F.col("resize"), target != original, F.col("compression"))),
            "quality": F.when(ok & F.col("compression") & lossy, F.col("compression_quality")),
            "optimize": F.coalesce(ok & F.col("compression") & (target == "png"), F.lit(False)),
            "result_width": F.when(ok & F.col("resize"), F.col("resize_width")),
            "result_height": F.when(ok & F.col("resize"), F.col("resize_height")),
        }
    )


def size_change(before: DataFrame, after: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Bytes before and after per group, and the share saved (negative when files grew)."""
    pairs = before.select(key, *by, F.col("size").alias("original_size")).join(
        after.select(key, F.col("size").alias("result_size")), key
    )
    per_file = saved_share(F.col("original_size"), F.col("result_size"))
    return pairs.withColumn("ratio", per_file).groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("original_size").alias("original_size"),
        F.sum("result_size").alias("result_size"),
        saved_share(F.sum("original_size"), F.sum("result_size")).alias("compression_ratio"),
        F.avg("ratio").alias("avg_file_ratio"),
    )


def metadata_summary(info: Column, exif: Column) -> Column:
    """The displayable part of two string maps: known info keys, and known EXIF tags by name."""
    names = F.create_map(*[F.lit(x) for pair in EXIF_NAMES.items() for x in pair])
    shown = F.map_filter(info, lambda k, v: k.isin(INFO_KEYS) & v.isNotNull())
    tags = F.map_filter(exif, lambda k, v: k.isin(list(EXIF_NAMES)) & v.isNotNull())
    renamed = F.transform_keys(tags, lambda k, v: F.concat(F.lit("exif."), F.element_at(names, k)))
    return F.map_concat(F.coalesce(shown, F.create_map().cast("map<string,string>")), F.coalesce(renamed, F.create_map().cast("map<string,string>")))
