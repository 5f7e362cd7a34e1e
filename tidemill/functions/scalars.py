"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cell texts that mean "missing" when a CSV file is read.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Accepted image formats and the extension each is written with.
IMAGE_EXTENSIONS = {"jpeg": ".jpg", "png": ".png", "webp": ".webp", "gif": ".gif"}
# What may be uploaded.
UPLOAD_EXTENSIONS = {"csv": [".csv"], "image": [".jpg", ".jpeg", ".png", ".webp", ".gif"]}
MAX_UPLOAD_BYTES = 10 * 1024 * 1024


def is_blank(c: Column) -> Column:
    """A present string of white space only (the empty string counts)."""
    return c.isNotNull() & c.rlike(r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]*$")


def strip(c: Column) -> Column:
    """Remove white space of every kind on both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$", "")


def null_token_to_null(c: Column) -> Column:
    return F.when(~c.isin(NULL_TOKENS), c)


def hhmm_minutes(c: Column) -> Column:
    """Minutes after midnight of a five-character ``HH:MM`` text, else null."""
    text = strip(c)
    ok = text.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]$")
    return F.when(ok, F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int"))


def whole_number(c: Column) -> Column:
    """A whole number with optional sign, else null (no digit grouping, no fractions)."""
    text = strip(c)
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def finite_number(c: Column) -> Column:
    """A plain or scientific decimal number, else null; ``inf`` and ``nan`` are refused."""
    text = strip(c)
    shape = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    number = F.when(text.rlike(shape), text.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def saved_share(before: Column, after: Column) -> Column:
    """(before - after) / before, 0 when there was nothing; negative when it grew."""
    return F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0))


def improvement_pct(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before * 100).otherwise(F.lit(0.0))


def output_format(requested: Column, original: Column) -> Column:
    """Target format of an image: its own for ``original``; ``jpg`` is ``jpeg``; null if unsupported."""
    wanted = F.lower(F.when(F.lower(requested) == "original", original).otherwise(requested))
    wanted = F.when(wanted == "jpg", F.lit("jpeg")).otherwise(wanted)
    return F.when(wanted.isin(list(IMAGE_EXTENSIONS)), wanted)


def extension_for(fmt: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, ext in IMAGE_EXTENSIONS.items():
        out = F.when(fmt == name, F.lit(ext)).otherwise(out)
    return out


def operation_list(resize: Column, convert: Column, compress: Column) -> Column:
    """The steps that apply, in the order they are run."""
    steps = F.array(
        F.when(resize, F.lit("resize")),
        F.when(convert, F.lit("format_conversion")),
        F.when(compress, F.lit("compression")),
    )
    return F.array_compact(steps)


def sniff_type(content: Column) -> Column:
    """Image type from the first bytes of a file."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), F.lit("jpeg"))
        .when(head.startswith("89504E470D0A1A0A"), F.lit("png"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("gif"))
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))
    )


def _number(content: Column, start: int, length: int, little: bool = False) -> Column:
    part = F.hex(F.substring(content, start, length))
    if little:
        part = F.concat(*[F.substring(part, 2 * i + 1, 2) for i in reversed(range(length))])
    return F.conv(part, 16, 10).cast("int")


def image_width(content: Column) -> Column:
    kind = sniff_type(content)
    return F.when(kind == "png", _number(content, 17, 4)).when(kind == "gif", _number(content, 7, 2, little=True))


def image_height(content: Column) -> Column:
    kind = sniff_type(content)
    return F.when(kind == "png", _number(content, 21, 4)).when(kind == "gif", _number(content, 9, 2, little=True))


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def upload_problem(kind: str, path: Column, size: Column) -> Column:
    """First reason to refuse a file, null when it is fine."""
    return (
        F.when(size > MAX_UPLOAD_BYTES, F.lit("too_large"))
        .when(size == 0, F.lit("empty"))
        .when(~file_extension(path).isin(UPLOAD_EXTENSIONS[kind]), F.lit("extension"))
    )


def readable_text(raw: Column) -> Column:
    """Bytes as UTF-8 text, broken sequences replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def json_number(c: Column) -> Column:
    """NaN and infinities have no JSON form and become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
