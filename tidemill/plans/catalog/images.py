"""Image queries. The tables hold no image files, so headers, formats and sizes are derived
from their rows; real files go through ``sources.files.read_images``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.scalars import sniff_type, upload_problem
from tidemill.operators import images as I
from tidemill.plans.catalog.profile import rounded
from tidemill.plans.session import load, work_dir
from tidemill.sources.files import read_heads, write_files


def be(c, width):
    return F.lpad(F.hex(c), 2 * width, "0")


def le16(c):
    text = be(c, 2)
    return F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))


def files(s, d):
    """One file per document: the language picks the type, the text length the dimensions."""
    w, h = F.col("n_chars") % 5000 + 1, F.col("doc_id") % 3000 + 1
    header = (
        F.when(F.col("lang") == "en", F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4)))
        .when(F.col("lang") == "de", F.concat(F.lit("474946383961"), le16(w), le16(h)))
        .when(F.col("lang") == "fr", F.lit("FFD8FFE000104A4649460001"))
        .when(F.col("lang") == "es", F.lit("524946462400000057454250"))
        .otherwise(F.lit("25504446"))
    )
    ext = (
        F.when(F.col("n_chars") < 300, F.lit(".txt"))
        .when(F.col("lang") == "en", F.lit(".png"))
        .when(F.col("lang") == "de", F.lit(".GIF"))
        .otherwise(F.lit(".jpg"))
    )
    return load(s, d, "documents").select(
        "doc_id",
        F.concat(F.lit("/images/"), F.col("doc_id").cast("string"), ext).alias("path"),
        (F.col("n_chars") * 1000).alias("length"),
        F.unhex(header).alias("content"),
    )


FILES = """f AS (SELECT doc_id, lang, n_chars % 5000 + 1 AS w, doc_id % 3000 + 1 AS h, n_chars * 1000 AS size,
  CASE WHEN n_chars < 300 THEN '.txt' WHEN lang = 'en' THEN '.png' WHEN lang = 'de' THEN '.GIF' ELSE '.jpg' END AS ext,
  CASE lang WHEN 'en' THEN 'png' WHEN 'de' THEN 'gif' WHEN 'fr' THEN 'jpeg' WHEN 'es' THEN 'webp' END AS format FROM documents)"""


def q_image_files(s, d):
    """Real files, written one by one and listed again by their first bytes; some are longer than what is read of them."""
    folder = work_dir(s, "image-files")
    long = F.when(F.col("doc_id") % 50 == 0, F.unhex(F.repeat(F.lit("00"), 100_000))).otherwise(F.unhex(F.lit("00")))
    # a folder for about a thousandth of the files, so that they are listed by many tasks
    name = F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(1000)).cast("string"), F.regexp_replace("path", "^/images/", "/"))
    write_files(files(s, d).select(name.alias("name"), F.concat("content", long).alias("content")), folder)
    found = I.inventory(read_heads(s, folder, "*"))
    return found.withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))


def wishes(s, d):
    """One conversion request per part."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    original = (
        F.when(size <= 10, F.lit("JPEG")).when(size <= 20, F.lit("PNG")).when(size <= 30, F.lit("WEBP")).when(size <= 40, F.lit("GIF")).otherwise(F.lit("BMP"))
    )
    wanted = (
        F.when(F.col("p_type") == "ECONOMY", F.lit("original"))
        .when(F.col("p_type") == "STANDARD", F.lit("jpg"))
        .when(F.col("p_type") == "PROMO", F.lit("PNG"))
        .otherwise(F.lit("webp"))
    )
    return load(s, d, "part").select(
        "p_partkey",
        original.alias("original_format"),
        wanted.alias("requested_format"),
        (price > 950).alias("resize"),
        (size * 10).alias("resize_width"),
        (size * 20).alias("resize_height"),
        (size > 15).alias("compression"),
        (size + 40).alias("compression_quality"),
    )


def q_plan(s, d):
    plan = I.format_plan(wishes(s, d))
    return plan.select(
        "p_partkey", "result_format", "processed_name", F.array_join("operations", ",").alias("operations"), "quality", "optimize",
        "result_width", "result_height",
    )


def page_sizes(s, d, stripped):
    html = F.regexp_replace("html", "<[^>]*>", "") if stripped else F.col("html")
    return load(s, d, "pages").select("page_id", F.regexp_extract("url", r"^([a-z]+):", 1).alias("scheme"), F.octet_length(html).cast("long").alias("size"))


def q_metadata(s, d):
    """Metadata maps of each event, reduced to what is shown: one row per entry."""
    k = F.get_json_object("props", "$.k")
    info = F.create_map(
        F.lit("dpi"), k, F.lit("icc_profile"), k, F.lit("software"), F.col("event_type"), F.lit("comment"), F.when(F.col("value") > 20, F.lit("big"))
    )
    exif = F.create_map(F.lit("271"), F.col("event_type"), F.lit("306"), F.col("user_id").cast("string"), F.lit("37510"), k)
    return load(s, d, "events").select("event_id", F.explode(I.metadata_summary(info, exif)).alias("key", "value"))


QUERIES = {
    "image_files": q_image_files,
    "sniff_type": lambda s, d: files(s, d).select("doc_id", sniff_type(F.col("content")).alias("format")),
    "image_inventory": lambda s, d: I.inventory(files(s, d)),
    "file_gate": lambda s, d: files(s, d).select("doc_id", upload_problem("image", F.col("path"), F.col("length")).alias("problem")),
    "format_plan": q_plan,
    "size_change_report": lambda s, d: rounded(I.size_change(page_sizes(s, d, False), page_sizes(s, d, True), "page_id", ["scheme"]), 6),
    "metadata_summary": q_metadata,
}

PROBLEM = "CASE WHEN size > 10485760 THEN 'too_large' WHEN size = 0 THEN 'empty' WHEN ext = '.txt' THEN 'extension' END"

SQL = {
    "sniff_type": f"WITH {FILES} SELECT doc_id, format FROM f",
    "image_files": f"""WITH {FILES}, b AS (SELECT *, CASE format WHEN 'png' THEN 24 WHEN 'gif' THEN 10 WHEN 'jpeg' THEN 12 WHEN 'webp' THEN 12 ELSE 4 END
    + CASE WHEN doc_id % 50 = 0 THEN 100000 ELSE 1 END AS bytes FROM f)
SELECT concat(doc_id, ext) AS path, lower(ext) AS extension, bytes::BIGINT AS file_size, format,
  CASE WHEN format IN ('png', 'gif') THEN w::INTEGER END AS width, CASE WHEN format IN ('png', 'gif') THEN h::INTEGER END AS height,
  CASE WHEN ext = '.txt' THEN 'extension' WHEN format IS NULL THEN 'content' END AS problem FROM b""",
    "image_inventory": f"""WITH {FILES} SELECT concat('/images/', doc_id, ext) AS path, lower(ext) AS extension, size AS file_size, format,
  CASE WHEN format IN ('png', 'gif') THEN w::INTEGER END AS width, CASE WHEN format IN ('png', 'gif') THEN h::INTEGER END AS height,
  coalesce({PROBLEM}, CASE WHEN format IS NULL THEN 'content' END) AS problem FROM f""",
    "file_gate": f"WITH {FILES} SELECT doc_id, {PROBLEM} AS problem FROM f",
    "format_plan": """WITH w AS (SELECT *, CASE WHEN p_size <= 10 THEN 'jpeg' WHEN p_size <= 20 THEN 'png' WHEN p_size <= 30 THEN 'webp' WHEN p_size <= 40 THEN 'gif' ELSE 'bmp' END AS orig FROM part),
  t AS (SELECT *, CASE p_type WHEN 'ECONOMY' THEN CASE WHEN orig = 'bmp' THEN NULL ELSE orig END WHEN 'STANDARD' THEN 'jpeg' WHEN 'PROMO' THEN 'png' ELSE 'webp' END AS target FROM w)
SELECT p_partkey, upper(target) AS result_format,
  CASE target WHEN 'jpeg' THEN 'processed.jpg' WHEN 'png' THEN 'processed.png' WHEN 'webp' THEN 'processed.webp' WHEN 'gif' THEN 'processed.gif' END AS processed_name,
  CASE WHEN target IS NOT NULL THEN concat_ws(',', CASE WHEN p_retailprice > 950 THEN 'resize' END, CASE WHEN target <> orig THEN 'format_conversion' END, CASE WHEN p_size > 15 THEN 'compression' END) END AS operations,
  CASE WHEN target IN ('jpeg', 'webp') AND p_size > 15 THEN p_size + 40 END AS quality,
  coalesce(target = 'png' AND p_size > 15, false) AS optimize,
  CASE WHEN target IS NOT NULL AND p_retailprice > 950 THEN p_size * 10 END AS result_width,
  CASE WHEN target IS NOT NULL AND p_retailprice > 950 THEN p_size * 20 END AS result_height
FROM t""",
    "size_change_report": """WITH s AS (SELECT regexp_extract(url, '^([a-z]+):', 1) AS scheme, strlen(html)::BIGINT AS o, strlen(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS r FROM pages)
SELECT scheme, count(*) AS files, sum(o)::BIGINT AS original_size, sum(r)::BIGINT AS result_size,
  round((sum(o) - sum(r)) / sum(o)::DOUBLE, 6) AS compression_ratio, round(avg(CASE WHEN o > 0 THEN (o - r) / o::DOUBLE ELSE 0 END), 6) AS avg_file_ratio
FROM s GROUP BY 1""",
    "metadata_summary": """SELECT event_id, 'dpi' AS key, json_extract_string(props, '$.k') AS value FROM events
UNION ALL SELECT event_id, 'software', event_type FROM events
UNION ALL SELECT event_id, 'comment', 'big' FROM events WHERE value > 20
UNION ALL SELECT event_id, 'exif.make', event_type FROM events
UNION ALL SELECT event_id, 'exif.date_time', user_id::VARCHAR FROM events""",
}
