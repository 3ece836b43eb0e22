"""Reading listings: delimited files with mapped columns, run artifacts in JSON, several sources at once, pages with embedded data."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotscope.functions.text import fingerprint

LISTING = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("listing_id", "source", "source_url", "seller_fingerprint", "seller_type", "make", "model", "trim", "color", "province", "price_status", "price_kind", "product_class", "mileage_status", "condition")]
    + [T.StructField("year_jalali", T.IntegerType()), T.StructField("mileage_km", T.LongType()), T.StructField("asking_price_toman", T.LongType()), T.StructField("document_issue", T.BooleanType()), T.StructField("dealer_badge", T.BooleanType())]
)
RUN = T.StructType([T.StructField(c, T.StringType()) for c in ("schema", "run_id", "source", "collected_on", "promoted_on")] + [T.StructField("listings", T.ArrayType(LISTING))])
RUN_SCHEMA_PREFIX = "corpus/"
#: Keys that must not stand in a published row at any depth.
FORBIDDEN = {"phone", "mobile", "email", "seller_name", "contact", "address", "description"}


def whole_number(text: Column) -> Column:
    """A number as typed, with separators; null if it isn't one."""
    return F.regexp_replace(text, "[,٬ ]", "").try_cast("double").cast("long")


def read_delimited(spark: SparkSession, path: str, columns: Mapping[str, str], source: str, salt: str, numbers: tuple[str, ...] = ("asking_price_toman", "mileage_km", "year_jalali"), sep: str = ",") -> DataFrame:
    """Rows of delimited files under our names. `columns`: our name -> theirs. A seller's name is hashed on the way in and never kept."""
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    out = []
    for ours, theirs in columns.items():
        c = F.col(f"`{theirs}`") if theirs in raw.columns else F.lit(None).cast("string")
        out.append(fingerprint(c, salt).alias("seller_fingerprint") if ours == "seller" else (whole_number(c) if ours in numbers else c).alias(ours))
    return raw.select(F.lit(source).alias("source"), F.lit("ok").alias("status"), *out)


def collected(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """All sources' rows. One that fails gives a single row of unknown status, not nothing: its absence is no evidence."""
    parts = []
    for name, read in sources.items():
        try:
            df = read()
            df.schema  # resolves paths and columns
            parts.append(df)
        except Exception as e:  # noqa: BLE001  whatever the source raises, the others go on
            parts.append(spark.createDataFrame([(name, "unknown", type(e).__name__)], "source string, status string, error string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Listings of run artifacts with run_id and position; keys that aren't known are ignored, missing ones are null."""
    runs = spark.read.schema(RUN).option("multiLine", True).json(path).where(F.col("schema").startswith(RUN_SCHEMA_PREFIX))
    return runs.select("run_id", F.col("source").alias("run_source"), "collected_on", F.posexplode("listings").alias("position", "x")).select("run_id", "run_source", "collected_on", "position", "x.*")


def identities(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files as they are on disk, not as they would be written again."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def forbidden_keys(schema: T.DataType, at: str = "") -> list[str]:
    """Paths of forbidden keys anywhere in a schema."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            here = f"{at}.{f.name}".lstrip(".")
            out += ([here] if f.name.lower() in FORBIDDEN else []) + forbidden_keys(f.dataType, here)
        return out
    if isinstance(schema, T.ArrayType):
        return forbidden_keys(schema.elementType, f"{at}[]")
    if isinstance(schema, T.MapType):
        return forbidden_keys(schema.valueType, f"{at}{{}}")
    return []


def json_ld(html: Column) -> Column:
    """array<string> of the page's linked-data blocks."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))


def vehicle_node(blocks: Column) -> Column:
    """The first linked-data block about a vehicle, as variant."""
    parsed = F.transform(blocks, lambda x: F.try_parse_json(x))
    kind = lambda v: F.try_variant_get(v, "$.@type", "string")
    return F.try_element_at(F.filter(parsed, lambda v: F.coalesce(kind(v).isin("Car", "Vehicle"), F.lit(False))), F.lit(1))


def sitemap_urls(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds allowed: of the rules (allow boolean, path) that the url's path starts with the longest decides, allow at equal length; allowed without one."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    rows = urls.withColumn("_path", F.when(path == "", "/").otherwise(path))
    kept = rules.where("path <> ''").agg(F.collect_list(F.struct(F.length("path").alias("n"), "allow", "path"))).first()[0]
    verdict = F.lit(True)
    for r in sorted(kept, key=lambda r: (r["n"], r["allow"])):
        verdict = F.when(F.col("_path").startswith(r["path"]), F.lit(r["allow"])).otherwise(verdict)
    return rows.withColumn("allowed", verdict).drop("_path")
