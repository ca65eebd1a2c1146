"""Reading text corpora and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".txt", ".md", ".markdown")
COLLECTIONS = {"canteen_dishes": "canteen", "restaurants": "restaurant", "takeaways": "takeaway"}
RECORD = (
    "array<struct<id:string,name:string,food_name:string,restaurant:string,venue:string,source_url:string,category:string,"
    "categories:array<string>,tastes:array<string>,meal_times:array<string>,price:double,avg_price:double,weight:double,"
    "enabled:boolean,origin:string,locked:boolean,notes:string,"
    "distance_minutes:string,delivery_minutes:string,suitable_for:string,platforms:string,window:string,floor:string,area:string,recommended_food:string,"
    "record_type:string,source_title:string,source_snippet:string,discovered_at:string,status:string>>"
)
#: Fields read from their JSON text, so that another type in one of them does not make a catalogue corrupt.
NUMBERS, LISTS = ("distance_minutes", "delivery_minutes"), ("suitable_for", "platforms")
#: Collections of evidence beside the formal ones, read element by element for the same reason.
EVIDENCE = ("pending_review", "sources")
SOURCE = "query string, title string, url string, snippet string"
CATALOGUE_SCHEMA = "schema_version int, updated_at string, " + ", ".join([*(f"{c} {RECORD}" for c in COLLECTIONS), *(f"{c} string" for c in EVIDENCE)])


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def decode_text(content: Column) -> Column:
    """UTF-8 text with undecodable bytes dropped and line ends unified."""
    raw = content.cast("string")
    clean = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit("")))
    return F.regexp_replace(clean, r"\r\n?", "\n")


def decode_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects) of (path, content) rows by suffix."""
    typed = files.withColumn("suffix", suffix_of(F.col("path")))
    supported = F.col("suffix").isin(*TEXT_SUFFIXES)
    texts = typed.filter(supported).select("path", decode_text(F.col("content")).alias("text"))
    rejects = typed.filter(~supported).select("path", F.concat(F.lit("Unsupported file type: "), "suffix").alias("error"))
    return texts, rejects


def read_text_corpus(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Text files below the paths, and the files which cannot be read as text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return decode_files(files.select("path", "content"))


def listed(value: Column) -> Column:
    """The list in a JSON text; one plain value is a list of its own."""
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).when(value != "", F.array(value))


def parse_catalogue(documents: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, errors) of catalogue JSON texts, one catalogue per row.

    A corrupt catalogue gives no records and one error row. Sources give their title as ``name``, their address as
    ``source_url``, their snippet as ``source_snippet`` and the ``query`` that found them.
    """
    parsed = documents.withColumn(
        "_c", F.from_json(text, CATALOGUE_SCHEMA + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    )
    broken = F.col("_c").isNull() | F.col("_c._corrupt").isNotNull()
    keep = [c for c in documents.columns if c != text]
    errors = parsed.filter(broken).select(*keep, F.lit("corrupt catalogue").alias("error"))
    good, records = parsed.filter(~broken), None
    for collection in COLLECTIONS:
        part = good.select(*keep, F.lit(collection).alias("collection"), F.explode(f"_c.{collection}").alias("r")).select(*keep, "collection", "r.*")
        records = part if records is None else records.unionByName(part)
    one = RECORD.removeprefix("array<").removesuffix(">")
    element = {c: good.select(*keep, F.lit(c).alias("collection"), F.explode(F.from_json(f"_c.{c}", "array<string>")).alias("e")) for c in EVIDENCE}
    pending = element["pending_review"].select(*keep, "collection", F.from_json("e", one).alias("r")).select(*keep, "collection", "r.*")
    found = element["sources"].select(*keep, "collection", "e", F.from_json("e", SOURCE).alias("r"))
    # A source may be a plain address.
    address = F.when(F.col("e").startswith("{"), F.col("r.url")).otherwise(F.col("e"))
    found = found.select(*keep, "collection", F.col("r.title").alias("name"), address.alias("source_url"), F.col("r.snippet").alias("source_snippet"), F.col("r.query").alias("query"))
    records = records.unionByName(pending).unionByName(found, allowMissingColumns=True)
    return records.withColumns({c: F.col(c).try_cast("double") for c in NUMBERS} | {c: listed(F.col(c)) for c in LISTS}), errors


def read_catalogue(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").load(list(paths))
    return parse_catalogue(files.select("path", decode_text(F.col("content")).alias("value")))


def extract_json(value: Column) -> Column:
    """The JSON object inside prose: a fenced one, else from the first to the last brace."""
    fenced = F.regexp_extract(value, r"(?is)```(?:json)?\s*(\{.*\})\s*```", 1)
    braces = F.regexp_extract(value, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")), F.trim(value))


def export_rows(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)
