"""Replacing and appending writes. Plain Parquet, keyed by hash partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_replace(stored: DataFrame, new: DataFrame, replaced: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the replaced keys are dropped and the new rows added."""
    return stored.join(replaced.select(*key).distinct(), key, "left_anti").unionByName(new)


def save_replaced(result: DataFrame, path: str, key: list[str], buckets: int = 256) -> None:
    """Write so that a later replacement rewrites only the key buckets it touches.

    Needs ``spark.sql.sources.partitionOverwriteMode=dynamic``. ``result`` must hold whole
    buckets: use ``touched_buckets`` to pick them.
    """
    bucketed = result.withColumn("key_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    bucketed.write.mode("overwrite").partitionBy("key_bucket").parquet(path)


def touched_buckets(stored: DataFrame, replaced: DataFrame, key: list[str], buckets: int = 256) -> DataFrame:
    """Stored rows sharing a bucket with a replaced key; bucket numbers are few (at most ``buckets``)."""
    numbers = replaced.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("key_bucket")).distinct()
    return stored.join(numbers, "key_bucket", "left_semi")


def content_addressed(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Stored name: stem, underscore, twelve hex digits of the content hash, lower-cased suffix."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    suffix = F.lower(F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1))
    digest = F.substring(F.sha2(F.col(content).cast("binary"), 256), 1, 12)
    return files.withColumn("stored_name", F.concat(stem, F.lit("_"), digest, suffix))


def ingest_missing(files: DataFrame, store: DataFrame) -> DataFrame:
    """Files whose content-addressed name is not stored yet; one row per stored name."""
    named = content_addressed(files)
    first = named.groupBy("stored_name").agg(F.min("name").alias("name"))
    return first.join(store.select("stored_name").distinct(), "stored_name", "left_anti")


def skip_or_resume(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Skip titles which are ready; else resume the newest earlier attempt, or start anew."""
    shared = docs.filter("is_global AND library_scope = 'course'")
    ready = shared.filter("status = 'ready'").select("title").distinct()
    newest = shared.groupBy("title").agg(F.max("id").alias("resume_id"))
    waiting = files.join(ready, "title", "left_anti").join(newest, "title", "left")
    return waiting.withColumn("action", F.when(F.col("resume_id").isNull(), "create").otherwise("resume"))


def part_key(ordinal, text):
    """Content-addressed key of one part: its number and sixteen hex digits of its hash."""
    return F.concat(ordinal.cast("string"), F.lit(":"), F.substring(F.sha1(text), 1, 16))


def part_cache_miss(parts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keyed parts against cached outputs; blank outputs do not count."""
    useful = cache.filter(F.trim(F.coalesce("output", F.lit(""))) != "")
    return parts.join(useful, "part_key"), parts.join(useful.select("part_key"), "part_key", "left_anti")
