"""Documents and their lengths in flat token files without an index, by scanning for separators.

A file holds little-endian unsigned 16-bit numbers: identifiers plus one, and 0 behind each document. It has no header,
no index and no record of its own. Reading cuts a file into blocks; each block searches its separators at once and says
how many numbers lie before its first and behind its last one. A prefix scan over the blocks of a file carries what was
open at a block's end into the next, so documents across blocks are stitched. A run of numbers without a separator
at the end of a file counts as a document that is not closed.

Null texts are empty documents of length 0. Null and repeated ids and repeated rows are counted like others; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaly.llm.storage import new_folder
from tessaly.llm.wordpiece import ROWS_A_CALL, encoder

SEPARATOR = "\x00\x00"
#: Identifiers are stored one higher in 16 bits, 0 being the separator.
LARGEST_ID = 65_534
#: Documents in one file at most, so that a file fits in a task.
DOCS_A_FILE = 10_000
BLOCK = 1 << 20
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_token_files(docs: DataFrame, vocabulary: str, path: str, docs_a_file: int = DOCS_A_FILE) -> None:
    """Write the identifiers of every text below ``kind=tokens``, in the order of the rows of each task, and below
    ``kind=ids`` the ids of the same rows: task, place of the first, and one id (or "-") for each, in one line per call.

    Both are written by the same attempt of the same task, so they belong together however the table is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, coder = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_CALL):
                batch = whole.slice(at, ROWS_A_CALL)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                encoded = [np.frombuffer(ids, "<u4") for ids in coder.encode(texts)]
                if any(len(ids) and ids.max() > LARGEST_ID for ids in encoded):
                    raise ValueError(f"token files hold identifiers up to {LARGEST_ID}")
                stored = [(ids + 1).astype("<u2").tobytes() for ids in encoded]
                line = " ".join(["-" if i is None else str(i) for i in (part, place, *batch.column("doc_id").to_pylist())])
                place += len(stored)
                yield pa.RecordBatch.from_arrays([pa.array([*stored, line.encode()], pa.binary()), pa.array(["tokens"] * len(stored) + ["ids"])], ["stored", "kind"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "stored binary, kind string")
    before = spark.conf.get(WRITERS, None)
    # Both files of a task are open at once; else Spark would sort the rows by kind.
    spark.conf.set(WRITERS, "4")
    try:
        # Spark's text writer puts bytes as they are, with the separator behind each row.
        rows.select(F.col("stored").cast("string").alias("value"), "kind").write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", docs_a_file).partitionBy("kind").text(path)
    finally:
        spark.conf.unset(WRITERS) if before is None else spark.conf.set(WRITERS, before)
    # An empty table leaves no folders.
    for kind in ("tokens", "ids"):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, ordinal`` as the writing tasks have put them down."""
    line = F.split("value", " ")
    lines = spark.read.option("lineSep", SEPARATOR).text(path).select(line[0].cast("bigint").alias("part"), line[1].cast("bigint").alias("first"), F.slice(line, 3, F.size(line)).alias("ids"))
    listed = lines.select("part", "first", F.posexplode("ids").alias("at", "id"))
    return listed.select(F.nullif("id", F.lit("-")).cast("bigint").alias("doc_id"), "part", (F.col("first") + F.col("at")).alias("ordinal"))


def scan_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """One row per block: numbers before the first and behind the last separator, and the lengths in between."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                numbers = np.frombuffer(content.as_buffer(), "<u2")
                rows = []
                for number, start in enumerate(range(0, len(numbers), block)):
                    part = numbers[start : start + block]
                    stops = np.flatnonzero(part == 0)
                    head, tail = (int(stops[0]), int(len(part) - stops[-1] - 1)) if len(stops) else (len(part), len(part))
                    rows.append((name.as_py(), number, len(stops), head, tail, (np.diff(stops) - 1).tolist()))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "stops", "head", "tail", "inner"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, block bigint, stops bigint, head bigint, tail bigint, inner array<bigint>")


def stitch_blocks(blocks: DataFrame) -> DataFrame:
    """``file, ordinal, n_tokens, closed`` for every document of every file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = blocks.withColumn("open", F.coalesce(F.sum("tail").over(before), F.lit(0))).withColumn("earlier", F.coalesce(F.sum("stops").over(before), F.lit(0)))
    carried = summed.withColumn("carry", F.col("open") - F.coalesce(F.last(F.when(F.col("stops") > 0, F.col("open")), ignorenulls=True).over(before), F.lit(0)))
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), "inner")
    closed = carried.where("stops > 0").select("file", "earlier", F.posexplode(lengths).alias("at", "n_tokens"))
    last = carried.withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()).where("is_last")
    rest = F.when(F.col("stops") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    left = last.select("file", (F.col("earlier") + F.col("stops")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.select("file", (F.col("earlier") + F.col("at")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed")).unionByName(left)


def count_tokens(docs: DataFrame, vocabulary: str, docs_a_file: int = DOCS_A_FILE, block: int = BLOCK) -> DataFrame:
    """``doc_id, part, ordinal, n_tokens``: token files of a table are written, scanned, and led back to its ids.

    The files name no documents; what leads back is the list of ids that the writing tasks put beside them. ``docs`` is
    read once. A document without a length, or a length without a document, is an error.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "token-files")
    write_token_files(docs, vocabulary, path, docs_a_file)
    name = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("bigint"), F.regexp_extract("file", r"\.c(\d+)\.", 1).cast("bigint")
    found = stitch_blocks(scan_blocks(spark, f"{path}/kind=tokens", block)).select(name[0].alias("part"), (name[1] * docs_a_file + F.col("ordinal")).alias("ordinal"), "n_tokens")
    return lead_back(read_ids(spark, f"{path}/kind=ids"), found)


def lead_back(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Every document with its length; fails where one has no partner."""
    met = ids.withColumn("listed", F.lit(True)).join(found, ["part", "ordinal"], "full")
    alone = F.col("listed").isNull() | F.col("n_tokens").isNull()
    length = F.when(alone, F.raise_error(F.concat_ws(" ", F.lit("token files and ids differ at part"), "part", F.lit("ordinal"), "ordinal")).cast("bigint")).otherwise(F.col("n_tokens"))
    return met.select("doc_id", "part", "ordinal", length.alias("n_tokens"))
