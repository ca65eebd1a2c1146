"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every ``k`` words that follow each other are hashed; of each ``window - k + 1`` neighbouring hashes the least is kept with
its place. Two texts that share ``window`` words in a row keep the same hash there, so a join on kept hashes meets every
shared window. Each meeting is extended: the item's words around the hash, as far as windows with it reach, are laid over
the document at that place and compared word by word, so chance meetings go and exact occurrences stay. A fingerprint
carries those ``2 * window - k`` words at most, never its whole item. Items shorter than ``window`` words are one
window of their own length, and for the lengths that occur all runs of that many words of a document are hashed.

Null or wordless texts of documents have no words and no hits; null or wordless items are no windows. Rows alike in id
and text give as many result rows; null ids are kept. Other columns are ignored. Empty tables are allowed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.functions.text import let
from tessaly.llm.storage import materialise

#: Every ASCII sign but letters and digits parts words.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: Fingerprints of items that are sent to all executors, and bytes of their words; more are joined by shuffling.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
#: Low bits of a packed fingerprint hold the place.
PLACE_BITS = 24
PLACE_MASK = (1 << PLACE_BITS) - 1
#: Key of the one row per document that every document keeps.
WHOLE = -1


def words(text: Column) -> Column:
    """Runs of digits, A-Z in lower case, a-z and all signs beyond ASCII."""
    flat = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + PARTING, string.ascii_lowercase + " " * len(PARTING))
    return F.array_remove(F.split(flat, " "), "")


def runs(count: Column, size: int) -> Column:
    """Places 0 .. count - size, or none."""
    return F.when(count >= size, F.sequence(F.lit(0), count - size)).otherwise(F.array().cast("array<int>"))


def kept_hashes(hashed: Column, k: int, window: int) -> Column:
    """``array<struct<key, place>>``: the least packed hash of each run of ``window - k + 1`` hashes, once for each place."""
    wide = window - k + 1

    def of_grams(grams: Column) -> Column:
        least = F.transform(runs(F.size(grams), wide), lambda i: F.least(*[F.get(grams, i + j) for j in range(wide)]))

        def once(minima: Column) -> Column:
            fresh = F.transform(minima, lambda m, i: F.when((i == 0) | (F.get(minima, i - 1) != m), F.struct(
                F.shiftright(m, PLACE_BITS).alias("key"), (i + F.pmod(m.bitwiseAND(PLACE_MASK).cast("int") - i, F.lit(1 << PLACE_BITS))).cast("int").alias("place"),
            )))
            return F.filter(fresh, lambda x: x.isNotNull())

        return let(least, once)

    grams = F.transform(runs(F.size(hashed), k), lambda i: F.shiftleft(F.shiftright(F.xxhash64(*[F.get(hashed, i + j) for j in range(k)]), PLACE_BITS), PLACE_BITS).bitwiseOR(i.bitwiseAND(PLACE_MASK).cast("bigint")))
    return let(grams, of_grams)


def run_hash(hashed: Column, i: Column | int, size: int) -> Column:
    return F.shiftright(F.xxhash64(F.lit(size), *[F.get(hashed, i + j) for j in range(size)]), PLACE_BITS)


def run_marks(hashed: Column, size: int) -> Column:
    return F.transform(runs(F.size(hashed), size), lambda i: F.struct(run_hash(hashed, i, size).alias("key"), i.alias("place")))


def whole_hash(worded: Column, size: int) -> Column:
    return let(F.transform(worded, lambda w: F.xxhash64(w)), lambda hashed: run_hash(hashed, 0, size))


def fingerprints(worded: Column, k: int, window: int, short: list[int], whole: bool) -> Column:
    """Kept hashes, all runs of the ``short`` lengths and, for documents, one entry for the document itself."""

    def of_hashes(hashed: Column) -> Column:
        found = [kept_hashes(hashed, k, window)]
        found += [run_marks(hashed, size) for size in short]
        if whole:
            found.append(F.array(F.struct(F.lit(WHOLE).cast("bigint").alias("key"), F.lit(-1).alias("place"))))
        return F.concat(*found)

    return let(F.transform(worded, lambda w: F.xxhash64(w)), of_hashes)


def item_fingerprints(items: DataFrame, k: int, window: int) -> DataFrame:
    """``key, item_id, item_place, near``: fingerprints of the items that have words, each with the item's words that windows
    around it can hold (short items: all) and its place among them."""
    worded = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    size = F.size("item_words")
    long = worded.where(size >= window).select("*", F.explode(fingerprints(F.col("item_words"), k, window, [], False)).alias("f"))
    first = F.greatest(F.lit(0), F.col("f.place") - (window - k))
    near = F.slice("item_words", first + 1, F.least(size, F.col("f.place") + window) - first)
    out = long.select(F.col("f.key").alias("key"), "item_id", (F.col("f.place") - first).alias("item_place"), near.alias("near"))
    for n in range(1, window):
        out = out.unionByName(worded.where(size == n).select(whole_hash(F.col("item_words"), n).alias("key"), "item_id", F.lit(0).alias("item_place"), F.col("item_words").alias("near")))
    return out.distinct()


def covered(document: Column, item: Column, at: Column, window: int) -> Column:
    """Places of the document inside a window of the item's words, when the first of them lies at ``at`` (may be negative)."""
    span = F.least(F.lit(window), F.size(item))
    starts = F.filter(
        F.sequence(F.lit(0), F.size(item) - span),
        lambda s: (at + s >= 0) & (at + s + span <= F.size(document)) & (F.slice(document, F.greatest(at + s, F.lit(0)) + 1, span) == F.slice(item, s + 1, span)),
    )
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(at + s, at + s + span - 1))))


def find_hits(docs: DataFrame, items: DataFrame, k: int = 5, window: int = 13, broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, places`` (its words inside windows) and ``item_ids`` (sorted strings)."""
    known = materialise(item_fingerprints(items, k, window), "items")
    # At most ``window`` rows.
    sizes = known.groupBy(F.least(F.size("near"), F.lit(window)).alias("n")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length(F.array_join("near", " "))).alias("bytes")).collect()
    short = sorted(r["n"] for r in sizes if r["n"] < window)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), words(F.col("text").cast("string")).alias("words"))
    # The array is a column of its own, so that exploding and joining compile into one stage and copy words only for rows that meet.
    marked = rows.withColumn("marks", fingerprints(F.col("words"), k, window, short, True))
    marks = marked.select("doc_id", "text_key", "words", F.explode("marks").alias("f")).select("doc_id", "text_key", "words", F.col("f.key").alias("key"), F.col("f.place").alias("place"))
    none = known.sparkSession.createDataFrame([(WHOLE, None, None, None)], known.schema)
    if sum(r["count"] for r in sizes) <= broadcast_rows and sum(r["bytes"] for r in sizes) <= broadcast_bytes:
        met = marks.join(F.broadcast(known.unionByName(none)), "key")
    else:
        # Places alone are shuffled; the words of the documents that met an item are joined afterwards.
        placed = marked.select("doc_id", "text_key", F.size("words").alias("n"), F.explode("marks").alias("f"))
        flat = placed.select("doc_id", "text_key", "n", F.col("f.key").alias("key"), F.col("f.place").alias("place"))
        hits = flat.where("place >= 0").join(known, "key").select("doc_id", "text_key", (F.col("place") - F.col("item_place")).alias("place"), "item_id", "near").distinct()
        texts = rows.dropDuplicates(["doc_id", "text_key"]).toDF("d", "t", "words")
        found = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
        met = found.select("doc_id", "text_key", "words", "place", F.lit(0).alias("item_place"), "item_id", "near").unionByName(flat.where("place < 0").select("doc_id", "text_key", "place", "n"), allowMissingColumns=True)
    counted = "n" in met.columns
    laid = met.where((F.col("place") < 0) | F.col("item_id").isNotNull()).select(
        "doc_id", "text_key", "item_id", F.when(F.col("place") < 0, F.col("n") if counted else F.size("words")).alias("n_words"),
        F.when(F.col("item_id").isNotNull(), covered(F.col("words"), F.col("near"), F.col("place") - F.col("item_place"), window)).alias("places"),
    ).withColumn("item_id", F.when(F.size("places") > 0, F.col("item_id")))
    grouped = laid.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("bigint").alias("n_words"), F.count("n_words").alias("copies"), F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"),
    )
    return grouped.select("doc_id", "text_key", "n_words", "places", "item_ids", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")


def judged(found: DataFrame, share: int) -> DataFrame:
    hit = F.size("places").cast("bigint")
    return found.withColumn("n_hit", hit).withColumn("contaminated", (hit > 0) & (hit * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, window: int = 13, share: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: contaminated when hits are at least one word in ``share``."""
    return judged(find_hits(docs, items, k, window, broadcast_rows), share).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def keep_documents(docs: DataFrame, items: DataFrame, k: int = 5, window: int = 13, share: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    bad = materialise(judged(find_hits(docs, items, k, window, broadcast_rows), share).where("contaminated").select(F.col("doc_id").alias("bad_id"), "text_key").distinct(), "contaminated")
    few = bad.count() <= broadcast_rows
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    return rows.join(F.broadcast(bad) if few else bad, (F.col("key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")
