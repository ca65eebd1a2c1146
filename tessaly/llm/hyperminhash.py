"""Near-duplicate documents with HyperMinHash sketches.

The set of a document holds its different shingles of ``width`` words (fewer words: the whole sequence). Each shingle has
a 64-bit hash: the upper bits choose one of ``REGISTERS`` buckets, and the least rest in a bucket is stored as its count
of leading zeros and the next ``MANTISSA`` bits: two bytes a bucket. An empty bucket takes the register of another one, in an order of
its own that is the same for all documents; so short documents have full bands too, and registers still agree with
the chance of the similarity. Neighbouring registers are hashed as bands.

1. Rows with equal sets become one class with a number of its own. Bands of classes meet in buckets. The full sets of classes
   that meet any other are computed once.
2. Every class is paired with the first class of each bucket. Pairs whose sizes or whose collision-corrected estimate
   rule the similarity out are dropped, the rest is confirmed on full sets, and components are formed.
3. Buckets that still hold several components are open. In small ones all classes of different components meet. In large
   ones each class outside the largest component first meets the most central class of it.
4. In large buckets that are open even then, a shingle is rare if it occurs in one component only or in few classes. Classes of
   different components that share a rare shingle meet. Two classes that share none have at most their other shingles in
   common, so they meet only if those are enough for the similarity; a class with too few is ruled out with all
   others at once. Documents that share one passage and copies with many changes of their own go this way without
   any pair. So no group emits all its pairs, and yet every pair of a bucket is linked, tested or ruled out.

With 48 bands of 4 registers a pair at similarity 0.75 shares no band with a chance of 1 in 80 million.

A class that is paired with very many others is joined in as many parts as it takes (``HOT_PAIRS`` pairs each).

Rows without words or text have empty sets and are linked with nothing. Rows count by their text: rows that share an id but not the
text may lie in different components, and each is kept or dropped by itself. Null ids are linked with nothing and get a null
component. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaly.llm.components import components
from tessaly.llm.storage import materialise

REGISTERS = 256
BUCKET_BITS = 8
REST_BITS = 64 - BUCKET_BITS
MANTISSA = 10
BAND = 4
BANDS = 48
#: Open buckets with more classes are large.
LARGE_BUCKET = 32
#: Sizes of one level differ by this factor at most; more than 100 / percent.
SIZE_STEP = 1.5
#: Classes that a rare shingle occurs in at most, if they belong to several components.
RARE = 16
#: Estimates are believed to this many standard deviations.
DEVIATIONS = 5
#: Rows to look up (16 bytes each) that are sent to all executors; more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Pairs of one class that one task joins.
HOT_PAIRS = 200
#: Odd factors that make a shingle's hash depend on the order of its words.
FACTORS = [xxhash.xxh3_64_intdigest(bytes([i])) | 1 for i in range(64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: For each register the order in which it asks others for a value.
DONORS = np.argsort(mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(1)).reshape(REGISTERS, REGISTERS), axis=1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles. Words part at ASCII white space; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        factors = np.array(FACTORS[width : width + len(words)], np.uint64)
        return mixed((hashed * factors).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    n = len(words) - width + 1
    total = hashed[:n] * np.uint64(FACTORS[0])
    for i in range(1, width):
        total += hashed[i : i + n] * np.uint64(FACTORS[i])
    return np.unique(mixed(total))


def sketch(hashes: np.ndarray) -> bytes:
    """Two bytes a register: leading zeros and mantissa of the least rest of each bucket, empty ones filled from others.
    Nothing for an empty set."""
    if not len(hashes):
        return b""
    registers = np.zeros(REGISTERS, "<u2")
    bucket = (hashes >> np.uint64(REST_BITS)).astype(np.int64)
    first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    rest = hashes[first] & np.uint64((1 << REST_BITS) - 1)
    zeros = np.clip(REST_BITS - np.frexp(rest.astype(np.float64))[1], 0, 62)
    cut = (rest << (zeros + 1).astype(np.uint64)) & np.uint64((1 << REST_BITS) - 1)
    registers[bucket[first]] = (zeros << MANTISSA) | (cut >> np.uint64(REST_BITS - MANTISSA)).astype(np.int64)
    held = np.zeros(REGISTERS, bool)
    held[bucket[first]] = True
    empty = np.flatnonzero(~held)
    if len(empty):
        asked = DONORS[empty]
        registers[empty] = registers[asked[np.arange(len(empty)), held[asked].argmax(axis=1)]]
    return registers.tobytes()


SKETCHES = "doc_id bigint, text_hash bigint, n_shingles bigint, class binary, registers binary"


def named_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_hash``: id and hash tell the texts of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def sketch_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle_set(t.as_py(), width) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()),
                ], ["doc_id", "text_hash", "n_shingles", "class", "registers"])

    return named_texts(docs).mapInArrow(run, SKETCHES)


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``rep, shingles`` of the classes ``rep``, whose sets are those of the texts ``doc_id, text_hash``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column("text")]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["rep", "shingles"])

    few = wanted.count() <= BROADCAST_IDS
    found = named_texts(docs).join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select("rep", "text").mapInArrow(run, "rep bigint, shingles array<bigint>")
    # A row that is repeated as a whole gives its set more than once.
    return found.dropDuplicates(["rep"])


def estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """Drops pairs whose estimated similarity is too far below the threshold. Equal registers that chance would give
    (for sizes n and m: 0.17 * 2^(p - r) * 4(n/m) / (1 + n/m)^2) are taken off first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("a_registers", "b_registers"))
            equal = (one == two).sum(1)
            smaller = np.minimum(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy())
            held = REGISTERS * -np.expm1(-smaller / REGISTERS)
            ratio = batch.column("a_n").to_numpy() / batch.column("b_n").to_numpy()
            chance = 0.169919487159739 * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
            margin = DEVIATIONS * np.sqrt(threshold * (1 - threshold) / held)
            yield batch.select(["a", "b"]).filter(pa.array((equal - chance) / REGISTERS >= threshold - margin))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def hot_classes(pairs: DataFrame) -> DataFrame:
    """``hot, parts``: classes of more pairs than one task should join, and the parts they are joined in. At most two classes per
    ``HOT_PAIRS`` pairs; sent to all executors up to ``BROADCAST_IDS``."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("hot")).groupBy("hot").count()
    hot = materialise(ends.where(F.col("count") > HOT_PAIRS).select("hot", F.ceil(F.col("count") / HOT_PAIRS).cast("int").alias("parts")), "hot")
    return F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot


def attached(pairs: DataFrame, side: str, other: str, values: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs with the columns of ``values`` for the class in ``side``. The pairs of a hot class are dealt over its parts by the class in ``other``."""
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.hash(other), F.coalesce("parts", F.lit(1))))
    dealt = pairs.join(hot.withColumnRenamed("hot", side), side, "left").withColumn("part", part).drop("parts")
    copies = values.join(hot.withColumnRenamed("hot", side), side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copies, [side, "part"]).drop("part")


def confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough: size and estimate first, then the sets."""
    side, hot = classes.select("rep", "n_shingles", "registers"), hot_classes(pairs)
    sized = attached(attached(pairs, "a", "b", side.toDF("a", "a_n", "a_registers"), hot), "b", "a", side.toDF("b", "b_n", "b_registers"), hot)
    sized = sized.where((F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent))
    near = materialise(estimated(sized, percent / 100), "near")
    both = attached(attached(near, "a", "b", sets.toDF("a", "a_set"), hot), "b", "a", sets.toDF("b", "b_set"), hot)
    common = F.size(F.array_intersect("a_set", "b_set"))
    return materialise(both.where(common * 100 >= (F.size("a_set") + F.size("b_set") - common) * percent).select("a", "b").distinct(), "confirmed")


def band_rows(classes: DataFrame) -> DataFrame:
    """``band, part`` added: the bytes of each band."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("registers", i * (2 * BAND) + 1, F.lit(2 * BAND)))
    return classes.select(*(c for c in classes.columns if c != "registers"), F.posexplode(parts).alias("band", "part"))


def size_level(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")


def by_size(rows: DataFrame, percent: int) -> DataFrame:
    """Buckets split by size. A class goes to the level of its size and to that of the least size it may be similar to, so
    two classes of fitting sizes meet at the level of the smaller one."""
    levels = F.array_distinct(F.array(size_level(F.col("n_shingles")), size_level(F.col("n_shingles") * percent / 100)))
    return rows.withColumn("level", F.explode(levels)).withColumn("bucket", F.xxhash64("bucket", "level"))


def mixed_buckets(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets with several components, with ``label``, the bucket's largest component ``main`` and ``members``."""
    rows = rows.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    parts = rows.groupBy("bucket", "label").count()
    mixed_ones = parts.groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("members"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return materialise(rows.join(mixed_ones.select("bucket", F.col("top.label").alias("main"), "members"), "bucket"), "mixed")


def rare_shingles(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """``rep, label, n_shingles, shingle, alone``: the rare shingles of each class among the given sets.

    A shingle of one or two classes names them by its least and largest class; only shingles of more are joined back."""
    named = sets.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(F.struct("rep", F.coalesce("label", "rep").alias("label"), F.size("shingles").alias("n_shingles")).alias("of"), F.explode("shingles").alias("shingle"))
    counted = named.groupBy("shingle").agg(F.min("of").alias("first"), F.max("of").alias("last"), F.min("of.label").alias("low"), F.max("of.label").alias("high"), F.count(F.lit(1)).alias("n"))
    counted = materialise(counted.withColumn("alone", F.col("low") == F.col("high")).where(F.col("alone") | (F.col("n") <= RARE)).select("shingle", "first", "last", "n", "alone"), "rare-counts")
    few = counted.where("n <= 2").select(F.explode(F.array_distinct(F.array("first", "last"))).alias("of"), "shingle", "alone")
    more = named.join(counted.where("n > 2").select("shingle", "alone"), "shingle").select("of", "shingle", "alone")
    return few.unionByName(more).select("of.*", "shingle", "alone")


def rare_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Classes of different components and fitting sizes that share a rare shingle: at most RARE classes meet at each."""
    met = rare.where("not alone").select("shingle", "rep", "label", "n_shingles")
    other = met.toDF("shingle", "b", "b_label", "b_n")
    fit = (F.col("rep") < F.col("b")) & (F.col("label") != F.col("b_label")) & (F.least("n_shingles", "b_n") * 100 >= F.greatest("n_shingles", "b_n") * percent)
    return met.join(other, "shingle").where(fit).select(F.col("rep").alias("a"), "b")


def star_pairs(rows: DataFrame) -> DataFrame:
    """Each class outside the largest component of a bucket with that class of it which shares most buckets with others."""
    central = rows.groupBy("rep").agg((-F.sum("members")).alias("far"))
    centre = rows.where("label = main").join(central, "rep").groupBy("bucket").agg(F.min(F.struct("far", "rep"))["rep"].alias("centre"))
    return rows.where("label <> main").join(centre, "bucket").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))


def first_meeting(band: Column, one: Column, two: Column) -> Column:
    """Whether no earlier band of two classes agrees."""
    part = lambda registers, i: F.substring(registers, i * (2 * BAND) + 1, F.lit(2 * BAND))
    return ~F.exists(F.slice(F.lit(list(range(BANDS))), F.lit(1), band), lambda i: part(one, i) == part(two, i))


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket in different components that may be similar by their sizes and without their rare shingles (``own`` of them)."""
    outside = rows.where("label <> main").select("bucket", F.col("rep").alias("s"), F.col("label").alias("s_label"), F.col("n_shingles").alias("s_n"), F.col("own").alias("s_own"), "band", "level", F.col("registers").alias("s_registers"))
    inside = rows.select("bucket", F.col("rep").alias("m"), F.col("label").alias("m_label"), F.col("n_shingles").alias("m_n"), F.col("own").alias("m_own"), (F.col("label") == F.col("main")).alias("is_main"), F.col("registers").alias("m_registers"))
    able = lambda n, own: (n - own) * 100 >= n * percent  # noqa: E731  else ruled out with all others
    common = F.least(F.col("s_n") - F.col("s_own"), F.col("m_n") - F.col("m_own"))
    fit = (F.col("s_label") != F.col("m_label")) & (F.col("is_main") | (F.col("s") < F.col("m"))) & (common * (100 + percent) >= (F.col("s_n") + F.col("m_n")) * percent)
    # A pair that shares several buckets meets in the first one only.
    once = (F.col("level") == size_level(F.least("s_n", "m_n"))) & first_meeting(F.col("band"), F.col("s_registers"), F.col("m_registers"))
    left, right = outside.where(able(F.col("s_n"), F.col("s_own"))), inside.where(able(F.col("m_n"), F.col("m_own")))
    return left.join(right, "bucket").where(fit & (F.least("s_n", "m_n") * 100 >= F.greatest("s_n", "m_n") * percent) & once).select(F.least("s", "m").alias("a"), F.greatest("s", "m").alias("b"))


def find_links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, label``: the components of the classes ``rep`` that are linked with any other."""
    bands = band_rows(classes).select(F.xxhash64("band", "part").alias("bucket"), "band", "rep", "n_shingles")
    least = bands.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialise(bands.join(least.select("bucket", "centre"), "bucket"), "buckets")
    wanted = materialise(shared.select("rep").distinct().join(classes, "rep").select("rep", "doc_id", "text_hash"), "wanted")
    sets = materialise(full_sets(docs, wanted, width), "sets")

    first = materialise(shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = confirm(first, classes, sets, percent)
    labels, shared = components(links), shared.drop("centre")

    open_rows = mixed_buckets(by_size(shared, percent), labels)
    registers = classes.select("rep", "registers")
    no_own = F.lit(0).cast("bigint").alias("own")
    small, large = (open_rows.where(F.col("members") <= LARGE_BUCKET), open_rows.where(F.col("members") > LARGE_BUCKET))
    meeting = all_pairs(small.select("*", no_own).join(registers, "rep"), percent).unionByName(star_pairs(large))
    second = materialise(meeting.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(confirm(second, classes, sets, percent))
    labels = components(links)

    left = mixed_buckets(large.drop("label", "main", "members"), labels)
    ids = materialise(left.select("rep").distinct(), "ids")
    rare = materialise(rare_shingles(sets.join(ids, "rep", "left_semi"), labels), "rare")
    own = rare.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    left = left.join(own, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0))).join(registers, "rep")
    third = all_pairs(left, percent).unionByName(rare_pairs(rare, percent)).distinct()
    third = materialise(third.join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs")
    return components(links.unionByName(confirm(third, classes, sets, percent)))


def near_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, n_shingles, component_id, kept``."""
    rows = materialise(sketch_documents(docs, width), "sketches")
    linked = F.expr("n_shingles > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "text_hash"))
    grouped = rows.where(linked).groupBy("class").agg(least.alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # Numbers are given as the table is written, and read from it ever after.
    classes = materialise(grouped.select("class", F.monotonically_increasing_id().alias("rep"), "least.doc_id", "least.text_hash", "n_shingles", "registers"), "classes")
    labels = find_links(docs, classes, width, percent)
    named = materialise(classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("class", "doc_id", F.coalesce("label", "rep").alias("label")), "labelled")
    final = named.join(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("class", "component_id")
    alone = rows.where(~linked).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    together = rows.where(linked).join(final, "class").select("doc_id", "text_hash", "n_shingles", "component_id")
    return together.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    return near_rows(docs, width, percent).drop("text_hash")


def keep_documents(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that are the least of their group, with their own columns. Rows that share id and text stay or go together."""
    gone = materialise(near_rows(docs, width, percent).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    same = (F.col("doc_id") == F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    return rows.join(F.broadcast(gone) if few else gone, same, "left_anti").select("row.*")
