"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that stays together. A partial partition holds one sum per shard. The two partial partitions with
the largest spread are merged again and again, the largest sum of one with the smallest of the other. Groups are dealt
by hash into cells of bounded size; each cell is differenced in a task of its own and leaves one partial partition.
Those are differenced in the same way, ``FAN_IN`` of them by one task, level by level until one is left.

Null texts count as empty. Null ids, ties and repeated rows are kept and get slots of their own (rows alike in id and
text in any order). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaly.llm.storage import materialise

#: Groups differenced by one task, and rows numbered by one task, on average.
CELL_ROWS = 50_000
#: Partial partitions merged by one task.
FAN_IN = 1000


def difference_sums(partials: list[list[int]], shards: int) -> list[list[int]]:
    """For each partial partition (``shards`` sums) the shard that each of its sums goes to."""
    nodes: list[tuple[int, int]] = []  # children of each merged node; leaves are (-1 - partial, position)
    heap = []
    for k, sums in enumerate(partials):
        bins = []
        for place, total in enumerate(sums):
            nodes.append((-1 - k, place))
            bins.append((total, len(nodes) - 1))
        bins.sort(reverse=True)
        heap.append((bins[-1][0] - bins[0][0], k, bins))
    heapq.heapify(heap)
    counter = len(partials)
    while len(heap) > 1:
        left, right = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        bins = []
        for (a, x), (b, y) in zip(left, reversed(right), strict=True):
            nodes.append((x, y))
            bins.append((a + b, len(nodes) - 1))
        bins.sort(reverse=True)
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], counter, bins))
        counter += 1
    placed = [[0] * shards for _ in partials]
    for shard, (_, root) in enumerate(heap[0][2] if heap else []):
        stack = [root]
        while stack:
            x, y = nodes[stack.pop()]
            if x < 0:
                placed[-1 - x][y] = shard
            else:
                stack += [x, y]
    return placed


def difference_items(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """The place of each single item, and the sums: bins without an item are not kept as nodes."""
    nodes: list[tuple[int, int]] = []
    heap = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    counter, n = len(sizes), len(sizes)
    while len(heap) > 1:
        left, right = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = shards - len(left)
        bins = left[:free] + right[: shards - len(left)] if len(right) <= free else None
        if bins is None:
            # The largest sums of one meet the smallest of the other; missing bins are empty.
            wide = left + [(0, -1)] * free
            thin = right + [(0, -1)] * (shards - len(right))
            bins = []
            for (a, x), (b, y) in zip(wide, reversed(thin), strict=True):
                if x < 0 or y < 0:
                    bins.append((a + b, max(x, y)))
                else:
                    nodes.append((x, y))
                    bins.append((a + b, n + len(nodes) - 1))
        else:
            bins = left + right
        bins = sorted((b for b in bins if b[1] >= 0), reverse=True)
        spread = (bins[-1][0] if len(bins) == shards else 0) - bins[0][0]
        heapq.heappush(heap, (spread, counter, bins))
        counter += 1
    place, sums = [0] * n, [0] * shards
    for role, (total, root) in enumerate(heap[0][2] if heap else []):
        sums[role] = total
        stack = [root]
        while stack:
            node = stack.pop()
            if node < n:
                place[node] = role
            else:
                stack += nodes[node - n]
    return place, sums


def assign_groups(groups: DataFrame, shards: int, cell_rows: int = CELL_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``key, shard`` for rows ``key, bytes`` with unique keys."""
    cells = max(1, math.ceil(groups.count() / cell_rows))

    def within(cell: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True])
        place, sums = difference_items(rows["bytes"].tolist(), shards)
        return pd.DataFrame({"key": rows["key"], "cell": cell[0], "role": place, "total": [sums[p] for p in place]})

    def across(cell: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("child")
        placed = difference_sums([list(s) for s in rows["sums"]], shards)
        totals = [0] * shards
        for sums, places in zip(rows["sums"], placed, strict=True):
            for size, place in zip(sums, places, strict=True):
                totals[place] += int(size)
        return pd.DataFrame({
            "child": [c for c in rows["child"] for _ in range(shards)], "role": list(range(shards)) * len(rows),
            "cell": cell[0], "up": [p for places in placed for p in places], "total": [totals[p] for places in placed for p in places],
        })

    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int"))
    placed = materialise(dealt.groupBy("cell").applyInPandas(within, "key binary, cell int, role int, total bigint"), "roles")
    level = placed
    while True:
        totals = [F.coalesce(F.max(F.when(F.col("role") == k, F.col("total"))), F.lit(0)) for k in range(shards)]
        sums = level.groupBy(F.col("cell").alias("child")).agg(F.array(*totals).alias("sums"))
        cells = math.ceil(cells / fan_in)
        merged = sums.groupBy((F.pmod(F.col("child"), F.lit(cells))).alias("cell")).applyInPandas(across, "child int, role int, cell int, up int, total bigint")
        merged = materialise(merged, "merged")
        placed = placed.select("key", F.col("cell").alias("child"), "role").join(merged, ["child", "role"]).select("key", "cell", F.col("up").alias("role"))
        if cells == 1:
            return placed.select("key", F.col("role").alias("shard"))
        level = merged.select("cell", F.col("up").alias("role"), "total").distinct()


def shard_by_bytes(docs: DataFrame, shards: int = 16, cell_rows: int = CELL_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: groups of equal texts whole, byte sums near equal, slots gapless."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = materialise(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
    ), "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = materialise(rows.join(assign_groups(groups, shards, cell_rows, fan_in), "key").drop("key"), "placed")
    return number_slots(placed, cell_rows)


def number_slots(placed: DataFrame, rows_a_task: int = CELL_ROWS) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard: rank within a hashed bucket plus the buckets before it."""
    buckets = max(1, math.ceil(placed.count() / rows_a_task))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return dealt.withColumn("rank", rank).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot"))
