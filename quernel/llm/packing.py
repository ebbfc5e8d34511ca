"""Packing documents into windows of fixed capacity, balanced by cost (problem 6).

The cost of a document in a sequence is linear plus quadratic in its tokens, as that of attention. Documents
go in descending order to the lowest-cost sequence that has room for them. Where lowest cost alone takes more
sequences than the tokens need, documents below a fraction of the capacity, which come last, go where they leave
the least room, and only a document that fits nowhere opens a new sequence. The fractions in ``FINE`` are
tried in order, lowest cost alone first, until no sequence could be saved.

Documents are spread over groups by hash, and each group is packed by one task; a group's size is set by
``GROUP``, so neither a hot source nor the number of documents makes one task larger. A group costs at most
about one window of unused room.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import bounded_rows, small

GROUP = 25_000
FINE = (0.0, 0.25, 0.5, 1.0)
#: Cost of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
MOST_WINDOWS = 1_000


def pack(sizes: list[int], capacity: int, fine: float = 0.25) -> list[int]:
    """The sequence of each size, none above ``capacity``; sequences are numbered from 0.

    ``fine`` 0 packs by lowest cost alone. Ties go to the earlier document and the lower sequence.
    """
    if any(not 0 < s <= capacity for s in sizes):
        raise ValueError("every size must lie between 1 and the capacity")
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    where = [0] * len(sizes)
    total = sum(sizes)
    n = max(-(-total // capacity), sum(2 * s > capacity for s in sizes))
    room = [capacity] * n
    heap = [(0.0, k) for k in range(n)]
    waiting: list[tuple[int, float, int]] = []  # sequences without room for the size at hand, most room first
    at = 0
    while at < len(order) and sizes[order[at]] > fine * capacity:
        size = sizes[order[at]]
        while waiting and -waiting[0][0] >= size:
            _, cost, k = heapq.heappop(waiting)
            heapq.heappush(heap, (cost, k))
        while heap and room[heap[0][1]] < size:
            cost, k = heapq.heappop(heap)
            heapq.heappush(waiting, (-room[k], cost, k))
        if heap:
            cost, k = heapq.heappop(heap)
        else:
            cost, k = 0.0, len(room)
            room.append(capacity)
        room[k] -= size
        where[order[at]] = k
        heapq.heappush(heap, (cost + LINEAR * size + QUADRATIC * size * size, k))
        at += 1
    # The small ones: sequences by the room they have left.
    by_room: dict[int, list[int]] = {}
    for k in range(len(room) - 1, -1, -1):
        by_room.setdefault(room[k], []).append(k)
    rooms = sorted(by_room)
    for i in order[at:]:
        size = sizes[i]
        p = bisect_left(rooms, size)
        if p == len(rooms):
            k, left = len(room), capacity
            room.append(capacity)
        else:
            left = rooms[p]
            k = by_room[left].pop()
            if not by_room[left]:
                del by_room[left], rooms[p]
        where[i] = k
        left -= size
        room[k] = left
        if left in by_room:
            by_room[left].append(k)
        else:
            by_room[left] = [k]
            insort(rooms, left)
    return where


def pack_tight(sizes: list[int], capacity: int) -> list[int]:
    """The packing with the fewest sequences among those of ``FINE``, the most balanced of them."""
    bound = max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    best: list[int] = []
    for fine in FINE:
        where = pack(sizes, capacity, fine)
        if not best or max(where) < max(best):
            best = where
        if max(best, default=-1) + 1 <= bound:
            break
    return best


def packed(docs: DataFrame, windows: DataFrame, seed: int = 0) -> DataFrame:
    """(window_name, window_id, doc_id, from_token, n_tokens): where every token of every document lies.

    ``docs`` has doc_id and n_tokens; those without tokens lie nowhere. A document above the capacity fills
    whole windows and only its rest is packed with others; no other document is split. Repeated documents
    are packed each. ``windows`` has window_name and capacity_tokens; null and non-positive capacities are
    left out.
    """
    spec = bounded_rows(windows.select("window_name", "capacity_tokens").where("capacity_tokens > 0").distinct(), MOST_WINDOWS, "the windows")
    schema = "window_name string, window_id string, doc_id long, from_token long, n_tokens long"
    # Repeated rows get numbers, so that nothing depends on the order or the partitions in which rows come.
    counted = docs.where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("rows"))
    if not spec:
        return counted.sparkSession.createDataFrame([], schema)
    groups = max(1, -(-(counted.agg(F.sum("rows")).first()[0] or 0) // GROUP))
    each = F.explode(F.array(*[F.struct(F.lit(r.window_name).alias("window_name"), F.lit(int(r.capacity_tokens)).cast("long").alias("capacity")) for r in spec]))
    numbered = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    wanted = numbered.select("doc_id", "n_tokens", "copy", each.alias("w")).select("doc_id", "n_tokens", "copy", "w.*")
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "n_tokens", "copy"), F.lit(groups)).cast("int") if groups > 1 else F.lit(0)

    whole = wanted.where("n_tokens >= capacity").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_tokens") / F.col("capacity")) - 1)).alias("k"))
    filled = whole.select("window_name", F.concat_ws("-", F.lit("d"), "doc_id", "n_tokens", "copy", "k").alias("window_id"), "doc_id", (F.col("k") * F.col("capacity")).alias("from_token"), F.col("capacity").alias("n_tokens"))
    rest = wanted.withColumn("size", F.col("n_tokens") % F.col("capacity")).where("size > 0").withColumn("g", group)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "n_tokens", "copy"]).reset_index(drop=True)
        name, g, capacity = frame["window_name"].iloc[0], frame["g"].iloc[0], int(frame["capacity"].iloc[0])
        where = pack_tight(frame["size"].tolist(), capacity)
        return pd.DataFrame({"window_name": name, "window_id": [f"g{g}-{k}" for k in where], "doc_id": frame["doc_id"], "from_token": frame["n_tokens"] - frame["size"], "n_tokens": frame["size"]})

    return rest.groupBy("window_name", "capacity", "g").applyInPandas(fill, schema).unionByName(filled)


def packing_report(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: n_windows, n_tokens, unused_share, and cost_spread, the largest sequence's cost over the mean."""
    cost = F.sum(F.col("n_tokens") * LINEAR + F.col("n_tokens") * F.col("n_tokens") * QUADRATIC)
    each = placed.groupBy("window_name", "window_id").agg(F.sum("n_tokens").alias("tokens"), cost.alias("cost"))
    return (
        each.groupBy("window_name").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("tokens").alias("n_tokens"), (F.max("cost") / F.avg("cost")).alias("cost_spread"))
        .join(small(windows.select("window_name", "capacity_tokens")), "window_name")
        .select("window_name", "n_windows", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_windows") * F.col("capacity_tokens"))).alias("unused_share"), "cost_spread")
    )


def conservation(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: n_tokens and n_docs that lie somewhere, and n_overfull, the sequences above the capacity."""
    each = placed.groupBy("window_name", "window_id").agg(F.sum("n_tokens").alias("held"))
    capacity = small(windows.select("window_name", "capacity_tokens").where("capacity_tokens > 0").distinct())
    over = each.join(capacity, "window_name").groupBy("window_name").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("n_overfull"))
    return placed.groupBy("window_name").agg(F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs")).join(small(over), "window_name")
