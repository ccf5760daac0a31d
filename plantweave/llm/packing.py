"""Filling fixed-capacity containers with items (problem 7): dominance reduction, then best fit.

Sizes, not documents, are what matters to a packing: the corpus is reduced to a histogram of sizes, which has at most
``capacity`` entries however many documents there are. The plan made from it (which sizes share a container, and how
many such containers) is joined back to the documents by their rank within their size.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

CAPACITY = 2_048
#: Rows of one size that are ranked in one task.
LANE_ROWS = 500_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str) -> object:
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): tokens of each whole text; null texts have none. ``tokenizer`` is a rank file all executors can read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array([len(encode(t)) if t else 0 for t in b["text"]], dtype="int64")})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, tokens long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(sizes in one container, containers of that kind)] for items of 1 .. capacity.

    The containers come from ``reduce`` and ``best_fit``; ``plan_parts`` tells which from which.
    """
    fixed, rest = plan_parts(histogram, capacity)
    return fixed + rest


def plan_parts(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], list[tuple[tuple[int, ...], int]]]:
    """(fixed, rest): containers fixed by dominance, and those of the remaining items by best fit."""
    fixed, left = reduce(histogram, capacity)
    return fixed, best_fit(left, capacity)


def reduce(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed containers, remaining histogram): reduction by dominance, as in Martello and Toth.

    For the largest remaining size, a set of up to three items that fills its container at least as well as any other set
    could is fixed for good:

    * the item alone, if not even the smallest item fits beside it;
    * the item with one other that fills the container exactly, as any set beside the item can change places with that one;
    * the item with the largest other k that fits, if no two fit beside it, or if any two that do together weigh no more than k;
    * the item with k and the largest m that fits beside both, if no three fit beside the item and of any two that do, the
      smaller weighs no more than m (the greater never weighs more than k).

    All containers of the same kind are fixed at once.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(content: tuple[int, ...], n: int) -> None:
        for size in content:
            left[size] -= n
            if not left[size]:
                del left[size]
                sizes.remove(size)

    def most(content: tuple[int, ...]) -> int:
        return min(left[s] // content.count(s) for s in set(content))

    def largest(room: int, without: tuple[int, ...]) -> int | None:
        """The largest size of at most ``room`` of which there is one besides ``without``."""
        i = bisect_right(sizes, room) - 1
        while i >= 0 and left[sizes[i]] <= without.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest(k: int, without: tuple[int, ...], above: int = 0) -> int | None:
        """The sum of the ``k`` smallest items over ``above`` besides ``without``; None if there are not so many."""
        total, i = 0, bisect_right(sizes, above)
        while k and i < len(sizes):
            n = min(k, left[sizes[i]] - without.count(sizes[i]))
            total, k, i = total + n * sizes[i], k - n, i + 1
        return None if k else total

    def fix(big: int) -> bool:
        room = capacity - big
        k = largest(room, (big,))
        chosen: tuple[int, ...] | None = None
        if k is None:
            chosen = (big,)
        elif k == room:
            chosen = (big, k)
        else:
            two, three = smallest(2, (big,)), smallest(3, (big,))
            if two is None or two > room:
                chosen = (big, k)
            elif three is None or three > room:
                m = largest(room - k, (big, k))
                over = smallest(2, (big,), m or 0)
                if _best_pair(sizes, left, room, big) <= k:
                    chosen = (big, k)
                elif m is not None and (over is None or over > room):
                    chosen = (big, k, m)
        if chosen:
            n = most(chosen)
            fixed.append((chosen, n))
            take(chosen, n)
        return chosen is not None

    for big in sorted(left, reverse=True):  # those that can't be fixed stay, as partners of smaller ones
        while left.get(big) and fix(big):
            pass
    return fixed, left


def _best_pair(sizes: list[int], left: dict[int, int], room: int, big: int) -> int:
    """The greatest sum of two items besides one ``big`` that fit into ``room``; 0 if none do."""
    free = [(s, left[s] - (s == big)) for s in sizes[: bisect_right(sizes, room)] if left[s] > (s == big)]
    best, i, j = 0, 0, len(free) - 1
    while i <= j:
        total = free[i][0] + free[j][0]
        if total > room or (i == j and free[i][1] < 2):
            j -= 1
            continue
        best = max(best, total)
        i += 1
    return best


def best_fit(rest: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, largest first, in whole runs of equal sizes."""
    # best fit of the remainder: open containers as free room -> {contents: count}
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = {}
            rooms.insert(bisect_right(rooms, room), room)
        open_[room][content] = open_[room].get(content, 0) + n

    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            i = bisect_right(rooms, size - 1)
            if i == len(rooms):
                each = capacity // size
                if n >= each:
                    put(capacity - each * size, (size,) * each, n // each)
                if n % each:
                    put(capacity - n % each * size, (size,) * (n % each), 1)
                break
            room = rooms[i]
            content, count = next(iter(open_[room].items()))
            m = min(n, count)
            if m == count:
                del open_[room][content]
            else:
                open_[room][content] = count - m
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            put(room - size, (*content, size), m)
            n -= m
    return [(c, n) for contents in open_.values() for c, n in contents.items()]


def pack(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(id, piece, tokens, container, offset): every item in a container, in none more than ``capacity``.

    An item longer than the capacity is cut into full containers and a last piece; no other is split. Items of size
    zero or null go to container 0 with no tokens. Ids may repeat: every row is placed. An empty table gives no rows.
    The histogram of at most ``capacity`` sizes in lanes of about LANE_ROWS rows is the only thing the driver sees, and it
    and the plan, with about as many kinds of container, are all that is broadcast. Documents are ranked within a size and
    lane; a very common size has as many lanes as it needs.
    """
    spark = sizes.sparkSession
    item = sizes.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    pieces = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    cutup = item.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)))
    tokens = F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity)
    cutup = cut(cutup.select("id", "piece", tokens.cast("int").alias("tokens"), F.xxhash64("id", "piece").alias("h")))
    rows = cutup.filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    parts = spark.createDataFrame([(r.tokens, -(-r.n // LANE_ROWS)) for r in rows], "tokens int, parts long")
    cutup = cutup.join(F.broadcast(parts), "tokens", "left").withColumn("lane", F.pmod("h", F.coalesce("parts", F.lit(1))).cast("int")).drop("h", "parts")
    counts = cutup.filter("tokens > 0").groupBy("tokens", "lane").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.collect()  # at most capacity + rows / LANE_ROWS rows
    histogram: dict[int, int] = {}
    lanes = []
    for r in sorted(seen, key=lambda r: (r.tokens, r.lane)):
        lanes.append((r.tokens, r.lane, histogram.get(r.tokens, 0)))
        histogram[r.tokens] = histogram.get(r.tokens, 0) + r.n
    kinds = plan(histogram, capacity)
    slots, used, first = [], dict.fromkeys(histogram, 0), 1
    for content, n in kinds:
        at = 0
        for size in content:
            slots.append((size, used[size], used[size] + n, first, at))
            used[size] += n
            at += size
        first += n
    lane = spark.createDataFrame(lanes, "tokens int, lane int, skip long")
    runs = F.broadcast(spark.createDataFrame(slots, "t int, lo long, hi long, first long, at int"))
    rank = F.row_number().over(Window.partitionBy("tokens", "lane").orderBy("id", "piece")) - 1
    ranked = cutup.filter("tokens > 0").join(F.broadcast(lane), ["tokens", "lane"]).withColumn("rank", rank + F.col("skip"))
    on = (F.col("tokens") == F.col("t")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.join(runs, on).select("id", "piece", "tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("container"), F.col("at").alias("offset"))
    none = cutup.filter("tokens <= 0").select("id", "piece", F.lit(0).alias("tokens"), F.lit(0).cast("long").alias("container"), F.lit(0).alias("offset"))
    return placed.unionByName(none).withColumnRenamed("id", id_col)


def audit(sizes: DataFrame, packed: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(documents, unplaced, split_short, overfull, overlapping, wasteful): rows of ``sizes`` and what is wrong with
    ``packed``: documents whose pieces don't add up to their size, documents split though they fit, containers over
    capacity, containers whose pieces overlap or leave gaps, and 1 if there are over 1 % and one more containers than the
    least number the total allows."""
    want = sizes.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0))).alias("size"))
    got = packed.groupBy(F.col(id_col).alias("id")).agg(F.sum("tokens").alias("placed"), F.max("piece").alias("last"))
    both = want.join(got, "id", "left")
    docs = both.agg(F.sum("rows").alias("documents"), F.count_if(~F.col("size").eqNullSafe(F.col("placed"))).alias("unplaced"), F.count_if((F.col("size") <= capacity) & (F.col("last") > 0)).alias("split_short"))
    boxes = packed.filter("container > 0").groupBy("container").agg(F.sum("tokens").alias("t"), F.max(F.col("offset") + F.col("tokens")).alias("end"))
    boxes = boxes.agg(F.count_if(F.col("t") > capacity).alias("overfull"), F.count_if(F.col("t") != F.col("end")).alias("overlapping"), (F.count(F.lit(1)) > F.ceil(F.sum("t") / capacity) * 1.01 + 1).cast("int").alias("wasteful"))
    return docs.withColumn("__k", F.lit(1)).join(boxes.withColumn("__k", F.lit(1)), "__k").drop("__k")
