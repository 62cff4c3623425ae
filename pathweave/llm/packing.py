"""Problem 7: texts packed into containers of a fixed number of tokens with little space unused.

Method: shortest-pack-first over the length histogram. Packing works on counts of lengths, not on documents: lengths are placed longest
first, each into the shortest open packs (those with the most room), so many equal packs are filled at once and a pack is a pattern
with a count. The histogram has at most as many entries as the capacity, whatever the corpus. The patterns are then joined
back to the documents by their rank among the documents of equal length.

Ranks are made without ordering all documents of a length in one task: each length is cut into buckets by hash, rows are numbered
within a bucket, and the buckets' offsets come from their counts. A length has more buckets the more texts have it.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.runtime import Scratch, ship

#: Texts in one bucket of a length, on average: a length has as many buckets as its texts need, however many have it.
BUCKET_TEXTS = 20_000

PLACED = "doc_id bigint, piece int, first_token bigint, n_tokens int, container bigint"


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (count, lengths) that place every length of the histogram (length -> how many) exactly so often.

    Open packs are kept by the room they have left. Each text goes to the shortest pack, the one with the most room; where that is too
    little there is no pack for it and a new one is opened. Equal packs are filled together: a step moves all packs of one pattern.
    """
    rooms: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> pattern -> count
    order: list[int] = []  # rooms in use, ascending

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            insort(order, room)
        rooms[room][pattern] = rooms[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not order or order[-1] < length:
                # all open packs are fuller: a new one takes this length until it is as full as they are, or the texts run out
                each = capacity // length
                many, rest = divmod(left, each)
                if many:
                    put(capacity - each * length, (length,) * each, many)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = order[-1]
            pattern, count = next(iter(rooms[room].items()))
            use = min(count, left)
            if use == count:
                del rooms[room][pattern]
            else:
                rooms[room][pattern] = count - use
            if not rooms[room]:
                del rooms[room]
                order.pop()
            put(room - length, (*pattern, length), use)
            left -= use
    return [(n, p) for room in order for p, n in rooms[room].items()]


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the ranks (from 0) at which its runs start and the container of each run's first text: a run of a pattern that
    occurs n times is n texts of consecutive ranks in n consecutive containers."""
    starts: dict[int, list[int]] = defaultdict(list)
    firsts: dict[int, list[int]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    container = 0
    for count, lengths in patterns:
        for length in lengths:
            starts[length].append(ranks[length])
            firsts[length].append(container)
            ranks[length] += count
        container += count
    return {k: (np.array(starts[k], dtype=np.int64), np.array(firsts[k], dtype=np.int64)) for k in starts}


def _place(slots: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value
        for part in parts:
            container = np.empty(len(part), dtype=np.int64)
            for length, rows in part.groupby("n_tokens").indices.items():
                start, first = table[int(length)]
                rank = part["rank"].to_numpy()[rows]
                k = np.searchsorted(start, rank, side="right") - 1
                container[rows] = first[k] + rank - start[k]
            yield part[["doc_id", "piece", "first_token", "n_tokens"]].assign(container=container)

    return run


def pack(sizes: DataFrame, capacity: int, bucket_texts: int = BUCKET_TEXTS) -> DataFrame:
    """p7: (doc_id, piece, first_token, n_tokens, container), one row per text, or per piece of a text longer than the capacity.

    sizes has (doc_id, n_tokens). A text of at most capacity tokens is whole in one container; a longer one is cut into pieces of
    capacity tokens, each a container of its own, and a rest that is packed like a text. Texts without tokens (0 or null) stay out.
    Containers are numbered from 0 without gaps. The same rows give the same packing. Rows with equal doc_id are packed each.
    """
    spark = sizes.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packs")
    texts = sizes.filter("n_tokens > 0")
    whole = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    cut = texts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    pieces, _ = scratch.write(cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - first).cast("int").alias("n_tokens")))
    lengths, _ = scratch.write(pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["n_tokens"]: r["n"] for r in lengths.collect()}  # at most capacity rows
    buckets = F.broadcast(lengths.select("n_tokens", (F.floor(F.col("n") / bucket_texts) + 1).alias("buckets")))  # as many
    bucketed = pieces.join(buckets, "n_tokens").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), "buckets")).drop("buckets")
    counts, _ = scratch.write(bucketed.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n")))
    slots = spark.sparkContext.broadcast(slots_of(pack_histogram(histogram, capacity)))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")
    ranked = bucketed.withColumn("r", F.row_number().over(within)).join(offsets, ["n_tokens", "bucket"])
    rows = ranked.select("doc_id", "piece", "first_token", "n_tokens", (F.col("r") - 1 + F.col("offset")).alias("rank"))
    return rows.mapInPandas(_place(slots), PLACED)
