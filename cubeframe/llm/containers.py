"""Filling containers of fixed capacity: a plan over the histogram of lengths, then items take its slots by rank.

The plan is best-fit decreasing over counts, not items: lengths fall from the capacity to 1, and all items of a length go,
together, into the tightest open containers, then into new ones. Runs of equal containers are kept as ranges, so that the
plan's size depends on the capacity (at most that many lengths), never on the number of items; only the histogram, at
most ``capacity`` rows, comes to the driver. Items then join the slots of their length by their rank within it. The rank
is counted in buckets (a row number within length and bucket plus the items of earlier buckets), so that a length which
a third of all items share is no bottleneck.

An item above the capacity is cut into full containers' worth and a rest; no other item is cut.

Defined results: items without tokens (null, empty) need no space and are in container 0; repeated items are placed as
often as they come; an empty table gives an empty result. The assignment is the same for the same items.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.session import broadcast_if_small, checkpointed

CAPACITY = 8192
BUCKETS = 256

_SLOTS = "length int, first bigint, last bigint, container bigint, each int"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots: (length, first rank, rank after the last, first container, items per container)."""
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first container, how many)
    rooms: list[int] = []
    slots, fresh = [], 0

    def keep(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[at]
            else:
                room, first, many = capacity, fresh, -(-left // (capacity // length))
                fresh += many
            each = room // length
            full = min(many, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each))
                rank, left = rank + full * each, left - full * each
                keep(room - each * length, first, full)
            if full < many and left:  # the last container takes the rest
                slots.append((length, rank, rank + left, first + full, left))
                keep(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            keep(room, first + full, many - full)
    return slots


def fill(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, token_from, n_tokens, container: every item, or every piece of an item above the capacity, placed.

    items: key and size only matter; the size must be cheap to read again or checkpointed.
    """
    spark = items.sparkSession
    whole = F.floor(F.greatest(F.col(size) - 1, F.lit(0)) / capacity).cast("int")
    cut = items.select(F.col(key), F.col(size).cast("int").alias("_size"), F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    cut = cut.select(key, "piece", (F.col("piece") * capacity).alias("token_from"), F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).alias("n_tokens"))
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(BUCKETS)).cast("int"))

    some = cut.where("n_tokens > 0")
    per_bucket = checkpointed(some.groupBy("n_tokens", "_bucket").agg(F.count("*").alias("_n")))
    histogram = {r[0]: r[1] for r in per_bucket.groupBy("n_tokens").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    before = Window.partitionBy("n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("n_tokens", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = some.join(broadcast_if_small(offsets, len(histogram) * BUCKETS, 24), ["n_tokens", "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy("n_tokens", "_bucket").orderBy(key, "piece")) - 1
    )
    slot = broadcast_if_small(spark.createDataFrame(slots, _SLOTS), len(slots), 40)
    placed = ranked.join(slot, (F.col("n_tokens") == F.col("length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last")))
    container = F.col("container") + F.floor((F.col("_rank") - F.col("first")) / F.col("each"))
    out = placed.select(key, "piece", "token_from", "n_tokens", container.cast("bigint").alias("container"))
    return out.union(cut.where("n_tokens <= 0").select(key, "piece", "token_from", F.lit(0).alias("n_tokens"), F.lit(0).cast("bigint").alias("container")))


def usage(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, their tokens, the fewest containers that could hold them, the largest load."""
    loads = placed.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("load"))
    return loads.agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.ceil(F.sum("load") / capacity).alias("fewest"), F.max("load").alias("largest"))
