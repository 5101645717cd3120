"""Minimax contiguous partition of ordered atomic groups into shards.

A group is the rows of equal texts. Groups stand in the order of their places, and each shard is a range of places. A
group's place is the XXH64 of its text, except for heavy groups (over 1/64 of a mean shard; fewer than 64 for each
shard): these are placed so that they lie evenly among the others, each in the middle of the stretch that its shard
would fill if the largest went to the lightest first. That choice only orders the groups; where the shards end follows
from the order alone: the smallest capacity for which a greedy pass over all groups needs no more than the shards is
found by binary search, and the order is cut there.

A group as large as that capacity is a shard of its own. The order falls into stretches before and after it, and the
same search divides the other shards among these (and so on), so one huge group does not starve the rest of shards.

The driver never holds all groups. It searches over at most a few times 65,536 ranges of places; a range is atomic if
it holds one group, else the search with the range as fluid bounds the cuts on one side, with the range as atomic on
the other, and the ranges in which a cut may fall are refined by 16 more bits of the place until both agree.

Edge cases: a null text has size 1 and forms a group with the empty text; repeated rows count as often as they occur;
null ids are carried; an empty table gives no rows; with fewer groups than shards some shards are empty. Different texts
of one hash, or a text whose hash is a heavy group's place, are one group, which no law forbids. Very long texts are
heavy groups. Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 16


class Range:
    """Groups whose places share a prefix: first place, bits left below the prefix, weight, groups."""

    __slots__ = ("first", "left", "weight", "groups")

    def __init__(self, first: int, left: int, weight: int, groups: int):
        self.first, self.left, self.weight, self.groups = first, left, weight, groups

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or not self.left


def places(heavy: list[tuple[int, int]], rest: int, shards: int) -> dict[int, int]:
    """The place of each heavy group (hash, weight), amid light groups of the weight `rest` in all.

    The largest goes to the lightest shard, ties by number; a shard's stretch of the hashes is the share of the light
    groups that would fill it up, and its heavy groups stand in the middle of that, right before a range of BITS bits.
    """
    load, own = [0] * shards, [[] for _ in range(shards)]
    for key, weight in sorted(heavy, key=lambda x: (-x[1], x[0])):
        i = min(range(shards), key=lambda k: (load[k], k))
        own[i].append(key)
        load[i] += weight
    low, high = 0, max(load) + rest
    while low < high:  # the level up to which light groups fill the shards
        level = (low + high) // 2
        low, high = (level + 1, high) if sum(max(0, level - x) for x in load) < rest else (low, level)
    room = [max(0, low - x) for x in load]
    total, at, out, used = max(1, sum(room)), 0, {}, {}
    for keys, x in zip(own, room, strict=True):
        middle = min((1 << BITS) - 1, max(1, round((at + x / 2) / total * (1 << BITS))))
        for key in keys:
            used[middle] = used.get(middle, 0) + 1
            out[key] = ((middle - (1 << (BITS - 1))) << (64 - BITS)) - used[middle]
        at += x
    return out


def greedy(capacity: int, ends: list[int], fluid: list[bool], i: int, j: int, most: int) -> list[int] | None:
    """Where shards end (amounts from the start of all) that take ranges i to j in order, each all it has room for.

    ends: the summed weights up to each range; a fluid range may be cut anywhere. None if it takes over `most` shards.
    """
    at, end, out = ends[i - 1] if i else 0, ends[j - 1] if j else 0, []
    while at < end:
        k = bisect_right(ends, at + capacity, i, j)
        to = end if k == j else at + capacity if fluid[k] else ends[k - 1] if k else 0
        if to <= at or len(out) == most:
            return None
        out.append(to)
        at = to
    return out


def smallest(ends: list[int], fluid: list[bool], parts: list[tuple[int, int]], shards: int) -> int:
    """The smallest capacity for which the parts (ranges i to j) need no more than the shards, by binary search."""

    def feasible(capacity: int) -> bool:
        left = shards
        for i, j in parts:
            got = greedy(capacity, ends, fluid, i, j, left)
            if got is None:
                return False
            left -= len(got)
        return True

    low, high = 0, ends[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def divided(ends: list[int], fluid: list[bool], shards: int) -> list[int]:
    """The ends of at most `shards` shards: the largest as small as can be, then the largest of the rest, and so on."""
    weights = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    parts, alone, left = [(0, len(ends))], [], shards
    while True:
        parts = [p for p in parts if p[0] < p[1]]
        if not parts or not left:
            break
        capacity = smallest(ends, fluid, parts, left)
        k = next((k for i, j in parts for k in range(i, j) if weights[k] == capacity and not fluid[k]), None)
        if k is None:
            break
        alone.append(ends[k])
        parts = [q for i, j in parts for q in (((i, k), (k + 1, j)) if i <= k < j else ((i, j),))]
        left -= 1
    if parts and left:
        need = [len(greedy(capacity, ends, fluid, i, j, left)) for i, j in parts]
        for _ in range(left - sum(need)):  # shards to spare go where the mean is largest
            most = max(range(len(parts)), key=lambda x: (ends[parts[x][1] - 1] - (ends[parts[x][0] - 1] if parts[x][0] else 0)) / need[x])
            need[most] += 1
        for (i, j), n in zip(parts, need, strict=True):
            alone += greedy(smallest(ends, fluid, [(i, j)], n), ends, fluid, i, j, n)
    return sorted(set(alone))


def cuts(groups: DataFrame, shards: int) -> tuple[dict[int, int], list[int]]:
    """groups (h, weight): the heavy groups' places, and the first place of each shard after the first."""
    top = groups.agg(F.sum("weight")).first()[0]
    if top is None:
        return {}, []
    limit = max(1, int(top) // (64 * shards))
    # fewer than 64 * shards groups can weigh more than that share of the whole
    heavy = [(r["h"], int(r["weight"])) for r in groups.filter(F.col("weight") > limit).collect()]
    of = places(heavy, int(top) - sum(w for _, w in heavy), shards)
    light = groups.filter(F.col("weight") <= limit)

    def ranges(rows: DataFrame, left: int) -> list[Range]:
        got = rows.groupBy(F.shiftright("h", left).alias("p") if left else F.col("h").alias("p")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
        return [Range(r["p"] << left, left, int(r["w"]), r["n"]) for r in got]

    order = lambda rs: sorted(rs, key=lambda r: r.first)
    known = order([*ranges(light, 64 - BITS), *(Range(of[h], 0, w, 1) for h, w in heavy)])
    while True:
        ends, atomic = list(accumulate(r.weight for r in known)), [r.atomic for r in known]
        from_, to = divided(ends, [not a for a in atomic], shards), divided(ends, [False] * len(known), shards)
        pairs = list(zip(from_, to, strict=True)) if len(from_) == len(to) else [(x, x) for x in {*from_, *to}]
        open_ = set()
        for a, b in pairs:  # a cut may fall in any range from the one to the other
            if a != b or len(from_) != len(to):
                i, j = bisect_right(ends, min(a, b)), bisect_right(ends, max(a, b))
                open_.update(k for k in range(max(0, i - 1), min(len(known), j + 1)) if not atomic[k])
        if not open_:
            break
        by_left: dict[int, list[Range]] = {}
        for k in sorted(open_):
            by_left.setdefault(known[k].left, []).append(known[k])
        fresh: list[Range] = []
        for left, rs in by_left.items():
            wanted = light.sparkSession.createDataFrame([(r.first >> left,) for r in rs], "p bigint")  # of the ranges here
            fresh += ranges(light.withColumn("p", F.shiftright("h", left)).join(F.broadcast(wanted), "p"), max(0, left - BITS))
        known = order([*(r for k, r in enumerate(known) if k not in open_), *fresh])
    return of, [known[k].first for x in to if (k := bisect_right(ends, x)) < len(known)]


def numbered(rows: DataFrame, shard: str, slot: str) -> DataFrame:
    """rows with a number from 0, gapless within each shard.

    Rows are counted by the partition that they were read in and shard; a row's number is the sum of its shard's counts
    in earlier partitions and its place among its partition's rows. No task sorts more of a shard than one partition's.
    """
    rows = cut(rows)
    placed = rows.withColumn("__p", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    counts = placed.groupBy("__p", shard).agg(F.count("*").alias("__n"))  # a row for each partition and shard
    before = Window.partitionBy(shard).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("__p", shard, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__p", shard).orderBy("__at")) - 1
    out = placed.withColumn("__place", place).join(first, ["__p", shard])
    return out.select(*rows.columns, (F.col("__first") + F.col("__place")).cast("bigint").alias(slot))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, shard, slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    groups = cut(rows.groupBy("h").agg(F.sum("size").alias("weight")))
    of, starts = cuts(groups, shards)
    if of:
        heavy = docs.sparkSession.createDataFrame(list(of.items()), "h bigint, place bigint")  # fewer than 64 * shards rows
        rows = rows.join(F.broadcast(heavy), "h", "left").withColumn("h", F.coalesce("place", "h")).drop("place")
    number = F.lit(0)
    for x in starts:
        number = number + (F.col("h") >= F.lit(x)).cast("int")
    return numbered(rows.withColumn("shard", number).drop("h"), "shard", "slot")
