"""Filling containers of fixed capacity with documents (problem 8).

Each chunk of ``CHUNK`` consecutive documents is filled by itself, where it lies: next fit, which opens a bin whenever a
document does not fit the last one, gives a cheap start in the documents' order, far from full. Swap-based local search does the
rest: the least filled bin gives its documents to fuller ones, by moving one, by exchanging one for one or two for one,
whichever raises the sum of squared fills most, until it is empty or nothing raises it; passes go on until one empties no bin.
A bin of any length is searched whole: different sizes that fit a bin together are few (the first k add up to k²/2), so
all sums of two are listed, and the best partner of each foreign document is found by bisection.

Bins below ``UNDERFULL`` then meet those of other chunks, in chunks of the same size, level by level, as long as a level
lowers their number. No task ever holds more than a chunk, and no underfull bin is left behind while that helps.

Defined results: every document is in exactly one bin of each profile, documents of size 0 too (they take no room); one
that exceeds the capacity alone is cut into parts that fill bins, the last part is packed like a document; profiles
with a null or non-positive capacity get nothing; null sizes count as 0; null and repeated doc_ids are documents like any.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import collect_bounded, cut

CHUNK = 4096  # documents packed together
UNDERFULL = 0.99  # bins below this fill go on to the next level
PROFILES = 1000  # bound on the profiles table


def next_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item, in order: the last bin if it fits, else a new one."""
    where, bins, room = [], -1, -1
    for s in sizes:
        if s > room:
            bins, room = bins + 1, capacity
        where.append(bins)
        room -= s
    return where


class Bins:
    """Items in bins, with the bins' room in order."""

    def __init__(self, sizes: list[int], where: list[int], capacity: int):
        self.capacity = capacity
        self.size, self.at = np.array(sizes, dtype=np.int64), np.array(where, dtype=np.int64)
        self.fill = np.bincount(self.at, weights=self.size).astype(np.int64)
        self.members: list[set[int]] = [set() for _ in self.fill]
        for i, b in enumerate(where):
            self.members[b].add(i)
        self.rooms = sorted((capacity - f, b) for b, f in enumerate(self.fill.tolist()) if 0 < f < capacity)

    def put(self, item: int, b: int) -> None:
        old, n = int(self.at[item]), int(self.size[item])
        self.members[old].remove(item)
        self.members[b].add(item)
        self.at[item] = b
        for k, new in ((old, int(self.fill[old]) - n), (b, int(self.fill[b]) + n)):
            f = int(self.fill[k])
            if 0 < f < self.capacity:
                self.rooms.pop(bisect_left(self.rooms, (self.capacity - f, k)))
            self.fill[k] = new
            if 0 < new < self.capacity:
                insort(self.rooms, (self.capacity - new, k))

    def moves(self, b: int) -> set[int]:
        """Move items of ``b``, largest first, each into the fullest bin that has room and is no emptier; those bins."""
        into = set()
        for i in sorted(self.members[b], key=lambda i: (-self.size[i], i)):
            k = bisect_left(self.rooms, (int(self.size[i]), -1))
            if k < len(self.rooms) and self.rooms[k][1] == b:
                k += 1
            if k < len(self.rooms) and self.rooms[k][0] <= self.capacity - self.fill[b]:
                into.add(self.rooms[k][1])
                self.put(i, self.rooms[k][1])
        return into

    def exchange(self, b: int) -> int | None:
        """The exchange of one or two items of ``b`` for one of a fuller bin that fills the latter most; that bin."""
        mine = np.array(sorted(self.members[b]))
        values, first, count = np.unique(self.size[mine], return_index=True, return_counts=True)
        x, y = np.triu_indices(len(values))
        pair = (x != y) | (count[x] > 1)  # two of one size must be two items
        x, y = x[pair], y[pair]
        units = np.concatenate((values, values[x] + values[y]))
        order = np.argsort(units, kind="stable")
        units = units[order]
        fuller = (self.fill < self.capacity) & (self.fill >= self.fill[b])
        fuller[b] = False
        theirs = np.flatnonzero(fuller[self.at])
        if not len(theirs):
            return None
        own = self.size[theirs]
        k = np.searchsorted(units, own + self.capacity - self.fill[self.at[theirs]], side="right") - 1
        gain = np.where(k >= 0, units[np.maximum(k, 0)] - own, 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            return None
        u, back = int(order[k[best]]), int(theirs[best])
        if u < len(values):
            items = [int(mine[first[u]])]
        else:
            u -= len(values)
            of = [i for i in mine.tolist() if self.size[i] == values[y[u]]]
            one = int(mine[first[x[u]]])
            items = [one, next(i for i in of if i != one)]
        a = int(self.at[back])
        self.put(back, b)
        for i in items:
            self.put(i, a)
        return a

    def emptiest(self, given_up: set[int]) -> int | None:
        return next((b for _, b in reversed(self.rooms) if b not in given_up), None)


def local_search(sizes: list[int], where: list[int], capacity: int) -> list[int]:
    """Exchange items between bins, raising the sum of squared fills, until a pass over all bins empties none."""
    bins = Bins(sizes, where, capacity)
    emptied = True
    while emptied:
        emptied, given_up = False, set()
        while (b := bins.emptiest(given_up)) is not None:
            while bins.fill[b] and ((into := bins.moves(b)) or (bins.fill[b] and (got := bins.exchange(b)) is not None and (into := {got}))):
                given_up -= into  # a bin that changed may have something to give again
            if bins.fill[b]:
                given_up.add(b)
            emptied |= not bins.fill[b]
    return bins.at.tolist()


def pack(sizes: list[int], capacity: int, start: list[int] | None = None) -> list[int]:
    """Bin number of each item (dense, from 0), from next fit or from given bins; items of size 0 go to the first bin."""
    real = [i for i, s in enumerate(sizes) if s > 0]
    where = [0] * len(sizes)
    if real:
        some = [sizes[i] for i in real]
        got = local_search(some, next_fit(some, capacity) if start is None else np.unique([start[i] for i in real], return_inverse=True)[1].tolist(), capacity)
        number: dict[int, int] = {}
        for i, b in zip(real, got):
            where[i] = number.setdefault(b, len(number))
    return where


ITEM = pa.schema([
    ("profile", pa.string()), ("capacity", pa.int64()), ("chunk", pa.int64()), ("bin", pa.int64()), ("doc_id", pa.int64()),
    ("part", pa.int64()), ("tokens", pa.int64()), ("carry", pa.bool_()),
])
ITEM_SQL = "profile string, capacity long, chunk long, bin long, doc_id long, part long, tokens long, carry boolean"


def _packed(profile: str, capacity: int, chunk: int, ids: pa.Array, part: pa.Array, sizes: list[int], start=None) -> pa.Table:
    where = pack(sizes, capacity, start)
    carry = np.bincount(where, weights=sizes) < UNDERFULL * capacity
    n = len(sizes)
    return pa.table([
        pa.array([profile] * n, pa.string()), pa.array([capacity] * n, pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array(where, pa.int64()),
        ids, part, pa.array(sizes, pa.int64()), pa.array(carry[where], pa.bool_()),
    ], schema=ITEM)


def _first(profiles: list[tuple[str, int]], chunk: int):
    """Level 0: consecutive documents of a partition, packed where they lie."""

    def run(batches):
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.column("n").to_numpy()
            for profile, capacity in profiles:
                # a document that alone exceeds the capacity: full parts are bins of their own, the rest is an item
                full = np.where(n > capacity, n // capacity, 0)
                keep = np.flatnonzero((n > full * capacity) | (full == 0))
                if len(keep):
                    yield from _packed(profile, capacity, number, t.column("doc_id").combine_chunks().take(pa.array(keep)), pa.array(full[keep]), (n - full * capacity)[keep].tolist()).to_batches()

        for b in batches:
            while b.num_rows:
                head = b.slice(0, chunk - rows)
                held.append(head)
                rows += head.num_rows
                b = b.slice(head.num_rows)
                if rows == chunk:
                    yield from flush()
                    number, held, rows = number + 1, [], 0
        if rows:
            yield from flush()

    return run


def _again(t: pa.Table) -> pa.Table:
    """A later level: underfull bins of several chunks, searched from where they are."""
    t = t.sort_by([("from_chunk", "ascending"), ("bin", "ascending"), ("tokens", "descending"), ("doc_id", "ascending"), ("part", "ascending")])
    start = np.unique(np.stack((t.column("from_chunk").to_numpy(), t.column("bin").to_numpy())), axis=1, return_inverse=True)[1].reshape(-1).tolist()
    first = [t.column(c)[0].as_py() for c in ("profile", "capacity", "chunk")]
    return _packed(*first, t.column("doc_id").combine_chunks(), t.column("part").combine_chunks(), t.column("tokens").to_pylist(), start)


def fill(sized: DataFrame, profiles: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``sized(doc_id, tokens)`` into containers: (profile, bin_id, doc_id, part, tokens)."""
    sizes_of = [
        (r["profile"], int(r["capacity"])) for r in collect_bounded(profiles.select("profile", "capacity").distinct(), PROFILES, "pack profiles")
        if r["capacity"] is not None and r["capacity"] > 0
    ]
    spark = sized.sparkSession
    out_schema = "profile string, bin_id string, doc_id long, part long, tokens long"
    if not sizes_of:
        return spark.createDataFrame([], out_schema)
    # sizes are costly and read by every branch below: computed once, two numbers a document
    sized = cut(sized.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("n")))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).cast("long").alias("capacity")) for p, c in sizes_of)))
    out = (
        sized.where(F.col("n") > min(c for _, c in sizes_of)).select("doc_id", "n", each.alias("p")).where("n > p.capacity")
        .select("p.profile", "p.capacity", "doc_id", F.explode(F.expr("sequence(0, n div p.capacity - 1)")).alias("part"))
        .select("profile", F.concat(F.lit("full-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), F.monotonically_increasing_id()).alias("bin_id"), "doc_id", F.col("part").cast("long"), F.col("capacity").alias("tokens"))
    )
    done, depth, before = cut(sized.mapInArrow(_first(sizes_of, chunk), ITEM_SQL)), 0, None
    while True:
        low = done.where("carry")
        # bins of this level, and what would go up
        bins, items = done.agg(F.count_distinct("profile", "chunk", "bin"), F.count_if("carry")).first()
        last = not items or (before is not None and bins >= before)
        kept = done if last else done.where("not carry")
        out = out.unionByName(kept.select("profile", F.concat(F.lit(f"{depth}-"), F.col("chunk"), F.lit("-"), F.col("bin")).alias("bin_id"), "doc_id", "part", "tokens"))
        if last:
            return out
        before = low.select("profile", "chunk", "bin").distinct().count()
        depth, chunks = depth + 1, max(1, -(-items // (chunk * len(sizes_of))))
        up = low.withColumnRenamed("chunk", "from_chunk").withColumn("chunk", F.pmod(F.xxhash64("from_chunk", "bin", F.lit(depth)), F.lit(chunks))).drop("carry")
        done = cut(up.groupBy("profile", "capacity", "chunk").applyInArrow(_again, ITEM_SQL))
