"""Records that differ only in formatting (problem 6).

A submission is a JSON object, ``key=value`` pairs split by ``;`` or ``key: value`` pairs split by ``|`` or newlines. Its
five fields, reduced to letters and digits in one letter case, are its canonical bytes. Counting:

1. each map task puts its records into tries with terminal counters, so copies within a task become one partial;
2. recursive radix partitioning: the partials' bytes are split by their first bytes; buckets that hold more than ``TASK``
   partials are split by further bytes, and so on, until each fits a task (equal bytes cannot be split, but after step 1
   they are at most one partial per emptied trie). Each round looks ``STEP`` bytes ahead in one pass. Only the prefixes of
   oversized buckets reach the driver; a prefix is one of at most ``PREFIXES`` because a wave has no more than PREFIXES * TASK
   partials, and data beyond that are worked off in several waves of keys;
3. within its task a bucket is split on in the same way until each part has at most ``BUCKET`` partials, and one trie at
   a time adds them up: copies and smallest id of each record.

Records are then led back to their group: groups that hold more than one in ``HOT`` of all rows are fewer than HOT and are
broadcast, the others meet their records in a shuffle in which no key is hot. Long keys go by their SHA-256.

Defined results: a null or unreadable text counts as a record with five empty fields; absent, null and empty fields are
equal; names of unknown fields are ignored, of a repeated field the last value holds; null ids take no part as first
id and give no row.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import collect_bounded, cut, widen

FIELDS = ("mapname", "mapdataname", "widthtiles", "heighttiles", "tilesetkey")
BUCKET = 20_000  # partials in one trie, at most
TASK = 500_000  # partials in one task, at most
PREFIXES = 65_536  # bound on the oversized prefixes of a wave
STEP = 3  # bytes that a round looks ahead
TERMINALS = 200_000  # records in a map task's trie before it is emptied
HOT = 50_000  # groups above this share (one in so many rows) are broadcast
LONG = 64  # bytes of a key beyond which its hash stands for it in joins
NOT_LETTER = re.compile(r"[^a-z]")
LINES = re.compile(r"[|\n\r]")


def fields(raw: str | None) -> dict[str, str]:
    """Field name (lower case, letters only) -> value as text."""
    text = (raw or "").strip()
    pairs: list[tuple[str, object]] = []
    if text.startswith("{"):
        try:
            loaded = json.loads(text)
            pairs = list(loaded.items()) if isinstance(loaded, dict) else []
        except ValueError:
            pairs = []
    else:
        parts, mark = (text.split(";"), "=") if "=" in text else (LINES.split(text), ":")
        pairs = [(k, v) for k, m, v in (p.partition(mark) for p in parts) if m]
    out = {}
    for k, v in pairs:
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        out[NOT_LETTER.sub("", str(k).lower())] = "" if v is None else str(v)
    return out


def canonical(raw: str | None) -> bytes:
    got = fields(raw)
    return "\x1f".join(letters(got.get(f, "")) for f in FIELDS).encode()


def letters(value: str) -> str:
    """Letters and digits in one case; upper first, so that letters with one capital for two small ones meet."""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFC", value).upper().casefold()))


class Trie:
    """Path-compressed byte trie; a terminal has the number of copies and the smallest id."""

    __slots__ = ("root", "terminals")

    def __init__(self):
        self.root: list = [{}, 0, None]  # children: first byte -> [label, node]; copies; first id
        self.terminals = 0

    def add(self, key: bytes, copies: int, first: int | None) -> None:
        node, at, n = self.root, 0, len(key)
        while at < n:
            edge = node[0].get(key[at])
            if edge is None:
                new: list = [{}, 0, None]
                node[0][key[at]] = [key[at:], new]
                node, at = new, n
                break
            label = edge[0]
            if key.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            k, m = 1, min(len(label), n - at)
            while k < m and label[k] == key[at + k]:
                k += 1
            mid: list = [{label[k]: [label[k:], edge[1]]}, 0, None]
            edge[0], edge[1] = label[:k], mid
            node, at = mid, at + k
        self.terminals += node[1] == 0
        node[1] += copies
        if first is not None and (node[2] is None or first < node[2]):
            node[2] = first

    def items(self) -> Iterator[tuple[bytes, int, int | None]]:
        stack = [(b"", self.root)]
        while stack:
            key, node = stack.pop()
            if node[1]:
                yield key, node[1], node[2]
            stack.extend((key + label, child) for label, child in node[0].values())


PARTIAL = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("first_id", pa.int64())])
PARTIAL_SQL = "key binary, copies long, first_id long"


def _table(rows) -> pa.RecordBatch:
    keys, copies, firsts = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), pa.array(firsts, pa.int64())], schema=PARTIAL)


def partials(records: DataFrame) -> DataFrame:
    """Step 1: (key, copies, first_id), at most one per key and emptied trie."""

    def run(batches):
        trie = Trie()
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                trie.add(canonical(raw), 1, i)
            if trie.terminals > TERMINALS:
                yield _table(list(trie.items()))
                trie = Trie()
        yield _table(list(trie.items()))

    return widen(records.select("record_id", "raw")).mapInArrow(run, PARTIAL_SQL)


def bucket_of(key: bytes, splits: set[bytes]) -> bytes:
    n = 0
    while n < len(key) and key[:n] in splits:
        n += 1
    return key[:n]


def radix_splits(parts: DataFrame, total: int, capacity: int, step: int = STEP) -> set[bytes]:
    """Step 2: the prefixes whose buckets hold more than ``capacity`` of all ``total`` partials, ``step`` bytes a round."""
    splits: set[bytes] = set()
    level, depth = ({b""} if total > capacity else set()), 0
    while level:
        splits |= level
        shared = parts.sparkSession.sparkContext.broadcast(level)

        def count(batches, shared=shared, depth=depth):
            last = shared.value
            for b in batches:
                n: dict[bytes, int] = {}
                for key in b.column(0).to_pylist():
                    if len(key) > depth and key[:depth] in last:  # what ends here cannot be split
                        for k in range(depth + 1, min(depth + step, len(key) - 1) + 1):
                            n[key[:k]] = n.get(key[:k], 0) + 1
                yield pa.RecordBatch.from_pydict({"prefix": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

        big = parts.select("key").mapInArrow(count, "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > capacity)
        found = {bytes(r["prefix"]) for r in collect_bounded(big.select("prefix"), step * (total // capacity), "oversized prefixes")}
        splits |= found
        depth += step
        level = {p for p in found if len(p) == depth}
    return splits


def local_parts(keys: list[bytes], rows: list[int], depth: int, most: int) -> Iterator[list[int]]:
    """Places of keys that agree in their first ``depth`` bytes, split by further bytes until no part has more than ``most``."""
    stack = [(rows, depth)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= most:
            yield rows
            continue
        by: dict[bytes, list[int]] = {}
        for i in rows:
            by.setdefault(keys[i][depth : depth + 1], []).append(i)
        ended = by.pop(b"", None)  # equal keys: they cannot be split, and are one terminal
        if ended:
            yield ended
        stack.extend((part, depth + 1) for part in by.values())


def groups(records: DataFrame, bucket: int = BUCKET, task: int = TASK, prefixes: int = PREFIXES) -> DataFrame:
    """(key, copies, first_id): one row per distinct record."""
    parts = cut(partials(records))
    total = parts.count()
    waves = max(1, -(-total // (prefixes * task)))
    out = None
    for w in range(waves):
        wave = parts if waves == 1 else parts.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == w)
        got = _wave(wave, total if waves == 1 else wave.count(), bucket, task)
        out = got if out is None else out.unionByName(cut(got))
    return out


def _wave(parts: DataFrame, total: int, bucket: int, task: int) -> DataFrame:
    sc = parts.sparkSession.sparkContext
    capacity = min(task, max(bucket, total // (2 * sc.defaultParallelism)))  # smaller buckets than a task may hold, if that keeps all cores busy
    shared = sc.broadcast(radix_splits(parts, total, capacity))

    def place(batches):
        splits = shared.value
        for b in batches:
            where = pa.array([bucket_of(k, splits) for k in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([where, *b.columns], names=["bucket", *PARTIAL.names])

    def count(t: pa.Table) -> pa.Table:
        keys, copies, firsts = (t.column(c).to_pylist() for c in PARTIAL.names)
        out = []
        for rows in local_parts(keys, list(range(len(keys))), len(t.column("bucket")[0].as_py()), bucket):
            trie = Trie()
            for i in rows:
                trie.add(keys[i], copies[i], firsts[i])
            out.append(_table(list(trie.items())))
        return pa.Table.from_batches(out, schema=PARTIAL)

    return parts.mapInArrow(place, f"bucket binary, {PARTIAL_SQL}").groupBy("bucket").applyInArrow(count, PARTIAL_SQL)


def collapse(records: DataFrame) -> DataFrame:
    """One row per distinct record: first_id, copies and the five fields in canonical form."""
    cols = [F.split(F.col("key").cast("string"), "\x1f").getItem(i).alias(c) for i, c in enumerate(("map_name", "map_data_name", "width_tiles", "height_tiles", "tileset_key"))]
    return groups(records).select("first_id", "copies", *cols)


def found(records: DataFrame) -> DataFrame:
    """(first_id, record_id) of each record that is not the first of its group."""

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([short(canonical(r)) for r in b.column(1).to_pylist()], pa.binary())], names=["record_id", "key"])

    brief = F.when(F.length("key") > LONG, F.concat(F.lit(b"\xfe"), F.unhex(F.sha2("key", 256)))).otherwise(F.col("key"))
    multiple = cut(groups(records).where("copies > 1 and first_id is not null").select(brief.alias("key"), "copies", "first_id"))
    total = max(1, records.count())
    hot = multiple.where(F.col("copies") * HOT > total)  # fewer than HOT groups can hold more than 1/HOT of the rows
    rest = multiple.where(F.col("copies") * HOT <= total)
    keyed = widen(records.select("record_id", "raw").where("record_id is not null")).mapInArrow(keys, "record_id long, key binary")
    # One pass and one shuffle: rows of hot groups are answered by the broadcast and travel under keys of their own,
    # which meet nothing and spread evenly.
    marked = keyed.join(F.broadcast(hot.select("key", F.col("first_id").alias("hot_id"))), "key", "left").select(
        "record_id", "hot_id", F.when(F.col("hot_id").isNull(), F.col("key")).otherwise(F.concat(F.lit(b"\xff"), F.col("record_id").cast("string").cast("binary"))).alias("key")
    )
    return (
        marked.join(rest.select("key", "first_id"), "key", "left")
        .select(F.coalesce("hot_id", "first_id").alias("first_id"), "record_id").where("first_id <> record_id")
    )


def short(key: bytes) -> bytes:
    """The key, or what stands for a long one in joins; canonical bytes hold neither 0xfe nor 0xff."""
    return key if len(key) <= LONG else b"\xfe" + hashlib.sha256(key).digest()
