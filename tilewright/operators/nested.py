"""Nested results to flat tables that keep the way back to the parent (problem 3).

Arrow-buffer flattening: each level of lists is emitted by its offsets. ``parents`` turns offsets into the index of the
parent of each child, ``places`` into the child's place in its list; keys reach a child by one vectorised take per level.
No row is ever parsed in Python.

Defined results: null lists and empty lists give no node; null elements keep their place but give no node, nor do their
children; a result stored several times, row for row, gives its nodes once; rows without a result_id are told apart by
their content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import collect_at_most

LISTS = ("starting_locations", "expansions")
KEYS = [("result_id", pa.int64()), ("node_kind", pa.string()), ("base_list", pa.string()), ("base_pos", pa.int32()), ("item_pos", pa.int32()), ("end_pos", pa.int32())]
#: Columns that each kind of node brings along, with their path in the node's struct.
PAYLOAD = {
    "base": {"name": "string", "kind": "string", "clock": "int", "center_tile.x": "int", "center_tile.y": "int", "mineral_only": "boolean", "natural_expansion": "string"},
    "vertex": {"x": "int", "y": "int"},
    "choke": {"center.x": "int", "center.y": "int", "width": "int", "connects_to": "string"},
    "end": {"x": "int", "y": "int"},
}
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
REPEATED = 100_000  # ids of results stored several times that may be broadcast
SLICE = 2_000  # results flattened at a time; a result has some hundred nodes


def _list(a):
    """(values, lengths, offsets) of a list array, null lists having length 0; values start at the first offset."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(a), lengths


def parents(lengths: np.ndarray) -> np.ndarray:
    """Index of the parent of each child."""
    return np.repeat(np.arange(len(lengths)), lengths)


def places(lengths: np.ndarray) -> np.ndarray:
    """Place of each child in its list."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, dtype=np.int64)
    return np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def child(values, lengths):
    """Non-null children of one level: (children, index of the parent of each, place of each)."""
    up, at = parents(lengths), places(lengths)
    ok = np.flatnonzero(pc.is_valid(values).to_numpy(zero_copy_only=False))
    return values.take(pa.array(ok)), up[ok], at[ok]


def _field(nodes, path: str):
    for name in path.split("."):
        nodes = pc.struct_field(nodes, name)
    return nodes


def nodes(batch, kinds: tuple[str, ...], payload: bool):
    """Yield one record batch per kind and list of a batch (result_id, starting_locations, expansions)."""
    rid = batch.column(0)
    minus = lambda n: np.full(n, -1, dtype=np.int32)

    def emit(kind, source, ids, base_pos, item_pos, end_pos, found):
        n = len(found)
        cols = [
            ids, pa.array([kind] * n, pa.string()), pa.array([source] * n, pa.string()),
            *(pa.array(x.astype(np.int32)) for x in (base_pos, item_pos, end_pos)),
        ]
        if payload:
            cols += [_field(found, path).cast(ARROW[t]) for path, t in PAYLOAD[kind].items()]
        names = [k for k, _ in KEYS] + ([p.replace(".", "_") for p in PAYLOAD[kind]] if payload else [])
        return pa.RecordBatch.from_arrays(cols, names=names)

    for k, source in enumerate(LISTS):
        bases, up, base_pos = child(*_list(batch.column(1 + k)))
        ids = rid.take(pa.array(up))
        if "base" in kinds:
            yield emit("base", source, ids, base_pos, minus(len(bases)), minus(len(bases)), bases)
        if "vertex" in kinds:
            v, up, at = child(*_list(pc.struct_field(bases, "polygon_vertices")))
            yield emit("vertex", source, ids.take(pa.array(up)), base_pos[up], at, minus(len(v)), v)
        if "choke" in kinds or "end" in kinds:
            c, up, at = child(*_list(pc.struct_field(bases, "chokes")))
            cids, cbase = ids.take(pa.array(up)), base_pos[up]
            if "choke" in kinds:
                yield emit("choke", source, cids, cbase, at, minus(len(c)), c)
            if "end" in kinds:
                e, up, end_at = child(*_list(pc.struct_field(c, "ends")))
                yield emit("end", source, cids.take(pa.array(up)), cbase[up], at[up], end_at, e)


def once(results: DataFrame) -> DataFrame:
    """Each stored result once. The copy kept is found on the map side too, so copies of one row do not pile up."""
    narrow = results.select("result_id", *LISTS)
    same = F.when(F.col("result_id").isNull(), F.xxhash64(F.to_json(F.struct(*LISTS))))
    return narrow.withColumn("same", same).dropDuplicates(["result_id", "same"]).drop("same")


def once_by_ids(results: DataFrame, most: int = REPEATED) -> DataFrame:
    """As ``once`` without shuffling the wide rows: only ids are counted, and only rows of repeated ids are brought together.

    Beyond ``most`` repeated ids, which are broadcast, everything goes through ``once``.
    """
    repeated = results.where("result_id is not null").groupBy("result_id").count().where("count > 1").select("result_id")
    rows = collect_at_most(repeated, most)
    if rows is None:
        return once(results)
    narrow = results.select("result_id", *LISTS)
    if not rows:
        return narrow.where("result_id is not null").unionByName(once(narrow.where("result_id is null")))
    ids = F.broadcast(results.sparkSession.createDataFrame(rows, repeated.schema))
    single = narrow.where("result_id is not null").join(ids, "result_id", "left_anti")
    several = narrow.join(ids, "result_id", "left_semi")
    return single.unionByName(once(several.unionByName(narrow.where("result_id is null"))))


def flatten(results: DataFrame, kinds: tuple[str, ...] = ("base", "vertex", "choke", "end"), payload: bool = False) -> DataFrame:
    """The nodes of all results; with ``payload`` (one kind only) the node's own columns too."""
    if payload and len(kinds) != 1:
        raise ValueError("a table with payload has one kind of node")
    schema = "result_id long, node_kind string, base_list string, base_pos int, item_pos int, end_pos int"
    if payload:
        schema += "".join(f", {p.replace('.', '_')} {t}" for p, t in PAYLOAD[kinds[0]].items())

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                yield from nodes(b.slice(lo, SLICE), kinds, payload)

    return once_by_ids(results).mapInArrow(run, schema)


def tables(results: DataFrame) -> dict[str, DataFrame]:
    """bases, vertices, chokes and ends, each with its own columns and the keys of its parents."""
    return {name: flatten(results, (kind,), payload=True) for name, kind in (("bases", "base"), ("vertices", "vertex"), ("chokes", "choke"), ("ends", "end"))}


def found(results: DataFrame) -> DataFrame:
    return flatten(results)
