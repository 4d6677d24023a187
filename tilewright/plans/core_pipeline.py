"""Queries of the core training-data operators (problems 3 and 4), with their SQL."""

from __future__ import annotations

from tilewright.operators import nested, treeagg
from tilewright.session import table


def p3_found(spark, d):
    return nested.found(table(spark, d, "map_results"))


def p3_bases(spark, d):
    return nested.flatten(table(spark, d, "map_results"), ("base",), payload=True)


def p3_vertices(spark, d):
    return nested.flatten(table(spark, d, "map_results"), ("vertex",), payload=True)


def p3_chokes(spark, d):
    return nested.flatten(table(spark, d, "map_results"), ("choke",), payload=True)


def p3_ends(spark, d):
    return nested.flatten(table(spark, d, "map_results"), ("end",), payload=True)


def p4_name_usage(spark, d):
    return treeagg.name_usage(table(spark, d, "map_metadata"))


QUERIES = {f.__name__: f for f in (p3_found, p3_bases, p3_vertices, p3_chokes, p3_ends, p4_name_usage)}

_BASES = """WITH r AS (SELECT result_id, any_value(starting_locations) AS s, any_value(expansions) AS e FROM map_results GROUP BY result_id),
l AS (SELECT result_id, 'starting_locations' AS base_list, s AS bases FROM r UNION ALL SELECT result_id, 'expansions', e FROM r),
b AS (SELECT result_id, base_list, unnest(bases) AS b, generate_subscripts(bases, 1) - 1 AS base_pos FROM l WHERE len(bases) > 0),
v AS (SELECT result_id, base_list, base_pos, unnest(b.polygon_vertices) AS v, generate_subscripts(b.polygon_vertices, 1) - 1 AS item_pos FROM b WHERE len(b.polygon_vertices) > 0),
c AS (SELECT result_id, base_list, base_pos, unnest(b.chokes) AS c, generate_subscripts(b.chokes, 1) - 1 AS item_pos FROM b WHERE len(b.chokes) > 0),
e AS (SELECT result_id, base_list, base_pos, item_pos, unnest(c.ends) AS e, generate_subscripts(c.ends, 1) - 1 AS end_pos FROM c WHERE len(c.ends) > 0)
"""
_KEY = "result_id, '{0}' AS node_kind, base_list, base_pos::INT AS base_pos, {1} AS item_pos, {2} AS end_pos"
_SELECT = {
    "base": (_KEY.format("base", "-1::INT", "-1::INT"), "b.name AS name, b.kind AS kind, b.clock AS clock, b.center_tile.x AS center_tile_x, b.center_tile.y AS center_tile_y, b.mineral_only AS mineral_only, b.natural_expansion AS natural_expansion", "b", "b"),
    "vertex": (_KEY.format("vertex", "item_pos::INT", "-1::INT"), "v.x AS x, v.y AS y", "v", "v"),
    "choke": (_KEY.format("choke", "item_pos::INT", "-1::INT"), "c.center.x AS center_x, c.center.y AS center_y, c.width AS width, c.connects_to AS connects_to", "c", "c"),
    "end": (_KEY.format("end", "item_pos::INT", "end_pos::INT"), "e.x AS x, e.y AS y", "e", "e"),
}
ORACLE = {
    "p3_found": _BASES + " UNION ALL ".join(f"SELECT {k} FROM {t} WHERE {n} IS NOT NULL" for k, _, t, n in _SELECT.values()),
    "p4_name_usage": """SELECT map_name, count(DISTINCT replay_id) AS uploads, min(recorded_at) AS first_recorded, max(recorded_at) AS last_recorded,
        count(DISTINCT map_data_name) AS data_names FROM map_metadata GROUP BY map_name""",
}
for _name, _kind in (("p3_bases", "base"), ("p3_vertices", "vertex"), ("p3_chokes", "choke"), ("p3_ends", "end")):
    _k, _p, _t, _n = _SELECT[_kind]
    ORACLE[_name] = _BASES + f"SELECT {_k}, {_p} FROM {_t} WHERE {_n} IS NOT NULL"
