"""Queries of the language-model training-data operators (problems 1, 2 and 5 to 9)."""

from __future__ import annotations

from tilewright.llm import canonical_map, encoding_repair, formatting_dups, langid, lookalikes, packing, prefix_bpe
from tilewright.session import table


def p1_found(spark, d):
    return encoding_repair.found(table(spark, d, "map_metadata"))


def p1_repaired(spark, d):
    """Every garbled field with its original text as far as it survives."""
    r = encoding_repair.repair(table(spark, d, "map_metadata"))
    return r.where(r["chain"] != encoding_repair.IDENTITY).dropDuplicates(["replay_id", "field_name"])


def p2_found(spark, d):
    return lookalikes.found(table(spark, d, "map_metadata"), table(spark, d, "map_results"))


def p2_names(spark, d):
    """Every name with its one consistent form."""
    out = lookalikes.normalise(table(spark, d, "map_metadata"), table(spark, d, "map_results"))
    return out.dropDuplicates(["src_table", "row_id"])


def p5_found(spark, d):
    return canonical_map.found(table(spark, d, "map_metadata"), table(spark, d, "map_results"), table(spark, d, "map_catalog"))


def p5_unmatched(spark, d):
    """Names that mean no entry, and why."""
    out = canonical_map.resolve(table(spark, d, "map_metadata"), table(spark, d, "map_results"), table(spark, d, "map_catalog"))
    return out.where("catalog_id = 0")


def p6_found(spark, d):
    return formatting_dups.found(table(spark, d, "map_records"))


def p6_records(spark, d):
    return formatting_dups.collapse(table(spark, d, "map_records"))


def p7_ids(spark, d):
    return prefix_bpe.encode(table(spark, d, "documents"))


def p8_bins(spark, d):
    return packing.fill(prefix_bpe.sizes(table(spark, d, "documents")), table(spark, d, "pack_profiles"))


def p9_found(spark, d):
    return langid.found(table(spark, d, "documents"))


def p9_languages(spark, d):
    """The language and confidence of every text (line_no -1) and of every line."""
    return langid.classify(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_repaired, p2_found, p2_names, p5_found, p5_unmatched, p6_found, p6_records, p7_ids, p8_bins, p9_found, p9_languages)
}
# SQL exists where the answer needs no model: grouping of records by their letters and digits.
_P6 = r"""WITH j AS (SELECT record_id, raw, CASE WHEN ltrim(raw, e' \t\r\n') LIKE '{%' THEN 'json' WHEN contains(raw, '=') THEN 'eq' ELSE 'colon' END AS shape FROM map_records),
pairs AS (
  SELECT record_id, unnest(json_keys(raw)) AS k, unnest(list_transform(json_keys(raw), lambda x: json_extract_string(raw, '$."' || x || '"'))) AS v FROM j WHERE shape = 'json'
  UNION ALL SELECT record_id, regexp_extract(p, '^([^=]*)=', 1), regexp_replace(p, '^[^=]*=', '') FROM (SELECT record_id, unnest(string_split(raw, ';')) AS p FROM j WHERE shape = 'eq')
  UNION ALL SELECT record_id, regexp_extract(p, '^([^:]*):', 1), regexp_replace(p, '^[^:]*:', '') FROM (SELECT record_id, unnest(regexp_split_to_array(raw, '[|\n\r]')) AS p FROM j WHERE shape = 'colon')),
flat AS (SELECT record_id, regexp_replace(lower(k), '[^a-z]', '', 'g') AS k, lower(regexp_replace(upper(coalesce(v, '')), '[^\p{L}\p{N}]', '', 'g')) AS v FROM pairs),
keyed AS (SELECT record_id, coalesce(max(v) FILTER (k = 'mapname'), '') AS a, coalesce(max(v) FILTER (k = 'mapdataname'), '') AS b, coalesce(max(v) FILTER (k = 'widthtiles'), '') AS c,
  coalesce(max(v) FILTER (k = 'heighttiles'), '') AS d, coalesce(max(v) FILTER (k = 'tilesetkey'), '') AS e FROM flat GROUP BY record_id),
"""
ORACLE = {
    "p6_found": _P6 + "g AS (SELECT *, min(record_id) OVER (PARTITION BY a, b, c, d, e) AS first_id FROM keyed) SELECT first_id, record_id FROM g WHERE first_id <> record_id",
    "p6_records": _P6 + "g AS (SELECT min(record_id) AS first_id, count(*) AS copies, a AS map_name, b AS map_data_name, c AS width_tiles, d AS height_tiles, e AS tileset_key FROM keyed GROUP BY a, b, c, d, e) SELECT * FROM g",
}
