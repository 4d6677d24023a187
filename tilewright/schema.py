"""Explicit schemas of the entities; unsigned source types are widened."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
START = T.StructType([*POINT.fields, T.StructField("slot_id", T.ShortType())])
METADATA = T.StructType([
    T.StructField("replay_path", T.StringType()), T.StructField("map_name", T.StringType()), T.StructField("map_data_name", T.StringType()),
    T.StructField("width_tiles", T.IntegerType()), T.StructField("height_tiles", T.IntegerType()), T.StructField("tileset", T.IntegerType()),
    T.StructField("tileset_name", T.StringType()), T.StructField("tileset_key", T.StringType()), T.StructField("tile_set_missing", T.BooleanType()),
    T.StructField("tiles", T.ArrayType(T.IntegerType())), T.StructField("mineral_fields", T.ArrayType(POINT)), T.StructField("geysers", T.ArrayType(POINT)),
    T.StructField("start_locations", T.ArrayType(START)),
])
CHOKE = T.StructType([
    T.StructField("center", POINT), T.StructField("ends", T.ArrayType(POINT)), T.StructField("width", T.IntegerType()), T.StructField("connects_to", T.StringType()),
])
BASE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("clock", T.IntegerType()), T.StructField("center_tile", POINT),
    T.StructField("polygon_vertices", T.ArrayType(POINT)), T.StructField("mineral_only", T.BooleanType()), T.StructField("natural_expansion", T.StringType()),
    T.StructField("chokes", T.ArrayType(CHOKE)),
])
RESULT = T.StructType([
    T.StructField("map_name", T.StringType()), T.StructField("tileset_key", T.StringType()),
    T.StructField("starting_locations", T.ArrayType(BASE)), T.StructField("expansions", T.ArrayType(BASE)),
])
BASE_ROW = T.StructType([
    T.StructField("base_id", T.IntegerType()), T.StructField("center_x", T.DoubleType()), T.StructField("center_y", T.DoubleType()),
    T.StructField("natural_radius", T.DoubleType()), T.StructField("geo_radius", T.DoubleType()), T.StructField("start_count", T.IntegerType()),
    T.StructField("is_starting", T.BooleanType()), T.StructField("display_name", T.StringType()), T.StructField("mineral_only", T.BooleanType()),
])
