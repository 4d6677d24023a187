"""Fixtures of the scalar operators: clocks, keys, names, geometry."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.functions import scalar as S
from tilewright.operators import analysis, cluster, outline


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("angle,hour", [(0, 3), (22.5, 5), (45, 5), (90, 6), (180, 9), (247.5, 12), (292.5, 1), (337.5, 3)])
def test_sectors(spark, angle, hour):
    assert one(spark, S.sector_hour(F.lit(float(angle)))) == hour
    x, y = 2048 + round(4000 * math.cos(math.radians(angle + 0.01))), 2048 + round(4000 * math.sin(math.radians(angle + 0.01)))
    assert cluster.sector(128, 128, x, y) == hour


@pytest.mark.parametrize("dial,hour", [(3.75, 4), (3.0, 3), (3.5, 3), (12.5, 1), (0.5, 1), (11.5, 11), (12.0, 12)])
def test_nearest_hour(spark, dial, hour):
    assert one(spark, S.nearest_hour(F.lit(dial))) == hour


@pytest.mark.parametrize("name,key", [
    ("\x07D\x06o\x07m\x06i\x07n\x06a\x07t\x06o\x07r \x03SE \x052.", "dominator-se-2"), ("투혼 1.3", "투혼-1-3"), ("ΣΑΣ", "σασ"), ("a b", "a-b"), ("a\tb", "ab"), ("--", ""), ("", ""),
])
def test_map_key(spark, name, key):
    assert one(spark, S.map_key(F.lit(name))) == key


def test_slugs(spark):
    assert one(spark, S.ascii_slug(F.lit("투혼 1.3"))) == "1-3"
    assert one(spark, S.unicode_slug(F.lit(" Space Platform "))) == "space-platform"
    assert one(spark, S.unicode_slug(F.lit("--"))) == "unknown"


@pytest.mark.parametrize("key,folder", [
    ("00-badlands", "badlands"), ("01-space-platform", "platform"), ("02-install", "install"), ("03-ashworld", "ashworld"), ("04-jungle", "jungle"), ("05-desert", "desert"),
    ("06-arctic", "ice"), ("07-twilight", "twilight"), ("badlands", "badlands"), ("platform", "platform"), ("00-badlands-missing-era", "badlands"), ("99-not-a-real-tileset-slug", None),
])
def test_folders(spark, key, folder):
    assert one(spark, S.tileset_folder(F.lit(key))) == folder
    if folder:
        assert analysis.folder_of(key) == folder
    else:
        with pytest.raises(ValueError):
            analysis.folder_of(key)


def test_similarity(spark):
    a, b = S.map_key(F.lit("Dominator SE 5.2")), S.map_key(F.lit("\x07D\x06ominator \x03SE \x052."))
    assert one(spark, S.similarity(a, b)) >= 0.5
    assert one(spark, S.similarity(F.lit("é"), F.lit("e"))) == 0.0
    assert one(spark, S.similarity(F.lit(""), F.lit(""))) == 0.0


@pytest.mark.parametrize("hours,label", [([9], "natural of 9"), ([3, 6], "natural of 3 & 6"), ([9, 3, 6, 3], "natural of 3, 6 & 9"), ([], "natural")])
def test_natural_label(spark, hours, label):
    assert one(spark, S.natural_label(F.array(*map(F.lit, hours)).cast("array<int>"))) == label
    assert analysis.natural_label(hours) == label


@pytest.mark.parametrize("w,h,most,factor", [(4096, 4096, 2560, 2), (4096, 3072, 2560, 2), (8192, 8192, 2560, 4), (2048, 2048, 2560, 1), (4096, 4096, 4096, 1), (4096, 4096, 1000, 8)])
def test_downsample_factor(spark, w, h, most, factor):
    assert one(spark, S.downsample_factor(F.lit(w), F.lit(h), F.lit(most))) == factor


def test_polygons(spark):
    sq = "array(named_struct('x',0,'y',0), named_struct('x',4,'y',0), named_struct('x',4,'y',4), named_struct('x',0,'y',4))"
    v = F.expr(sq)
    assert one(spark, S.point_in_polygon(F.lit(1.5), F.lit(1.5), v)) is True
    assert one(spark, S.point_in_polygon(F.lit(5.5), F.lit(1.5), v)) is False
    assert one(spark, S.point_in_polygon(F.lit(1.5), F.lit(1.5), F.expr("cast(null as array<struct<x:int,y:int>>)"))) is False
    assert tuple(one(spark, S.polygon_center(v))) == (2.0, 2.0)
    assert tuple(one(spark, S.polygon_center(F.expr("array(named_struct('x',0,'y',0), named_struct('x',4,'y',2))")))) == (2.0, 1.0)
    assert one(spark, S.polygon_center(F.expr("cast(array() as array<struct<x:int,y:int>>)")))["x"] is None
    assert outline.iou([(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 0), (6, 0), (6, 4), (2, 4)]) == pytest.approx(1 / 3)


def test_small_strings(spark):
    assert one(spark, S.unit_key(F.lit("  Terran \t Marine "))) == "terran marine"
    assert one(spark, S.clean_title(F.lit("\x07A\x06b\n"))) == "Ab"
    assert one(spark, S.md_cell(F.lit("a|b"))) == "a\\|b"
    assert tuple(one(spark, S.team_rgb(F.lit(0x102030)))) == (16, 32, 48)
    assert tuple(one(spark, S.team_rgb(F.lit(None).cast("int")))) == (0, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 12, allow_nan=False))
def test_dial_rule(h):
    # the rule of two neighbours agrees with a search over all hours
    best = min(range(1, 13), key=lambda k: (round(min((h - k) % 12, (k - h) % 12), 9), k))
    n = h % 12.0
    lo = math.floor(n)
    name = lambda c: c % 12 or 12
    d = n - lo
    got = name(lo) if d < 0.5 else name(lo + 1) if d > 0.5 else min(name(lo), name(lo + 1))
    assert got == best or abs(d - 0.5) < 1e-8
