"""Scalar functions as Columns: angles and clocks, distances, keys and names. All stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright import constants as K

# ---- geometry -------------------------------------------------------------------------------------------------------


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def ray_angle(width_tiles, height_tiles, x, y) -> Column:
    """Degrees in [0, 360) of a pixel seen from the map's centre, y downwards."""
    a = F.degrees(F.atan2(y - height_tiles * 16.0, x - width_tiles * 16.0))
    return F.when(a < 0, a + 360.0).otherwise(a)


def sector_hour(angle) -> Column:
    """The hour of one of eight sectors of 45 degrees."""
    out = F.when((angle >= 337.5) | (angle < 22.5), 3)
    for lo, hour in ((22.5, 5), (67.5, 6), (112.5, 7), (157.5, 9), (202.5, 11), (247.5, 12)):
        out = out.when((angle >= lo) & (angle < lo + 45.0), hour)
    return out.otherwise(1)


def dial_value(angle) -> Column:
    """Continuous hour in (0, 12]."""
    h = angle / 30.0 + 3.0
    return F.when(h > 12.0, h - 12.0).otherwise(h)


def dial_norm(h) -> Column:
    return F.pmod(h, F.lit(12.0))


def dial_separation(a, b) -> Column:
    d = F.abs(dial_norm(a) - dial_norm(b))
    return F.least(d, 12.0 - d)


def nearest_hour(h) -> Column:
    """Nearest whole hour, the smaller one on ties: no search, the two neighbours decide."""
    n = dial_norm(h)
    lo = F.floor(n)
    up = F.pmod(lo + 1, F.lit(12)).cast("int")
    low = F.pmod(lo, F.lit(12)).cast("int")
    name = lambda c: F.when(c == 0, 12).otherwise(c)
    d = n - lo
    return F.when(d < 0.5, name(low)).when(d > 0.5, name(up)).otherwise(F.least(name(low), name(up)))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance to a segment; to the point where the segment has no length."""
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = F.when(l2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(l2, F.lit(0.0)))))
    return F.sqrt((px - ax - t * dx) * (px - ax - t * dx) + (py - ay - t * dy) * (py - ay - t * dy))


def round_away(x) -> Column:
    """Half away from zero, to int."""
    return F.round(x).cast("int")


def edges(vertices: Column) -> Column:
    """(x0, y0, x1, y1) of each side of a closed polygon; null vertices are left out first."""
    v = F.filter(vertices, lambda p: p.isNotNull())
    return F.transform(
        v,
        lambda p, i: F.struct(
            p["x"].cast("double").alias("x0"), p["y"].cast("double").alias("y0"),
            F.element_at(v, (F.pmod(i + 1, F.size(v)) + 1).cast("int"))["x"].cast("double").alias("x1"),
            F.element_at(v, (F.pmod(i + 1, F.size(v)) + 1).cast("int"))["y"].cast("double").alias("y1"),
        ),
    )


def point_in_polygon(px, py, vertices: Column) -> Column:
    """Even-odd rule; null or empty polygons hold no point."""
    crossing = lambda e: ((e["y0"] > py) != (e["y1"] > py)) & (
        px < (e["x1"] - e["x0"]) * (py - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) + e["x0"]
    )
    hits = F.size(F.filter(edges(vertices), lambda e: F.coalesce(crossing(e), F.lit(False))))
    return F.coalesce((F.pmod(hits, F.lit(2)) == 1) & vertices.isNotNull(), F.lit(False))


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + f(e))


def polygon_center(vertices: Column) -> Column:
    """struct(x, y): area centroid; the mean of fewer than three vertices, the box's middle where the area is zero, null of none."""
    v = F.filter(vertices, lambda p: p.isNotNull())
    e = edges(vertices)
    cross = lambda s: s["x0"] * s["y1"] - s["x1"] * s["y0"]
    area = _sum(e, cross) * 0.5
    xs, ys = F.transform(v, lambda p: p["x"].cast("double")), F.transform(v, lambda p: p["y"].cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    middle = lambda a: (F.array_min(a) + F.array_max(a)) / 2
    moment = lambda c: _sum(e, lambda s: (s[f"{c}0"] + s[f"{c}1"]) * cross(s)) / F.nullif(6 * area, F.lit(0.0))
    pick = lambda c, a: F.when(F.size(v) == 0, None).when(F.size(v) < 3, mean(a)).when(area == 0, middle(a)).otherwise(moment(c))
    return F.when(vertices.isNotNull(), F.struct(pick("x", xs).alias("x"), pick("y", ys).alias("y")))


def downsample_factor(w, h, most) -> Column:
    """Smallest power of two at which the longer side, divided without remainder, fits."""
    longest = F.greatest(w, h).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(20)), F.lit(1), lambda f, _: F.when(F.floor(longest / f) > most, f * 2).otherwise(f))


# ---- strings --------------------------------------------------------------------------------------------------------


def lower_each(s) -> Column:
    """Lower case letter by letter, with no rule that looks at neighbours."""
    return F.lower(F.translate(s, "Σİ", "σi"))


def map_key(s) -> Column:
    """Cache key: controls go, letters and digits stay in lower case, blanks and ``_ . - /`` become one dash."""
    bare = F.regexp_replace(s, r"[\x00-\x1f]", "")
    only = F.regexp_replace(bare, r"[^\p{L}\p{N}\s\p{Z}\x{85}_./-]", "")
    return F.trim(F.regexp_replace(lower_each(only), r"[\s\p{Z}\x{85}_./-]+", "-"), F.lit("-"))


def ascii_slug(s) -> Column:
    return F.trim(F.regexp_replace(lower_each(F.trim(s)), "[^a-z0-9]+", "-"), F.lit("-"))


def unicode_slug(s) -> Column:
    out = F.trim(F.regexp_replace(lower_each(F.trim(s)), r"[^\p{L}\p{Nd}]+", "-"), F.lit("-"))
    return F.when(out == "", "unknown").otherwise(out)


def tileset_key(tileset, name, missing) -> Column:
    n = F.coalesce(F.nullif(F.trim(lower_each(name)), F.lit("")), F.lit("unknown"))
    n = F.when(F.coalesce(missing, F.lit(False)), F.concat(n, F.lit("-missing-era"))).otherwise(n)
    return F.concat(F.lpad(tileset.cast("string"), 2, "0"), F.lit("-"), unicode_slug(n))


def tileset_folder(key) -> Column:
    """Asset folder of a tileset key; null where there is none."""
    k = F.trim(F.lower(key))
    slug = F.regexp_replace(F.regexp_replace(k, "^[0-9][0-9]-", ""), "-missing-era$", "")
    table = F.create_map(*(F.lit(x) for kv in K.TILESET_FOLDERS.items() for x in kv))
    return F.when(k.isin(*K.DIRECT_FOLDERS), k).otherwise(F.element_at(table, slug))


def similarity(a, b) -> Column:
    """Similarity of two keys: 1 less the edits as a share of the longer."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def natural_label(hours: Column) -> Column:
    h = F.transform(F.array_sort(F.array_distinct(F.filter(hours, lambda x: x.isNotNull()))), lambda x: x.cast("string"))
    n = F.size(h)
    many = F.concat(F.array_join(F.slice(h, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" & "), F.element_at(h, -1))
    return F.when(n <= 0, "natural").when(n == 1, F.concat(F.lit("natural of "), F.element_at(h, 1))).otherwise(F.concat(F.lit("natural of "), many))


def unit_key(s) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def clean_title(s) -> Column:
    return F.trim(F.regexp_replace(s, r"\p{Cc}", ""))


def md_cell(s) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def team_rgb(packed) -> Column:
    """struct(r, g, b) of a packed colour; opaque black for null."""
    c = F.coalesce(packed, F.lit(0))
    return F.struct(*(F.shiftright(c, n).bitwiseAND(255).alias(k) for k, n in (("r", 16), ("g", 8), ("b", 0))))


def blend(src, alpha, dst) -> Column:
    """Source over destination, truncated."""
    a = alpha / 255.0
    return (src * a + dst * (1.0 - a)).cast("int")


def tint(diffuse, mask, team) -> Column:
    """Team colour under a mask, in whole numbers."""
    return F.floor((diffuse * (255 - mask) + F.least(F.lit(255), F.floor(2 * diffuse * team / 255).cast("int")) * mask) / 255).cast("int")


# ---- nibbles --------------------------------------------------------------------------------------------------------


def feature(feat) -> Column:
    return feat.cast("int").bitwiseAND(15)


def is_passable(feat) -> Column:
    return feature(feat).bitwiseAND(K.WALK | K.RAMP) != 0


def is_ramp(feat) -> Column:
    return feature(feat).bitwiseAND(K.RAMP) != 0
