"""Image measurements over pixel tables.

Two forms: a pixel table (fid, gx, gy, lum, ...), of any size, for whole-frame scans by windows and aggregates, and a raster row
(fid, gw, gh, lum array in row order; a coarse copy of at most 1024 x 1024 cells). Points are sampled from the tiles of either
form (`firmament.operators.tiles`); what needs one row a frame (comets) works inside that frame's own raster row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.functions import geo, kinds
from firmament.operators.tiles import Pictures, background_levels, window_medians
from firmament.session import cut_lineage

MAX_CELLS = 1024 * 1024


def downsample_pixels(pixels: DataFrame, f: int) -> DataFrame:
    """Box means by a factor; intensity is the largest of the colour means. Partial edge boxes drop."""
    size = pixels.groupBy("fid").agg((F.max("gx") + 1).alias("_w"), (F.max("gy") + 1).alias("_h"))
    boxed = pixels.join(size, "fid").where((F.col("gx") < F.floor(F.col("_w") / f) * f) & (F.col("gy") < F.floor(F.col("_h") / f) * f))
    means = boxed.groupBy("fid", F.floor(F.col("gx") / f).alias("gx"), F.floor(F.col("gy") / f).alias("gy")).agg(
        *[F.avg(c).alias(c) for c in ("r", "g", "b")])
    return means.withColumn("lum", F.greatest("r", "g", "b"))


def to_raster(pixels: DataFrame, channels: tuple[str, ...] = ("lum",)) -> DataFrame:
    """One row per frame; fails on a frame too large to be a raster rather than cutting it."""
    agg = pixels.groupBy("fid").agg(
        (F.max("gx") + 1).cast("int").alias("gw"), (F.max("gy") + 1).cast("int").alias("gh"),
        F.array_sort(F.collect_list(F.struct("gy", "gx", *channels))).alias("_p"))
    whole = F.when(F.col("gw") * F.col("gh") == F.size("_p"), F.col("_p")).otherwise(
        F.raise_error(F.lit("raster has missing or repeated cells")))
    agg = agg.withColumn("_p", F.when(F.size("_p") > MAX_CELLS, F.raise_error(F.lit("frame too large: downsample first"))).otherwise(whole))
    return agg.select("fid", "gw", "gh", *[_channel(c) for c in channels])


def _channel(name: str) -> Column:
    return F.transform("_p", lambda p: p[name]).alias(name)


def upper_median(values: Column) -> Column:
    """Element floor(n/2) of the sorted non-NULL values."""
    v = F.array_sort(F.array_compact(values))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def cell(r: dict[str, Column], gx: Column, gy: Column, channel: str = "lum") -> Column:
    """A raster cell with coordinates clamped to the grid."""
    x = F.greatest(F.lit(0), F.least(r["gw"] - 1, gx.cast("int")))
    y = F.greatest(F.lit(0), F.least(r["gh"] - 1, gy.cast("int")))
    return F.get(r[channel], y * r["gw"] + x)


def sample(r: dict[str, Column], x: Column, y: Column) -> Column:
    """Brightness at a full-image pixel; NULL off the frame. Needs gw, gh, lum, width, height."""
    inside = (x >= 0) & (y >= 0) & (x < r["width"]) & (y < r["height"])
    return F.when(inside, cell(r, F.floor(x / r["width"] * r["gw"]), F.floor(y / r["height"] * r["gh"])))


def raster_of() -> dict[str, Column]:
    return {c: F.col(c) for c in ("gw", "gh", "lum", "width", "height")}


def background_level(r: dict[str, Column], n: int = 24) -> Column:
    """Upper median over a coarse grid of interior samples."""
    idx = F.sequence(F.lit(1), F.lit(n - 1))
    w, h = r["width"], r["height"]
    return upper_median(F.flatten(F.transform(idx, lambda i: F.transform(idx, lambda j: sample(r, i / float(n) * w, j / float(n) * h)))))


def _sorted_upper(values: np.ndarray) -> np.ndarray:
    """Upper median of each row, NaN cells left out (NaN where a row has none)."""
    ordered = np.sort(values, axis=1)  # NaN sorts last
    n = np.count_nonzero(~np.isnan(ordered), axis=1)
    picked = ordered[np.arange(len(ordered)), np.minimum(n // 2, ordered.shape[1] - 1)]
    return np.where(n > 0, picked, np.nan)


def _nullable(values: np.ndarray) -> np.ndarray | list:
    """Unknown values as nulls; an array without any stays as it is, a quarter of a list's size."""
    return [None if v != v else float(v) for v in values] if np.isnan(values).any() else values


def _cell_medians(lum, gw, gh, xs, ys) -> np.ndarray | list:
    """3 x 3 cell medians at many grid cells of one raster, coordinates clamped."""
    gx = np.clip(np.asarray(xs, dtype=int)[:, None] + np.repeat([-1, 0, 1], 3)[None, :], 0, gw - 1)
    gy = np.clip(np.asarray(ys, dtype=int)[:, None] + np.tile([-1, 0, 1], 3)[None, :], 0, gh - 1)
    return _nullable(_sorted_upper(np.asarray(lum, dtype=float)[gy * gw + gx]))


def cell_medians(r: dict[str, Column], xs: Column, ys: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(lum: pd.Series, gw: pd.Series, gh: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_cell_medians(*row) if len(row[3]) else [] for row in zip(lum, gw, gh, x, y)])

    # Marked so that the optimizer computes it once, in place, and never copies it into a lambda or a filter.
    return run.asNondeterministic()(r["lum"], r["gw"], r["gh"], xs, ys)


def local_median(points: DataFrame, pictures: Pictures, key: list[str], x: str = "px", y: str = "py", win: str = "win", out: str = "m") -> DataFrame:
    """Adds `out`: the upper median of 7 x 7 samples spaced a third of the window; NULL where none is on the frame or the frame has no picture."""
    here = F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    return window_medians(points.withColumn("_pts", here), pictures, key, win=win).withColumn(out, F.get("_m", F.lit(0))).drop("_pts", "_m")


def vis_window(width: Column, height: Column, parts: float = 50.0) -> Column:
    return F.greatest(F.lit(8.0), geo.half_up(F.least(width, height) / parts))


def ray_points(x: Column, y: Column, max_r: Column, rays: int = 24, steps: int = 40) -> Column:
    """Array of struct(x, y, rad) along rays, ray by ray."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rays - 1)), lambda k: F.transform(
        F.sequence(F.lit(1), F.lit(steps)), lambda i: F.struct(
            (x + max_r * i / float(steps) * F.cos(k / float(rays) * (2 * math.pi))).alias("x"),
            (y + max_r * i / float(steps) * F.sin(k / float(rays) * (2 * math.pi))).alias("y"),
            (max_r * i / float(steps)).alias("rad")))))


def _fields(points: Column, name: str) -> Column:
    return F.transform(points, lambda p: p[name])


def glow_radius(points: Column, medians: Column, centre: Column, width: Column, height: Column, thr: Column) -> Column:
    """Glow reach from ray samples: 4-gap stop per ray, 12 rays needed, 70th percentile; else 0."""
    cells = F.zip_with(points, medians, lambda p, m: F.struct(
        p["rad"].alias("rad"), ((p["x"] < 0) | (p["y"] < 0) | (p["x"] >= width) | (p["y"] >= height)).alias("off"),
        F.coalesce(m > thr, F.lit(False)).alias("bright")))
    start = F.struct(F.lit(0.0).alias("edge"), F.lit(0).alias("gap"), F.lit(False).alias("stop"))

    def walk(acc: Column, c: Column) -> Column:
        gap = F.when(c["bright"], 0).otherwise(acc["gap"] + 1)
        return F.when(acc["stop"], acc).when(c["off"], F.struct(acc["edge"].alias("edge"), acc["gap"].alias("gap"), F.lit(True).alias("stop"))).otherwise(
            F.struct(F.when(c["bright"], c["rad"]).otherwise(acc["edge"]).alias("edge"), gap.alias("gap"), (gap >= 4).alias("stop")))

    edges = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.aggregate(F.slice(cells, k * 40 + 1, F.lit(40)), start, walk, lambda acc: acc["edge"]))
    lit = F.array_sort(F.filter(edges, lambda e: e > 0))
    found = F.transform(F.array(lit), lambda v: F.when(F.size(v) >= 12, F.get(v, F.floor(F.size(v) * 0.7).cast("int"))))
    return F.when(F.coalesce(centre > thr, F.lit(False)), F.coalesce(F.get(found, F.lit(0)), F.lit(0.0))).otherwise(0.0)


def visible_radius(centres: DataFrame, pictures: Pictures, key: list[str], x: str = "px", y: str = "py", max_r: str = "max_r", bg: str = "bg",
                   win: str = "win") -> DataFrame:
    """Adds `visible_r`: pixel radius of the glow around each point; 0 if none. Centres carry width and height, and their frame's bg."""
    here = F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("rad")))
    d = centres.withColumn("_pts", F.concat(here, ray_points(F.col(x), F.col(y), F.col(max_r))))
    d = window_medians(d, pictures, key, win=win)
    out = glow_radius(F.slice("_pts", 2, 960), F.slice("_m", 2, 960), F.get("_m", F.lit(0)), F.col("width"), F.col("height"), F.col(bg) * 1.15)
    return d.withColumn("visible_r", out).drop("_pts", "_m")


FRACS = (0.55, 0.65, 0.75, 0.85, 0.95, 1.0)


def rim_points(x: Column, y: Column, radius: Column) -> Column:
    """The 48 x 6 annulus points in search order."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: F.transform(
        F.array(*[F.lit(f) for f in FRACS]), lambda f, j: F.struct(
            (x + radius * f * F.cos(k / 48.0 * (2 * math.pi))).alias("x"), (y + radius * f * F.sin(k / 48.0 * (2 * math.pi))).alias("y"),
            (-(k * 6 + j)).alias("order")))))


def pick_rim(points: Column, medians: Column, width: Column, height: Column, win: Column, avoid: Column) -> Column:
    """struct(px, py, lum): the brightest point on the frame and clear of `avoid`, first in order on ties; or NULL."""
    spots = F.zip_with(points, medians, lambda p, m: F.struct(m.alias("lum"), p["order"].alias("order"), p["x"].alias("x"), p["y"].alias("y")))
    usable = F.filter(spots, lambda p: p["lum"].isNotNull() & (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] < width) & (p["y"] < height) & ~F.exists(
        avoid, lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]) < win * 1.6))
    best = F.transform(F.array(F.array_max(usable)), lambda b: F.when(b.isNotNull(), F.struct(
        geo.half_up(b["x"]).alias("px"), geo.half_up(b["y"]).alias("py"), b["lum"].alias("lum"))))
    return F.get(best, F.lit(0))


def brightest_rim(centres: DataFrame, pictures: Pictures, avoid: Column, key: list[str], x: str = "px", y: str = "py", radius: str = "radius",
                  win: str = "win") -> DataFrame:
    """Adds `rim`: the brightest annulus point of each centre. Centres carry width and height."""
    d = centres.withColumn("_pts", rim_points(F.col(x), F.col(y), F.col(radius)))
    d = window_medians(d, pictures, key, win=win)
    return d.withColumn("rim", pick_rim(F.col("_pts"), F.col("_m"), F.col("width"), F.col("height"), F.col(win), avoid)).drop("_pts", "_m")


def rim_toward_centre(x: Column, y: Column, radius: Column, width: Column, height: Column) -> Column:
    dx, dy = width / 2.0 - x, height / 2.0 - y
    m = F.hypot(dx, dy)
    return F.struct(geo.half_up(x + radius * F.when(m >= 1, dx / m).otherwise(0.0)).alias("px"),
                    geo.half_up(y + radius * F.when(m >= 1, dy / m).otherwise(-1.0)).alias("py"))


def rim_fronts(objects: DataFrame, pictures: Pictures, frames: DataFrame) -> DataFrame:
    """A bright rim per emission nebula of a frame: objects(fid, ord, id, category, px, py, size_major), frames(fid, scale_deg).

    Nebulae of a frame choose in order, each steering clear of every marker placed before: an ordered fold over the few objects a fact
    sheet lists. Pictures are sampled twice, for the glow and for the rim, and never joined to the nebulae.
    """
    neb = (F.col("category") == "emission_nebula") & F.col("size_major").isNotNull()
    n = objects.where(neb & F.col("px").isNotNull()).select("fid", F.col("ord").cast("long").alias("ord"), "id", "px", "py", "size_major")
    n = n.join(pictures.grids.select("fid", "width", "height"), "fid").join(background_levels(pictures), "fid").join(frames.select("fid", "scale_deg"), "fid")
    n = n.withColumn("win", vis_window(F.col("width"), F.col("height"), 35.0)).withColumn("max_r", geo.size_to_px(F.col("size_major"), F.col("scale_deg")))
    n = cut_lineage(visible_radius(n, pictures, ["ord", "id"]).where(F.col("visible_r") > F.col("win")))
    n = window_medians(n.withColumn("_pts", rim_points(F.col("px"), F.col("py"), F.col("visible_r"))), pictures, ["ord", "id"])
    per = n.groupBy("fid").agg(
        F.array_sort(F.collect_list(F.struct("ord", "id", "_pts", "_m"))).alias("_neb"),
        *[F.first(c).alias(c) for c in ("width", "height", "win", "bg")])
    taken = objects.where(F.col("px").isNotNull()).groupBy("fid").agg(F.collect_list(F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).alias("_taken"))
    d = per.join(taken, "fid")
    hit_t = "array<struct<ord:bigint,id:string,px:double,py:double,lum:double>>"
    taken_t = "array<struct<x:double,y:double>>"

    def place(acc: Column, nb: Column) -> Column:
        hit = pick_rim(nb["_pts"], nb["_m"], F.col("width"), F.col("height"), F.col("win"), acc["taken"])
        # A one-row list around the hit, so that it is computed once.
        good = F.filter(F.array(hit), lambda x: F.coalesce(x["lum"] > F.col("bg") * 1.25, F.lit(False)))
        return F.struct(
            F.concat(acc["taken"], F.transform(good, lambda x: F.struct(x["px"].alias("x"), x["py"].alias("y")))).cast(taken_t).alias("taken"),
            F.concat(acc["out"], F.transform(good, lambda x: F.struct(nb["ord"].alias("ord"), nb["id"].alias("id"), x["px"].alias("px"), x["py"].alias("py"), x["lum"].alias("lum")))).cast(hit_t).alias("out"),
        )

    zero = F.struct(F.col("_taken").cast(taken_t).alias("taken"), F.array().cast(hit_t).alias("out"))
    hits = F.aggregate("_neb", zero, place, lambda acc: acc["out"])
    d = d.select("fid", F.col("bg").alias("_bg"), F.posexplode(hits).alias("_i", "h"))
    contrast = F.when(F.col("_bg") != 0, F.least(F.lit(0.7), F.col("h.lum") / (F.col("_bg") * 2.0))).otherwise(0.5)
    return d.select("fid", F.concat(F.lit("bcv"), (F.col("_i") + 1).cast("string")).alias("id"), F.col("h.id").alias("parent_object_id"),
                    F.lit("ionization_front").alias("feature_type"), "h.px", "h.py", "h.lum",
                    F.greatest(F.lit(0.3), geo.half_up(contrast * 100.0) / 100.0).alias("confidence"), F.lit("cv").alias("detection_source"))


def _centroid(lum, gw, gh, w, h, x, y, radius, bg) -> tuple[float, float]:
    step = max(6.0, math.floor(radius / 40.0 + 0.5))
    xs = np.arange(max(0.0, x - radius), min(w - 1, x + radius) + 1e-9, step)
    ys = np.arange(max(0.0, y - radius), min(h - 1, y + radius) + 1e-9, step)
    gx, gy = np.meshgrid(xs, ys)
    at = np.minimum(gh - 1, np.floor(gy / h * gh)).astype(int) * gw + np.minimum(gw - 1, np.floor(gx / w * gw)).astype(int)
    wt = np.asarray(lum, dtype=float)[at] - bg
    wt = np.where(((gx - x) ** 2 + (gy - y) ** 2 <= radius * radius) & (wt > 0), wt, 0.0)
    total = wt.sum()
    return (float((gx * wt).sum() / total), float((gy * wt).sum() / total)) if total > 0 else (float(x), float(y))


def bright_centroid(r: dict[str, Column], x: Column, y: Column, radius: Column, bg: Column) -> Column:
    """struct(px, py): brightness-above-background centroid of the glow; the point itself if there is none."""
    @F.pandas_udf("px double, py double")
    def run(lum: pd.Series, gw: pd.Series, gh: pd.Series, w: pd.Series, h: pd.Series, cx: pd.Series, cy: pd.Series, rad: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_centroid(*row) for row in zip(lum, gw, gh, w, h, cx, cy, rad, b)], columns=["px", "py"])

    # Marked so that the optimizer computes it once, in place, and never copies it into a lambda or a filter.
    return run.asNondeterministic()(r["lum"], r["gw"], r["gh"], r["width"], r["height"], x, y, radius, bg)


def ray_runs(samples: DataFrame, max_gap: int) -> DataFrame:
    """(fid, ray, extent): the last bright step before `max_gap` dark steps in a row (NULL if none).

    samples(fid, ray, step from 1, bright).
    """
    w = Window.partitionBy("fid", "ray").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    s = samples.withColumn("_last", F.coalesce(F.max(F.when(F.col("bright"), F.col("step"))).over(w), F.lit(0)))
    broken = ~F.col("bright") & (F.col("step") - F.col("_last") >= max_gap)
    s = s.withColumn("_broken", F.max(broken.cast("int")).over(w))
    return s.groupBy("fid", "ray").agg(F.max(F.when(F.col("bright") & (F.col("_broken") == 0), F.col("step"))).alias("extent"))


def smooth_mean(pixels: DataFrame, k: int | None = None) -> DataFrame:
    """(2k+1)^2 box means of interior cells, as two one-dimensional passes.

    Without `k` every frame has its own in column `k`: cells are then ordered by their place in units of k, and
    the frame reaches a little over one unit each way (cells lie at least 1 / k apart).
    """
    def near(part: str, place: str) -> tuple:
        if k is not None:
            w = Window.partitionBy("fid", part).orderBy(place).rangeBetween(-k, k)
            return lambda c: F.avg(c).over(w), lambda: F.count("*").over(w)
        over = f"OVER (PARTITION BY fid, {part} ORDER BY CAST({place} AS DOUBLE) / k RANGE BETWEEN 1.000001D PRECEDING AND 1.000001D FOLLOWING)"
        return lambda c: F.expr(f"avg({c}) {over}"), lambda: F.expr(f"count(*) {over}")

    whole = 2 * (F.lit(k) if k is not None else F.col("k")) + 1
    mean, count = near("gy", "gx")
    p = pixels.withColumn("_m", mean("lum")).withColumn("_n", count()).where(F.col("_n") == whole)
    mean, count = near("gx", "gy")
    p = p.withColumn("smooth", mean("_m")).withColumn("_n", count()).where(F.col("_n") == whole)
    return p.select("fid", "gx", "gy", "smooth")


def brightest_blob(pixels: DataFrame, k: int | None = None) -> DataFrame:
    """(fid, head_x, head_y, head_val): the brightest smoothed cell, column by column on ties."""
    best = smooth_mean(pixels, k).groupBy("fid").agg(F.max(F.struct("smooth", (-F.col("gx")).alias("x"), (-F.col("gy")).alias("y"))).alias("h"))
    return best.select("fid", (-F.col("h.x")).alias("head_x"), (-F.col("h.y")).alias("head_y"), F.col("h.smooth").alias("head_val"))


def half_max_radius(r: dict[str, Column], hx: Column, hy: Column, half_max: Column, k: Column) -> Column:
    """Coma radius: the last radius where more than a quarter of 16 directions stay above half maximum."""
    angles = F.sequence(F.lit(0), F.lit(15))

    def above(rad: Column) -> Column:
        def lit(a: Column) -> Column:
            t = a / 16.0 * (2 * math.pi)
            return mean3(r, geo.half_up(hx + rad * F.cos(t)), geo.half_up(hy + rad * F.sin(t))) > half_max
        return F.size(F.filter(angles, lit))

    rads = F.sequence(k.cast("int"), (F.ceil(F.least(r["gw"], r["gh"]) / 2.0) - 1).cast("int"))
    usable = F.when(k < F.least(r["gw"], r["gh"]) / 2.0, rads).otherwise(F.array().cast("array<int>"))
    zero = F.struct(k.cast("int").alias("r"), F.lit(False).alias("stop"))
    return F.aggregate(usable, zero, lambda acc, rad: F.when(acc["stop"], acc).otherwise(
        F.when(above(rad) <= 4, F.struct(acc["r"].alias("r"), F.lit(True).alias("stop"))).otherwise(F.struct(rad.alias("r"), F.lit(False).alias("stop")))), lambda acc: acc["r"])


def _around(r: dict[str, Column], gx: Column, gy: Column, channel: str = "lum") -> Column:
    d = F.sequence(F.lit(-1), F.lit(1))
    return F.flatten(F.transform(d, lambda i: F.transform(d, lambda j: cell(r, gx + i, gy + j, channel))))


def mean3(r: dict[str, Column], gx: Column, gy: Column) -> Column:
    return F.aggregate(_around(r, gx, gy), F.lit(0.0), lambda a, v: a + v) / 9.0


def median3(r: dict[str, Column], gx: Column, gy: Column) -> Column:
    return upper_median(_around(r, gx, gy))


def streak_points(hx: Column, hy: Column, coma: Column, gw: Column, gh: Column, rays: int = 72) -> Column:
    """Array of struct(x, y, d) of grid cells along each direction, ray by ray."""
    last = F.ceil(F.hypot(gw.cast("double"), gh.cast("double"))).cast("int") - 1
    steps = F.when(coma + 2 <= last, F.sequence(coma + 2, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.sequence(F.lit(0), F.lit(rays - 1)), lambda a: F.transform(steps, lambda d: F.struct(
        geo.half_up(hx + d * F.cos(a / float(rays) * (2 * math.pi))).cast("int").alias("x"),
        geo.half_up(hy + d * F.sin(a / float(rays) * (2 * math.pi))).cast("int").alias("y"), d.alias("d"))))


def ray_extents(heads: DataFrame, rays: int = 72) -> DataFrame:
    """Adds `extents`: how far a sustained streak runs in each direction (0 when none).

    heads carry the raster and head_x, head_y, coma, tail_thr.
    """
    r = {c: F.col(c) for c in ("gw", "gh", "lum")}
    d = heads.withColumn("_rays", streak_points(F.col("head_x"), F.col("head_y"), F.col("coma"), F.col("gw"), F.col("gh"), rays))
    flat = F.flatten("_rays")
    d = d.withColumn("_m", cell_medians(r, _fields(flat, "x"), _fields(flat, "y")))
    zero = F.struct(F.lit(0).alias("far"), F.lit(0).alias("gap"), F.lit(False).alias("stop"))

    def reach(ray: Column, k: Column) -> Column:
        cells = F.zip_with(ray, F.slice("_m", k * F.size(ray) + 1, F.size(ray)), lambda p, m: F.struct(
            p["d"].alias("d"), ((p["x"] < 1) | (p["y"] < 1) | (p["x"] >= F.col("gw") - 1) | (p["y"] >= F.col("gh") - 1)).alias("off"),
            (m > F.col("tail_thr")).alias("bright")))

        def walk(acc: Column, c: Column) -> Column:
            gap = F.when(c["bright"], 0).otherwise(acc["gap"] + 1)
            return F.when(acc["stop"], acc).when(c["off"], F.struct(acc["far"].alias("far"), acc["gap"].alias("gap"), F.lit(True).alias("stop"))).otherwise(
                F.struct(F.when(c["bright"], c["d"]).otherwise(acc["far"]).alias("far"), gap.alias("gap"), (gap > 5).alias("stop")))

        return F.aggregate(cells, zero, walk, lambda acc: acc["far"])

    return d.withColumn("extents", F.transform("_rays", reach)).drop("_rays", "_m")


def raster_background(r: dict[str, Column]) -> Column:
    """Upper median of every fifth cell."""
    xs = F.when(r["gw"] > 4, F.sequence(F.lit(2), r["gw"] - 3, F.lit(5))).otherwise(F.array().cast("array<int>"))
    ys = F.when(r["gh"] > 4, F.sequence(F.lit(2), r["gh"] - 3, F.lit(5))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(upper_median(F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: cell(r, i, j))))), F.lit(0.0))


def detect_comets(pixels: DataFrame, frames: DataFrame, k: int | None = None, min_peak: float = 12.0) -> DataFrame:
    """One row per frame with a comet: nucleus, coma, confidence and an array of tails.

    pixels(fid, gx, gy, lum, r, g, b); frames(fid, width, height, pixscale) plus WCS columns.
    Every frame has its own smoothing radius, derived from its grid when `k` is not given; frames of all sizes run in one plan.
    """
    grid = pixels.groupBy("fid").agg((F.max("gx") + 1).alias("_w"), (F.max("gy") + 1).alias("_h"))
    radius = F.lit(k) if k is not None else F.greatest(F.lit(2), geo.half_up(F.least("_w", "_h") / 60.0)).cast("int")
    grid = grid.select("fid", radius.alias("k"))
    head = brightest_blob(pixels.join(grid, "fid"))
    raster = to_raster(pixels, ("lum", "r", "b"))
    d = head.join(grid, "fid").join(raster, "fid").join(frames, "fid")
    r = {c: F.col(c) for c in ("gw", "gh", "lum", "r", "b", "width", "height")}
    hx, hy = F.col("head_x"), F.col("head_y")
    d = d.withColumn("bg", raster_background(r)).withColumn("peak", F.col("head_val") - F.col("bg")).where(F.col("peak") > min_peak)
    off = F.sequence(-F.col("k"), F.col("k"))
    order = F.flatten(F.transform(off, lambda i: F.transform(off, lambda j: F.struct(
        cell(r, hx + i, hy + j).alias("v"), (-(i * 1000 + j)).alias("o"), (hx + i).alias("x"), (hy + j).alias("y")))))
    d = d.withColumn("nuc", F.array_max(order))
    d = d.withColumn("coma", half_max_radius(r, hx, hy, F.col("bg") + F.col("peak") * 0.5, F.col("k")))
    d = d.where(F.col("coma") <= 0.12 * F.least("gw", "gh"))
    d = ray_extents(d.withColumn("tail_thr", F.col("bg") + F.greatest(F.lit(6.0), F.col("peak") * 0.06)))
    ranked = F.transform("extents", lambda e, a: F.struct(e.alias("e"), (-a).alias("a")))
    d = d.withColumn("ranked", ranked).withColumn("main", F.array_max("ranked"))
    d = comet_guards(d, r)
    main_a = -F.col("main.a")
    floor2 = F.greatest(F.col("coma") * 3.0, F.col("main.e") * 0.4)
    second = F.array_max(F.filter("ranked", lambda t: (F.least(F.abs(-t["a"] - main_a), 72 - F.abs(-t["a"] - main_a)) * 5 >= 25) & (t["e"] > floor2)))
    d = d.withColumn("picked", F.array_compact(F.array("main", second)))
    per_cell = F.col("pixscale") * (F.col("width") / F.col("gw")) / 60.0
    wcs = geo.wcs_of()

    def full(gx: Column, gy: Column) -> tuple[Column, Column]:
        return (gx + 0.5) / F.col("gw") * F.col("width"), (gy + 0.5) / F.col("gh") * F.col("height")

    def tail(t: Column) -> Column:
        ang = -t["a"] / 72.0 * (2 * math.pi)
        steps = F.sequence(F.col("coma") + 2, t["e"])
        mean = lambda ch: F.aggregate(steps, F.lit(0.0), lambda acc, q: acc + cell(r, geo.half_up(hx + q * F.cos(ang)), geo.half_up(hy + q * F.sin(ang)), ch)) / F.size(steps)
        red, blue = mean("r"), mean("b")
        tx, ty = full(hx + t["e"] * F.cos(ang), hy + t["e"] * F.sin(ang))
        return F.struct(
            F.when(blue > red * 1.08, "ion").when(red > blue * 1.08, "dust").otherwise("tail").alias("kind"), tx.alias("tip_x"), ty.alias("tip_y"),
            geo.pixel_to_world(wcs, tx, ty).alias("tip_sky"), (geo.half_up(t["e"] * per_cell * 10.0) / 10.0).alias("length_arcmin"),
            geo.half_up(F.pmod(F.degrees(F.atan2(F.cos(ang), -F.sin(ang))) + 360.0, F.lit(360.0))).alias("pa"))

    d = d.withColumn("tails", F.transform("picked", tail))
    clash = (F.size("tails") == 2) & (F.get("tails", F.lit(0))["kind"] == F.get("tails", F.lit(1))["kind"])
    d = d.withColumn("tails", F.when(clash, F.transform("tails", lambda t, i: t.withField("kind", F.when(i == 0, "dust").otherwise("tail")))).otherwise(F.col("tails")))
    nx, ny = full(F.col("nuc.x"), F.col("nuc.y"))
    conf = F.least(F.lit(0.8), 0.5 + F.least(F.lit(0.3), F.col("main.e") / (F.col("coma") * 6.0) * 0.3))
    return d.select("fid", nx.alias("nucleus_x"), ny.alias("nucleus_y"), geo.pixel_to_world(wcs, nx, ny).alias("sky"),
                    (F.col("coma") * (F.col("width") / F.col("gw"))).alias("coma_px"), (geo.half_up(F.col("coma") * per_cell * 10.0) / 10.0).alias("coma_arcmin"), conf.alias("confidence"), "tails")


def comet_guards(d: DataFrame, r: dict[str, Column]) -> DataFrame:
    """Keep compact heads with one dominant tail; drop nebulae bright in many directions and even streaks."""
    d = d.where(F.col("main.e") > F.col("coma") * 3)
    median = F.get(F.array_sort("extents"), F.lit(36))
    wide = F.size(F.filter("extents", lambda e: e > F.col("coma") * 3))
    d = d.where((F.col("main.e") > 3 * (median + 1)) & (wide <= 12))
    ang = -F.col("main.a") / 72.0 * (2 * math.pi)
    steps = F.sequence(F.col("coma") + 2, F.col("main.e"))
    along = F.transform(steps, lambda q: median3(r, geo.half_up(F.col("head_x") + q * F.cos(ang)), geo.half_up(F.col("head_y") + q * F.sin(ang))))
    excess = F.aggregate(along, F.lit(0.0), lambda a, v: a + v) / F.size(along) - F.col("bg")
    return d.where(F.col("nuc.v") - F.col("bg") > 3.0 * F.greatest(excess, F.lit(1.0)))


def comet_objects(comets: DataFrame) -> DataFrame:
    """Head, coma, nucleus and tail rows of each comet."""
    size = F.greatest(F.col("coma_arcmin") * 2.0, F.lit(0.5))

    def row(ident: Column, tier: str, ft: Column, sized: bool, tip=None, review=True) -> Column:
        lab = kinds.taxonomy_label(ft)
        return F.struct(
            ident.alias("id"), F.lit(tier).alias("tier"), F.when(F.lit(tier) == "B", F.lit("comet1")).alias("parent_object_id"),
            ft.alias("feature_type"), F.coalesce(lab["zh"], F.lit("彗星")).alias("zh"), F.coalesce(lab["en"], F.lit("Comet")).alias("en"),
            (size if sized else F.lit(None).cast("double")).alias("size_major"),
            (tip["tip_x"] if tip is not None else F.lit(None).cast("double")).alias("arrow_x"),
            (tip["tip_y"] if tip is not None else F.lit(None).cast("double")).alias("arrow_y"), F.lit(review).alias("needs_human_review"))

    none = F.lit(None).cast("string")
    parts = F.array(row(F.lit("comet1"), "A", none, True, review=False), row(F.lit("comet_coma"), "B", F.lit("comet_coma"), True),
                    row(F.lit("comet_nuc"), "B", F.lit("comet_nucleus"), False))
    tails = F.transform("tails", lambda t, i: row(
        F.concat(F.lit("comet_tail"), (i + 1).cast("string")), "B",
        F.when(t["kind"] == "dust", "comet_dust_tail").when(t["kind"] == "ion", "comet_ion_tail").otherwise("comet_tail"), False, t))
    keep = ["fid", F.col("nucleus_x").alias("px"), F.col("nucleus_y").alias("py"), F.col("sky.ra").alias("ra_deg"), F.col("sky.dec").alias("dec_deg"), "confidence"]
    return comets.select(*keep, F.explode(F.concat(parts, tails)).alias("o")).select(
        "fid", "px", "py", "ra_deg", "dec_deg", "confidence", "o.*", F.lit("comet").alias("category"), F.lit("cv").alias("detection_source"))


def comet_veto(comets: DataFrame, gated: DataFrame) -> DataFrame:
    """Drop a comet when a sized, recognizable object sits at its head (a comet is in no catalogue).

    gated(fid, px, py, size_major, recognizable). A frame has one comet, so each row meets one.
    """
    guard = F.greatest(F.col("coma_px") * 3.0, F.lit(80.0))
    known = gated.where(F.col("size_major").isNotNull() & F.col("recognizable"))
    near = known.join(comets.select("fid", "nucleus_x", "nucleus_y", "coma_px"), "fid").where(
        F.hypot(F.col("px") - F.col("nucleus_x"), F.col("py") - F.col("nucleus_y")) < guard).select("fid").distinct()
    return comets.join(near, "fid", "left_anti")
