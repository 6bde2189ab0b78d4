"""Sky and image geometry as Column expressions. Angles are decimal degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmament.dims.vocab import CARDINALS, NICE_STEPS

WCS_FIELDS = (
    "ra0", "dec0", "crpix_x", "crpix_y", "scale_deg", "orientation_deg", "parity", "width", "height",
)


def wcs_of(alias: str | None = None) -> dict[str, Column]:
    """The frame columns of a table (optionally aliased) as keyword columns."""
    return {f: F.col(f"{alias}.{f}" if alias else f) for f in WCS_FIELDS}


def half_up(x: Column) -> Column:
    """Round half toward +infinity."""
    return F.floor(x + F.lit(0.5)).cast("double")


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo,
                      F.least(F.lit(hi) if not isinstance(hi, Column) else hi, x))


def ang_sep_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    d1, d2 = F.radians(dec1), F.radians(dec2)
    cosine = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(F.radians(ra1 - ra2))
    return F.degrees(F.acos(clamp(cosine, -1.0, 1.0)))


def wrap180(delta: Column) -> Column:
    """Fold a difference of right ascensions into [-180, 180)."""
    return F.pmod(delta + 180.0, F.lit(360.0)) - 180.0


def flat_sep_arcmin(ra1: Column, dec1: Column, ra2: Column, dec2: Column, strict: bool = False) -> Column:
    """Small-field separation using the first point's declination.

    `strict=True` leaves the 0/360 seam unwrapped.
    """
    dra = ra1 - ra2
    if not strict:
        dra = wrap180(dra)
    return F.hypot(dec1 - dec2, dra * F.cos(F.radians(dec1))) * 60.0


def bearing(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """struct(pa, cardinal): rounded position angle east of north and its 8-point name."""
    d1, d2, dra = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    east = F.sin(dra) * F.cos(d2)
    north = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(dra)
    pa = F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))
    octant = (F.floor(pa / 45.0 + 0.5) % 8).cast("int") + 1
    return F.struct(
        F.floor(pa + 0.5).cast("long").alias("pa"),
        F.element_at(F.array(*[F.lit(c) for c in CARDINALS]), octant).alias("cardinal"),
    )


TRIG_FIELDS = ("sin_dec0", "cos_dec0", "sin_th", "cos_th", "scale_rad")


def frame_trig(frames: DataFrame) -> DataFrame:
    """Adds a frame's own trigonometry, for projections of arrays inside lambdas."""
    return frames.withColumns({
        "sin_dec0": F.sin(F.radians("dec0")), "cos_dec0": F.cos(F.radians("dec0")), "sin_th": F.sin(F.radians("orientation_deg")),
        "cos_th": F.cos(F.radians("orientation_deg")), "scale_rad": F.radians("scale_deg"),
    })


def world_to_pixel(wcs: dict[str, Column], ra: Column, dec: Column) -> Column:
    """struct(px, py) of a sky point in a tangent-plane frame; NULL behind the plane.

    `wcs` may carry the columns of frame_trig, and sin_dec and cos_dec of the point, which then are not computed again.
    """
    sin0 = wcs.get("sin_dec0", F.sin(F.radians(wcs["dec0"])))
    cos0 = wcs.get("cos_dec0", F.cos(F.radians(wcs["dec0"])))
    sin_th = wcs.get("sin_th", F.sin(F.radians(wcs["orientation_deg"])))
    cos_th = wcs.get("cos_th", F.cos(F.radians(wcs["orientation_deg"])))
    scale = wcs.get("scale_rad", F.radians(wcs["scale_deg"]))
    d, dra = F.radians(dec), F.radians(ra - wcs["ra0"])
    sin_d, cos_d = wcs.get("sin_dec", F.sin(d)), wcs.get("cos_dec", F.cos(d))
    depth = sin0 * sin_d + cos0 * cos_d * F.cos(dra)
    xi = cos_d * F.sin(dra) / depth / scale
    eta = (cos0 * sin_d - sin0 * cos_d * F.cos(dra)) / depth / scale
    # The rotation is orthonormal up to parity, so its inverse is its transpose.
    dx = wcs["parity"] * (cos_th * xi + sin_th * eta)
    dy = cos_th * eta - sin_th * xi
    return F.when(
        depth > 0,
        F.struct((wcs["crpix_x"] + dx).alias("px"), (wcs["crpix_y"] - dy).alias("py")),
    )


def pixel_to_world(wcs: dict[str, Column], x: Column, y: Column) -> Column:
    """struct(ra, dec) of an image point; right ascension in [0, 360)."""
    dx, dy = (x - wcs["crpix_x"]) * wcs["parity"], wcs["crpix_y"] - y
    th, scale, d0 = F.radians(wcs["orientation_deg"]), F.radians(wcs["scale_deg"]), F.radians(wcs["dec0"])
    xi = scale * (F.cos(th) * dx - F.sin(th) * dy)
    eta = scale * (F.sin(th) * dx + F.cos(th) * dy)
    rho = F.hypot(xi, eta)
    c = F.atan(rho)
    sin_dec = F.cos(c) * F.sin(d0) + F.when(rho == 0, 0.0).otherwise(eta * F.sin(c) * F.cos(d0) / rho)
    ra = wcs["ra0"] + F.degrees(
        F.atan2(xi * F.sin(c), rho * F.cos(d0) * F.cos(c) - eta * F.sin(d0) * F.sin(c))
    )
    return F.struct(
        F.when(rho == 0, F.pmod(wcs["ra0"], F.lit(360.0))).otherwise(F.pmod(ra, F.lit(360.0))).alias("ra"),
        F.when(rho == 0, wcs["dec0"]).otherwise(F.degrees(F.asin(clamp(sin_dec, -1.0, 1.0)))).alias("dec"),
    )


def field_radius_deg(wcs: dict[str, Column]) -> Column:
    return F.hypot(wcs["width"].cast("double"), wcs["height"].cast("double")) / 2.0 * wcs["scale_deg"]


def in_image(wcs: dict[str, Column], px: Column, py: Column, margin=0.0) -> Column:
    return (
        (px >= -margin) & (px <= wcs["width"] + margin) & (py >= -margin) & (py <= wcs["height"] + margin)
    )


def size_to_px(size_arcmin: Column, scale_deg: Column) -> Column:
    """Pixel radius of an angular diameter."""
    return size_arcmin / 2.0 / (scale_deg * 60.0)


def disc_frame_coverage(px: Column, py: Column, r: Column, width: Column, height: Column) -> Column:
    """struct(coverage, covers_centre) of an object's bounding square against the frame."""
    ix = F.greatest(F.lit(0.0), F.least(px + r, width.cast("double")) - F.greatest(px - r, F.lit(0.0)))
    iy = F.greatest(F.lit(0.0), F.least(py + r, height.cast("double")) - F.greatest(py - r, F.lit(0.0)))
    return F.struct(
        (ix * iy / (4.0 * r * r)).alias("coverage"),
        ((F.abs(px - width / 2.0) <= r) & (F.abs(py - height / 2.0) <= r)).alias("covers_centre"),
    )


def center_factor(px: Column, py: Column, width: Column, height: Column) -> Column:
    """1 in the middle of the frame, falling to 0.6 at its edge (and on outside it)."""
    edge = F.greatest(F.abs(px - width / 2.0) / (width / 2.0), F.abs(py - height / 2.0) / (height / 2.0))
    return 1.0 - 0.4 * F.greatest(F.lit(0.0), (edge - 0.5) / 0.5)


def nice_step(radius: Column) -> Column:
    """The listed graticule step closest to a twelfth of the field; the smaller wins a tie."""
    target = 2.0 * radius / 12.0
    ranked = F.array(*[
        F.struct(F.abs(F.lit(s) - target).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("step"))
        for i, s in enumerate(NICE_STEPS)
    ])
    return F.array_min(ranked)["step"]


def grid_cell_decode(cell: Column, fx: Column, fy: Column, width: Column, height: Column) -> Column:
    """struct(px, py) of a reference such as 'D3' plus a fraction, in an 8 x 6 grid."""
    letter = F.upper(F.substring(F.coalesce(cell, F.lit("D")), 1, 1))
    col = F.greatest(F.lit(0), F.instr(F.lit("ABCDEFGH"), letter) - 1)
    col = F.when(F.length(letter) == 0, 3).otherwise(col)
    digits = F.regexp_extract(F.coalesce(cell, F.lit("D3")), r"^.\s*([+-]?\d+)", 1).try_cast("int")
    row = F.greatest(F.lit(0), F.when(F.coalesce(digits, F.lit(0)) == 0, 3).otherwise(digits) - 1)
    return F.struct(
        half_up((col + clamp(F.coalesce(fx, F.lit(0.5)), 0.0, 1.0)) * width / 8.0).alias("px"),
        half_up((row + clamp(F.coalesce(fy, F.lit(0.5)), 0.0, 1.0)) * height / 6.0).alias("py"),
    )


def arrow_toward(x: Column, y: Column, tx: Column, ty: Column, width: Column, height: Column) -> Column:
    """struct(px, py): a fixed-length step from one point toward another."""
    arm = clamp(0.04 * F.least(width, height), 40.0, 200.0)
    dist = F.hypot(tx - x, ty - y)
    dist = F.when(dist == 0, 1.0).otherwise(dist)
    return F.struct(
        half_up(x + (tx - x) / dist * arm).alias("px"), half_up(y + (ty - y) / dist * arm).alias("py")
    )


def polygon_centroid(points: Column) -> Column:
    """struct(x, y): rounded mean of an array of struct(x, y)."""
    n = F.size(points)

    def mean(field: str) -> Column:
        total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[field])
        return half_up(total / n)

    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def polygon_top_vertex(points: Column) -> Column:
    """struct(x, y) with the least y; the first wins a tie."""
    ranked = F.transform(points, lambda p, i: F.struct(p["y"].alias("y"), i.alias("i"), p["x"].alias("x")))
    best = F.array_min(ranked)
    return F.struct(best["x"].alias("x"), best["y"].alias("y"))


def min_vertices(kind: Column) -> Column:
    return F.when(kind == "point", 1).when(kind == "polygon", 3).otherwise(2)


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def chord(angle_deg: float) -> float:
    """Chord length on the unit sphere of an angle."""
    return 2.0 * math.sin(math.radians(min(angle_deg, 180.0)) / 2.0)
