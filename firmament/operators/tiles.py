"""Frames of any size in tiles: samplers that read each tile once, and region labels joined across tile borders.

A frame's grid of gw x gh cells is cut into square tiles. For sampling, a tile carries a halo of neighbouring cells as wide as the windows asked
for, so every window lies inside one tile; points go to the tile of their centre. A tile meets its points in one cogroup and is never
joined to them as a column. A frame with very many points is dealt into several groups, each with its own copy of the tile.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.operators.spatial import connected_components
from firmament.session import cut_lineage

TILE = 256
GROUP_POINTS = 1_000_000
_STRIDE = 1 << 20  # tiles of a row of tiles, at most


def tile_of(gx: Column, gy: Column, tile: int) -> Column:
    return _tile(F.floor(gy / tile), F.floor(gx / tile))


def _tile(ty: Column, tx: Column) -> Column:
    return (ty.cast("long") * _STRIDE + tx).cast("long")


@dataclass(frozen=True)
class Pictures:
    """Brightness of frames: `grids` (fid, gw, gh, width, height) with either raster rows (fid, lum: array in row order) or a pixel table
    (fid, gx, gy, lum), which has no bound on a frame's size."""

    grids: DataFrame
    rasters: DataFrame | None = None
    pixels: DataFrame | None = None
    tile: int = TILE

    @staticmethod
    def of_rasters(rasters: DataFrame, tile: int = TILE) -> "Pictures":
        return Pictures(rasters.select("fid", "gw", "gh", "width", "height"), rasters=rasters.select("fid", "lum"), tile=tile)

    @staticmethod
    def of_pixels(pixels: DataFrame, frames: DataFrame, tile: int = TILE) -> "Pictures":
        """frames(fid, width, height): the full image the grid was sampled from."""
        size = pixels.groupBy("fid").agg((F.max("gx") + 1).cast("int").alias("gw"), (F.max("gy") + 1).cast("int").alias("gh"))
        return Pictures(size.join(frames.select("fid", "width", "height"), "fid"), pixels=pixels.select("fid", "gx", "gy", "lum"), tile=tile)

    def tiles(self, need: DataFrame) -> DataFrame:
        """fid, salt, t, x0, y0, tw, th, lum, at: the tiles of the frames in need(fid, gw, gh, halo, salts). `at` tells the cells' places in row
        order (null: all of them); a cell that is missing is unknown, of one that is repeated the brightest counts."""
        low = lambda at, halo: F.greatest(F.lit(0), at * self.tile - halo)
        high = lambda at, halo, n: F.least(n, (at + 1) * self.tile + halo)
        salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        if self.rasters is not None:
            d = need.withColumn("ty", F.explode(F.sequence(F.lit(0), F.floor((F.col("gh") - 1) / self.tile).cast("int"))))
            d = d.withColumn("tx", F.explode(F.sequence(F.lit(0), F.floor((F.col("gw") - 1) / self.tile).cast("int")))).join(self.rasters, "fid")
            d = d.withColumn("x0", low(F.col("tx"), F.col("halo"))).withColumn("y0", low(F.col("ty"), F.col("halo")))
            d = d.withColumn("tw", high(F.col("tx"), F.col("halo"), F.col("gw")) - F.col("x0"))
            d = d.withColumn("th", high(F.col("ty"), F.col("halo"), F.col("gh")) - F.col("y0"))
            cut = F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y0") + F.col("th") - 1), lambda y: F.slice("lum", y * F.col("gw") + F.col("x0") + 1, F.col("tw"))))
            d = d.withColumn("t", _tile(F.col("ty"), F.col("tx"))).withColumn("lum", cut.cast("array<double>"))
            return d.select("fid", "t", "x0", "y0", "tw", "th", "lum", F.lit(None).cast("array<int>").alias("at"), salt)
        near = lambda g, n: F.sequence(
            F.floor(F.greatest(F.lit(0), g - F.col("halo")) / self.tile).cast("int"), F.floor(F.least(n - 1, g + F.col("halo")) / self.tile).cast("int"))
        d = self.pixels.join(need, "fid").withColumn("ty", F.explode(near(F.col("gy"), F.col("gh")))).withColumn("tx", F.explode(near(F.col("gx"), F.col("gw"))))
        d = d.withColumn("x0", low(F.col("tx"), F.col("halo"))).withColumn("y0", low(F.col("ty"), F.col("halo")))
        d = d.withColumn("tw", high(F.col("tx"), F.col("halo"), F.col("gw")) - F.col("x0")).withColumn("th", high(F.col("ty"), F.col("halo"), F.col("gh")) - F.col("y0"))
        at = ((F.col("gy") - F.col("y0")) * F.col("tw") + F.col("gx") - F.col("x0")).cast("int")
        d = d.groupBy("fid", _tile(F.col("ty"), F.col("tx")).alias("t"), "x0", "y0", "tw", "th", "salts").agg(
            F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("lum").cast("double").alias("lum")))).alias("c"))  # at most a tile with its halo
        return d.select("fid", "t", "x0", "y0", "tw", "th", F.transform("c", lambda c: c["lum"]).alias("lum"), F.transform("c", lambda c: c["at"]).alias("at"), salt)


def _ranks(lum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks of a tile's cells in a grid one cell larger, the known values in order); unknown cells, and the border, rank last."""
    known = np.sort(lum[~np.isnan(lum)])
    rank = np.where(np.isnan(lum), len(known), np.searchsorted(known, lum))
    padded = np.full((lum.shape[0] + 1, lum.shape[1] + 1), len(known), np.int16 if len(known) < 32767 else np.int32)
    padded[:-1, :-1] = rank
    return padded, known


def _medians_in_tile(asks: pa.Table, tiles: pa.Table) -> pa.Table:
    """Window medians of all points of a tile, some thousand points at a time."""
    asks, tiles = asks.combine_chunks(), tiles.combine_chunks()
    size = pc.list_value_length(asks.column("at")).to_numpy()
    x, y = (pc.list_flatten(asks.column(c)).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    out = np.full(len(x), np.nan)
    if len(tiles) and len(asks):
        tile = {c: tiles.column(c)[0] for c in tiles.column_names}
        gw, gh, width, height = (float(asks.column(c)[0].as_py()) for c in ("gw", "gh", "width", "height"))
        tw, th, x0, y0 = (tile[c].as_py() for c in ("tw", "th", "x0", "y0"))
        lum = np.full(th * tw, np.nan)
        cells = slice(None) if tile["at"].as_py() is None else tile["at"].values.to_numpy()
        lum[cells] = tile["lum"].values.to_numpy(zero_copy_only=False).astype(float)
        rank, known = _ranks(lum.reshape(th, tw))
        values = np.append(known, np.nan)
        step = np.repeat(asks.column("win").to_numpy() / 3.0, size)
        offset = np.arange(-3, 4)

        def cells(at: np.ndarray, apart: np.ndarray, whole: float, n: float, low: int, beyond: int) -> np.ndarray:
            """Rows or columns of the seven samples of an axis; the unknown one beyond the tile where a sample is off the frame."""
            p = at[:, None] + offset * apart[:, None]
            inside = (p >= 0) & (p < whole)
            return np.where(inside, np.clip(np.floor(np.where(inside, p, 0) / whole * n).astype(int) - low, 0, beyond - 1), beyond)

        # A window's samples are seven rows by seven columns. Small ranks sort faster than values.
        for a in range(0, len(x), 8192):
            b = slice(a, a + 8192)
            gx, gy = cells(x[b], step[b], width, gw, x0, tw), cells(y[b], step[b], height, gh, y0, th)
            met = rank.ravel()[(gy[:, :, None] * (tw + 1) + gx[:, None, :]).reshape(-1, 49)]
            met.sort(axis=1)
            out[b] = values[met[np.arange(len(met)), np.count_nonzero(met < len(known), axis=1) // 2]]
    offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
    medians = pa.ListArray.from_arrays(offsets, pa.array(out, mask=np.isnan(out)))
    return pa.table({"fid": asks.column("fid"), "key": asks.column("key"), "at": asks.column("at").cast(pa.list_(pa.int32())), "m": medians})


def _each(array: str, name: str) -> Column:
    return F.transform(array, lambda p: p[name])


def window_medians(objects: DataFrame, pictures: Pictures, key: list[str], points: str = "_pts", win: str = "win", out: str = "_m") -> DataFrame:
    """Adds `out`: for each of an object's points (array of structs with x, y in image pixels) the upper median of 7 x 7 samples a third of `win`
    apart, null where no sample is known. `key` tells the objects of a frame apart; objects of frames without picture get nulls.

    Only points and windows travel to the tiles, and medians come back; an object's other columns, and the pictures, stay where they are.
    """
    grids = pictures.grids.select("fid", *[F.col(c).alias(f"_{c}") for c in ("gw", "gh", "width", "height")])
    lean = objects.select("fid", F.xxhash64(*key).alias("key"), F.col(win).cast("double").alias("win"), F.col(points).alias("p"))
    known = lean.join(grids, "fid")
    reach = F.ceil(F.max(F.greatest(F.col("win") / F.col("_width") * F.col("_gw"), F.col("win") / F.col("_height") * F.col("_gh")))).cast("int") + 1
    need = known.groupBy("fid", F.col("_gw").alias("gw"), F.col("_gh").alias("gh")).agg(
        F.coalesce(reach, F.lit(1)).alias("halo"), F.ceil(F.greatest(F.lit(1), F.sum(F.size("p"))) / GROUP_POINTS).cast("int").alias("salts"))

    def cell(v: Column, size: str, n: str) -> Column:
        return F.coalesce(F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor(v / F.col(size) * F.col(n)))), F.lit(0))

    placed = F.transform("p", lambda p, i: F.struct(
        i.alias("i"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"),
        tile_of(cell(p["x"], "_width", "_gw"), cell(p["y"], "_height", "_gh"), pictures.tile).alias("t")))
    asks = known.withColumn("p", placed).withColumn("t", F.explode(F.array_distinct(F.transform("p", lambda p: p["t"]))))
    asks = asks.withColumn("p", F.filter("p", lambda p: p["t"] == F.col("t"))).join(need.select("fid", "salts"), "fid")
    asks = asks.select("fid", "t", F.pmod("key", F.col("salts")).cast("int").alias("salt"), "key", "win", *[F.col(f"_{c}").alias(c) for c in ("gw", "gh", "width", "height")],
                       *[_each("p", name).alias(to) for name, to in (("i", "at"), ("x", "x"), ("y", "y"))])
    group = ["fid", "t", "salt"]

    fid = objects.schema["fid"].dataType.simpleString()
    tiles = pictures.tiles(need)
    met = asks.toDF(*asks.columns).groupBy(*group).cogroup(tiles.toDF(*tiles.columns).groupBy(*group)).applyInArrow(
        _medians_in_tile, f"fid {fid}, key long, at array<int>, m array<double>")
    gathered = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("at", "m"))))  # the points of one object
    medians = met.groupBy("fid", "key").agg(F.transform(gathered, lambda z: z["m"]).alias(out))
    told = objects.withColumn("_key", F.xxhash64(*key)).join(medians.withColumnRenamed("key", "_key"), ["fid", "_key"], "left").drop("_key")
    return told.withColumn(out, F.coalesce(out, F.transform(points, lambda p: F.lit(None).cast("double"))))


def background_levels(pictures: Pictures, n: int = 24) -> DataFrame:
    """fid, bg: the upper median of a coarse grid of interior samples, for frames of any size. Only the sampled cells of a pixel table are met."""
    idx = F.sequence(F.lit(1), F.lit(n - 1))
    spots = F.flatten(F.transform(idx, lambda i: F.transform(idx, lambda j: F.struct(
        F.floor(i / float(n) * F.col("width") / F.col("width") * F.col("gw")).cast("int").alias("gx"),
        F.floor(j / float(n) * F.col("height") / F.col("height") * F.col("gh")).cast("int").alias("gy")))))

    def median(values: Column) -> Column:
        v = F.array_sort(F.array_compact(values))
        return F.get(v, F.floor(F.size(v) / 2).cast("int"))

    if pictures.rasters is not None:
        d = pictures.grids.join(pictures.rasters, "fid")
        return d.select("fid", median(F.transform(spots, lambda s: F.get("lum", s["gy"] * F.col("gw") + s["gx"]))).alias("bg"))
    asked = pictures.grids.select("fid", F.explode(spots).alias("s")).groupBy("fid", F.col("s.gx").alias("gx"), F.col("s.gy").alias("gy")).agg(F.count("*").cast("int").alias("times"))
    hit = pictures.pixels.join(asked, ["fid", "gx", "gy"])
    return hit.groupBy("fid").agg(median(F.flatten(F.collect_list(F.array_repeat(F.col("lum").cast("double"), F.col("times"))))).alias("bg"))  # (n - 1)**2 samples


# --- regions ------------------------------------------------------------------------------------

def _grid_components(mask: np.ndarray) -> np.ndarray:
    """4-connected component numbers of a tile: union of row runs that touch. 0 outside the mask."""
    padded = np.pad(mask, ((0, 0), (1, 1)))
    step = np.diff(padded.astype(np.int8), axis=1)
    row, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    labels = np.zeros(mask.shape, dtype=np.int64)
    size = end - begin
    cells = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    run = np.repeat(np.arange(len(row)), size)
    labels[np.repeat(row, size), cells] = run + 1
    both = mask[1:] & mask[:-1]
    pairs = np.unique(np.stack([labels[:-1][both] - 1, labels[1:][both] - 1]), axis=1)
    root = np.arange(len(row))
    while pairs.shape[1]:  # every round hooks trees onto smaller ones, then flattens them
        a, b = root[pairs]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    labels[mask] = root[labels[mask] - 1] + 1
    return labels


def _tile_components(cells: DataFrame, tile: int, background: bool) -> DataFrame:
    """fid, gx, gy, node, gw, gh, t: the cells of the mask (or of the rest of the tiles that hold some) with their component within the tile."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = divmod(int(key[1]), _STRIDE)
        w, h = min(tile, int(pdf.gw.iloc[0]) - tx * tile), min(tile, int(pdf.gh.iloc[0]) - ty * tile)
        grid = np.zeros((h, w), dtype=bool)
        grid[pdf.gy.to_numpy() - ty * tile, pdf.gx.to_numpy() - tx * tile] = True
        lab = _grid_components(~grid if background else grid)
        y, x = np.nonzero(lab)
        return pd.DataFrame({"fid": key[0], "gx": x + tx * tile, "gy": y + ty * tile, "part": lab[y, x], "gw": pdf.gw.iloc[0], "gh": pdf.gh.iloc[0], "t": key[1]})

    tiled = cells.withColumn("t", tile_of(F.col("gx"), F.col("gy"), tile))
    fid = cells.schema["fid"].dataType.simpleString()
    found = tiled.groupBy("fid", "t").applyInPandas(run, f"fid {fid}, gx int, gy int, part long, gw int, gh int, t long")
    return found.withColumn("node", F.xxhash64("fid", "t", "part")).drop("part")


def _across(parts: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): components of neighbouring tiles that touch; and (node, fid, t): tiles that a component borders on."""
    right = parts.where((F.col("gx") % tile == tile - 1) & (F.col("gx") + 1 < F.col("gw"))).select("fid", (F.col("gx") + 1).alias("gx"), "gy", F.col("node").alias("a"))
    below = parts.where((F.col("gy") % tile == tile - 1) & (F.col("gy") + 1 < F.col("gh"))).select("fid", "gx", (F.col("gy") + 1).alias("gy"), F.col("node").alias("a"))
    left = parts.where((F.col("gx") % tile == 0) & (F.col("gx") > 0)).select("fid", "gx", "gy", F.col("node").alias("b"))
    above = parts.where((F.col("gy") % tile == 0) & (F.col("gy") > 0)).select("fid", "gx", "gy", F.col("node").alias("b"))
    pairs = right.join(left, ["fid", "gx", "gy"]).select("a", "b").unionByName(below.join(above, ["fid", "gx", "gy"]).select("a", "b")).distinct()
    t = tile_of(F.col("gx"), F.col("gy"), tile)
    borders = right.select("fid", F.col("a").alias("node"), t.alias("t")).unionByName(below.select("fid", F.col("a").alias("node"), t.alias("t"))).unionByName(
        left.withColumn("gx", F.col("gx") - 1).select("fid", F.col("b").alias("node"), t.alias("t"))).unionByName(
        above.withColumn("gy", F.col("gy") - 1).select("fid", F.col("b").alias("node"), t.alias("t")))
    return pairs, borders.distinct()


def _joined(parts: DataFrame, tile: int) -> DataFrame:
    """`parts` with `whole`: one node for all components of a frame that touch across tile borders."""
    pairs = cut_lineage(_across(parts, tile)[0])
    if pairs.isEmpty():
        return parts.withColumn("whole", F.col("node"))
    roots = connected_components(pairs).withColumnRenamed("component", "_root")
    return parts.join(roots, "node", "left").withColumn("whole", F.coalesce("_root", "node")).drop("_root")


def fill_holes(mask: DataFrame, below: int, tile: int = TILE) -> DataFrame:
    """`mask` (fid, gx, gy, gw, gh) with background regions of fewer than `below` cells that do not reach the frame's edge filled in."""
    tile = max(tile, int(np.ceil(np.sqrt(below))))
    cells = mask.select("fid", "gx", "gy", "gw", "gh")
    parts = _joined(cut_lineage(_tile_components(cells, tile, background=True)), tile)
    parts = cut_lineage(parts)
    # A tile without any cell of the mask is one open region, too large to be filled.
    have = cells.select("fid", tile_of(F.col("gx"), F.col("gy"), tile).alias("t")).distinct()
    open_to = _across(parts, tile)[1].join(have, ["fid", "t"], "left_anti").select("node").distinct()
    edge = (F.col("gx") == 0) | (F.col("gy") == 0) | (F.col("gx") == F.col("gw") - 1) | (F.col("gy") == F.col("gh") - 1)
    by_node = parts.groupBy("node", "whole").agg(F.count("*").alias("n"), F.max(edge).alias("edge")).join(open_to.withColumn("open", F.lit(True)), "node", "left")
    holes = by_node.groupBy("whole").agg(F.sum("n").alias("n"), F.max(F.col("edge") | F.coalesce("open", F.lit(False))).alias("out")).where((F.col("n") < below) & ~F.col("out"))
    return cells.unionByName(parts.join(holes.select("whole"), "whole", "left_semi").select("fid", "gx", "gy", "gw", "gh"))


def label_regions(mask: DataFrame, min_size: int = 1, fill_below: int = 0, tile: int = TILE) -> DataFrame:
    """(fid, gx, gy, label) of 4-connected regions of at least `min_size` cells, on frames of any size.

    Background regions that do not reach the frame's edge and are smaller than `fill_below` become part of the mask first. mask(fid, gx, gy,
    gw, gh) lists the set cells. Tiles are labelled by themselves; labels that touch across a border are joined through their
    border pairs. Regions are numbered by their first cell in row order.
    """
    cells = mask.select("fid", "gx", "gy", F.col("gw").cast("int").alias("gw"), F.col("gh").cast("int").alias("gh"))
    if fill_below:
        cells = fill_holes(cells, fill_below, tile)
    parts = cut_lineage(_joined(cut_lineage(_tile_components(cells, tile, background=False)), tile))
    first = F.min(F.col("gy").cast("long") * F.col("gw") + F.col("gx"))
    # Counted by tile first, so that one vast region is no hot key.
    size = parts.groupBy("fid", "whole", "node").agg(first.alias("first"), F.count("*").alias("n"))
    size = size.groupBy("fid", "whole").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    numbered = size.withColumn("label", F.row_number().over(Window.partitionBy("fid").orderBy("first"))).where(F.col("n") >= min_size)
    by_node = parts.select("whole", "node").distinct().join(numbered.select("whole", "label"), "whole").select("node", "label")
    return parts.join(by_node, "node").select("fid", "gx", "gy", "label")
