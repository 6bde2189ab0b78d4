"""Cone searches and sky neighbourhoods as equi-joins on sky cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmament.functions import geo
from firmament.functions.kinds import object_category
from firmament.session import cut_lineage, pin, spread

EPS = 1e-7


#: Side in degrees of a base cell. Depth k halves it k times; a base cell holds 4**k cells of depth k.
BASE_DEG = 8.0
DEEPEST = 8


def _bands(zone: Column) -> Column:
    """Number of right-ascension buckets of a base declination band."""
    mid = F.radians((zone + 0.5) * BASE_DEG - 90.0)
    return F.greatest(F.lit(1), F.floor(F.cos(mid) * 360.0 / BASE_DEG)).cast("int")


def _row(dec: Column, depth: Column | int) -> Column:
    """Row of cells of a depth. Halving is exact, so a row's base band is its number shifted right by the depth."""
    return F.floor((dec + 90.0) / BASE_DEG * F.pow(F.lit(2.0), depth)).cast("int")


def _shifted(x: Column, depth: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), depth)).cast("int")


def _base_cell(row: Column, col: Column, depth: Column) -> Column:
    return (_shifted(row, depth) * 1000 + _shifted(col, depth)).cast("int")


def _cell(ra: Column, dec: Column, depth: Column | int) -> tuple[Column, Column]:
    """(row, column) of a point among the cells of a depth; cells of all depths nest."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    row = _row(dec, depth)
    n = _bands(_shifted(row, depth))
    spread = F.pow(F.lit(2.0), depth)
    col = F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * n * spread)
    return row, F.when(ra.isNotNull(), F.least(col, n * spread - 1)).cast("int")  # a row without place lies in no cell


def sky_cell(ra: Column, dec: Column) -> Column:
    """Number of a point's base cell: the column to partition a stored catalogue by (at most about 650 values)."""
    return _base_cell(*_cell(ra, dec, 0), F.lit(0))


def _depth(radius: Column) -> Column:
    """The deepest cells that are not smaller than a cone's radius."""
    return F.least(F.lit(DEEPEST), F.greatest(F.lit(0), F.floor(F.log2(BASE_DEG / F.greatest(radius, F.lit(EPS)))))).cast("int")


def _with_cone_cells(frames: DataFrame, radius: Column) -> DataFrame:
    """One row per (frame, cell its cone touches): _depth, _row, _col, _base.

    The cells' depth follows the frame's radius, so any cone touches a handful.
    """
    f = frames.withColumn("_r", radius).withColumn("_depth", _depth(F.col("_r")))
    last_row = _row(F.lit(90.0), F.col("_depth"))
    first = F.greatest(F.lit(0), _row(F.col("dec0") - F.col("_r") - EPS, F.col("_depth")))
    last = F.least(last_row, _row(F.col("dec0") + F.col("_r") + EPS, F.col("_depth")))
    f = f.withColumn("_row", F.explode(F.sequence(first, last)))
    f = f.withColumn("_n", (_bands(_shifted(F.col("_row"), F.col("_depth"))) * F.pow(F.lit(2.0), "_depth")).cast("int"))
    # Widest right-ascension half-angle of the cone; the whole circle when it holds a pole.
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("_r")) / F.cos(F.radians("dec0"))))) + EPS
    polar = F.abs("dec0") + F.col("_r") + EPS >= 90.0
    ra0 = F.pmod("ra0", F.lit(360.0))
    lo = F.floor((ra0 - half) / 360.0 * F.col("_n")).cast("int")
    hi = F.floor((ra0 + half) / 360.0 * F.col("_n")).cast("int")
    everything = polar | (hi - lo + 1 >= F.col("_n"))
    f = f.withColumn("_lo", F.when(everything, 0).otherwise(lo)).withColumn(
        "_hi", F.when(everything, F.col("_n") - 1).otherwise(hi)
    )
    f = f.withColumn("_col", F.explode(F.sequence("_lo", "_hi")))
    f = f.withColumn("_col", F.pmod("_col", F.col("_n")).cast("int")).drop("_n", "_lo", "_hi")
    return f.withColumn("_base", _base_cell(F.col("_row"), F.col("_col"), F.col("_depth")))


def _with_cells(catalog: DataFrame, depths: list[int]) -> DataFrame:
    """A catalogue row in its cell of every depth that some frame looks at (at most nine)."""
    out = catalog.withColumn("_depth", F.explode(F.array(*map(F.lit, depths)))) if len(depths) != 1 else catalog.withColumn("_depth", F.lit(depths[0]))
    row, col = _cell(F.col("ra_deg"), F.col("dec_deg"), F.col("_depth"))
    return out.withColumn("_row", row).withColumn("_col", col)


def _dealt(cones: DataFrame, sky: DataFrame, full: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by cell into as many partitions as shuffles have.

    The pairs of a cell are many times its rows, so partitions are not merged by the size of their rows. Cones of a cell that more than `full` of
    them touch are dealt into several groups, each of which meets the cell's catalogue rows.
    """
    cell = F.shiftleft(F.col("_depth").cast("long"), 32) + F.shiftleft(F.col("_row").cast("long"), 16) + F.col("_col")
    cones = cones.withColumn("_cell", cell).drop("_depth", "_row", "_col")
    sky = sky.withColumn("_cell", cell).drop("_depth", "_row", "_col")
    hot = F.broadcast(cones.groupBy("_cell").count().where(F.col("count") > full).select("_cell", F.ceil(F.col("count") / full).cast("int").alias("_groups")))
    groups = F.coalesce("_groups", F.lit(1))
    cones = cones.join(hot, "_cell", "left").withColumn("_group", F.floor(F.rand(0) * groups).cast("int")).drop("_groups")
    sky = sky.join(hot, "_cell", "left").withColumn("_group", F.explode(F.sequence(F.lit(0), groups - 1))).drop("_groups")
    return spread(cones, "_cell", "_group"), spread(sky, "_cell", "_group")


_PAIR = ("_cell", "_group", "_r", "_far", "sin_dec0", "cos_dec0", "sin_dec", "cos_dec")


def _cone_pairs(frames: DataFrame, catalog: DataFrame, radius: Column | None, cut: "tuple[int, list[str], list[str]] | None" = None) -> DataFrame:
    """The rows of `cone_search_join`, with the trigonometry of both sides.

    `cut` (m, by, order) takes of each cell and group only the first m + 1 catalogue rows by the ascending columns of order. The last of them is marked
    `_rest`: no row left out comes before it. It meets every cone that touches the cell, near or not (`_near`).
    """
    radius = geo.field_radius_deg(geo.wcs_of()) if radius is None else radius
    cones = _with_cone_cells(frames, radius)
    depths = sorted(r[0] for r in frames.select(_depth(radius).alias("d")).where("d IS NOT NULL").distinct().collect())  # at most nine numbers
    if "sky_cell" in catalog.columns:
        touched = cones.where("_base >= 0").select(F.col("_base").alias("sky_cell")).distinct()
        catalog = catalog.join(F.broadcast(touched), "sky_cell", "left_semi").drop("sky_cell")
    # Each row's own trigonometry once; a pair then costs one cosine until it is known to be near. The slack is far above rounding.
    cones = cones.drop("_base").withColumns({
        "sin_dec0": F.sin(F.radians("dec0")), "cos_dec0": F.cos(F.radians("dec0")),
        "_far": F.when(F.col("_r") < 180.0, F.cos(F.radians("_r")) - 1e-12).otherwise(-2.0)})
    sky = _with_cells(catalog, depths or [0]).withColumns({"sin_dec": F.sin(F.radians("dec_deg")), "cos_dec": F.cos(F.radians("dec_deg"))})
    if cut is not None:
        m, by, order = cut
        place = Window.partitionBy("_depth", "_row", "_col", *by).orderBy(*order)
        sky = sky.where("_col IS NOT NULL AND _row IS NOT NULL").withColumn("_rest", F.row_number().over(place)).where(F.col("_rest") <= m + 1).withColumn("_rest", F.col("_rest") > m)
    cones, sky = _dealt(cones, sky)
    # Cones are many times their file's size, by which the optimizer would choose to broadcast them.
    joined = cones.hint("merge").join(sky, ["_cell", "_group"])
    cosine = F.col("sin_dec0") * F.col("sin_dec") + F.col("cos_dec0") * F.col("cos_dec") * F.cos(F.radians(F.col("ra0") - F.col("ra_deg")))
    sep = F.degrees(F.acos(geo.clamp(cosine, -1.0, 1.0)))
    near = (cosine >= F.col("_far")) & (sep <= F.col("_r"))
    if cut is not None:
        return joined.withColumn("_near", F.coalesce(near, F.lit(False))).where(F.col("_near") | F.col("_rest")).withColumn("sep_deg", sep)
    return joined.where(near).withColumn("sep_deg", sep)


def _same(columns: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_same_{c}"]) for c in columns])


def _of_keys(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (or with left_anti: is not) among `keys`; a null key is a key.

    Keys grow with the frames. Shuffled they are small and would be broadcast; hashed, in the driver and in each executor, they are many times that.
    """
    named = keys.toDF(*[f"_same_{c}" for c in keys.columns]).hint("merge")
    return rows.join(named, _same(keys.columns, rows, named), how)


def _first_in_cones(frames: DataFrame, catalog: DataFrame, radius: Column, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The first n rows of every (fid, *by) of the cone by the ascending columns of order, without forming the cone.

    A round gives each cone the first rows of the cells it touches. The n-th of a group that is found is final when no row left out in
    these cells comes before it. Groups that are not final go on with sixteen times as long lists, until the lists are whole.
    """
    group, m, done = ["fid", *by], 8 * n, []
    left, asked = frames.withColumn("_cone_r", radius), None
    own = [*[c for c in frames.columns], *[c for c in catalog.columns if c not in frames.columns], "sep_deg"]
    key = F.struct(*order)
    while True:
        pairs = _cone_pairs(left, catalog, F.col("_cone_r"), (m, by, order)).drop(*_PAIR, "_cone_r")
        # Near rows and the marks of what was left out are ranked apart, so that one pass cuts both to a few rows of a group.
        kinds = F.array_compact(F.array(F.when(F.col("_near"), F.lit(0)), F.when(F.col("_rest"), F.lit(1))))
        pairs = pairs.withColumn("_kind", F.explode(kinds)).drop("_near", "_rest")
        place = Window.partitionBy(*group, "_kind").orderBy(*order)
        few = pairs.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n)
        if asked is not None:
            few = _of_keys(few, asked)
        few = cut_lineage(few)
        state = few.groupBy(*group).agg(
            F.max(F.when((F.col("_kind") == 0) & (F.col("_n") == n), key)).alias("_last"), F.min(F.when(F.col("_kind") == 1, key)).alias("_first_left"))
        asked = cut_lineage(state.where(F.col("_first_left").isNotNull() & (F.col("_last").isNull() | (F.col("_last") > F.col("_first_left")))).select(*group))
        found = few.where("_kind = 0").select(*own)
        if asked.isEmpty():
            return union_all([*done, found])
        done.append(_of_keys(found, asked, "left_anti"))
        left = cut_lineage(_of_keys(left, asked.select("fid").distinct()))
        m *= 16


def _nearest_in_cones(frames: DataFrame, catalog: DataFrame, radius: Column, n: int) -> DataFrame:
    """The n nearest rows of every frame's cone, ties included, without forming the cone.

    A frame first looks as far as the side of the deepest cell around it with a fair number of rows. Whoever finds fewer than n looks four
    times as far, up to the cone's radius: whatever lies nearer than a row that was found was found too.
    """
    depths = F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("_d")

    def placed(rows: DataFrame, ra: str, dec: str) -> DataFrame:
        row, col = _cell(F.col(ra), F.col(dec), F.col("_d"))
        return rows.withColumn("_cr", row).withColumn("_cc", col)

    counts = placed(catalog.select("ra_deg", "dec_deg", depths), "ra_deg", "dec_deg").groupBy("_d", "_cr", "_cc").count().where(F.col("count") >= 8 * n).drop("count")
    spots = placed(frames.select("ra0", "dec0").distinct().select("*", depths), "ra0", "dec0")
    # Neither the cells nor the places of frames are few: they meet in merge joins and never in the driver.
    start = spots.join(counts.hint("merge"), ["_d", "_cr", "_cc"]).groupBy("ra0", "dec0").agg((BASE_DEG / F.pow(F.lit(2.0), F.max("_d"))).alias("_look"))
    left = frames.withColumn("_cone_r", radius).join(start.hint("merge"), ["ra0", "dec0"], "left").select(*frames.columns, "_cone_r", F.least("_look", "_cone_r").alias("_look"))
    left, done = cut_lineage(left), []
    own = [*frames.columns, *[c for c in catalog.columns if c not in frames.columns], "sep_deg"]
    nearest = Window.partitionBy("fid").orderBy("sep_deg")
    while True:
        pairs = cone_search_join(left, catalog, F.col("_look"))
        few = cut_lineage(pairs.withColumn("_n", F.rank().over(nearest)).where(F.col("_n") <= n).select(*own))
        short = few.groupBy("fid").count().where(F.col("count") >= n).select("fid")
        more = left.where(F.col("_look") < F.col("_cone_r")).select("fid").distinct()
        more = cut_lineage(_of_keys(more, short, "left_anti"))
        if more.isEmpty():
            return union_all([*done, few])
        done.append(_of_keys(few, more, "left_anti"))
        left = cut_lineage(_of_keys(left, more).withColumn("_look", F.least(F.col("_look") * 4.0, "_cone_r")))


def cone_search_join(
    frames: DataFrame, catalog: DataFrame, radius: Column | None = None, nearest: int | None = None,
    first: tuple[int, list[str], list[str]] | None = None, whole: bool = False,
) -> "DataFrame | Cones":
    """Every (frame, catalogue row) pair within the frame's field radius.

    The distance predicate becomes an equi-join on nested sky cells plus an exact filter: each frame chooses the cell size by its own radius,
    both sides shuffle once and only rows of one cell meet; cells that very many frames look at are split. A catalogue read by
    `read_zoned_catalog` is first cut to the base cells that some cone touches, by dynamic pruning of its partitions: files of other
    cells are not opened. The list of touched cells has a bounded size, whatever the number of frames.

    Who needs only some of a cone's rows says which, and the rest is never formed: `nearest` n of each frame (with ties), or the `first` (n, by,
    order): n rows of each frame and value of the columns `by`, by ascending columns (nulls first, as in a sort). Who reads whole cones, a frame at a
    time, asks for `whole`: such cones are formed where they are read, and their pairs are never shuffled.
    """
    if whole:
        return Cones(frames, catalog, geo.field_radius_deg(geo.wcs_of()) if radius is None else radius)
    if nearest is not None or first is not None:
        radius = geo.field_radius_deg(geo.wcs_of()) if radius is None else radius
        return _nearest_in_cones(frames, catalog, radius, nearest) if nearest is not None else _first_in_cones(frames, catalog, radius, *first)
    return _cone_pairs(frames, catalog, radius).drop(*_PAIR)


class Cones:
    """Cones of a search that are not formed yet, for steps that read a frame's cone as a whole.

    Frames are dealt by home, a cell at least four times as wide as their cones; the catalogue rows that some cone of a home may hold are dealt to it,
    about two or three copies of a row. One task then holds all that the frames of a home see, and forms and reads cone after cone. Only frames and
    catalogue rows are shuffled, never pairs. Memory is that of a home's rows: homes of very many frames are dealt into groups, and where
    the sky is crowded homes are only as wide as the cones.
    """

    FULL, CROWDED, CANDIDATES = 8192, 250_000, 2_000_000

    def __init__(self, frames: DataFrame, catalog: DataFrame, radius: Column):
        self.frames, self.catalog, self.radius = frames, catalog, radius

    def rows(self) -> DataFrame:
        """All pairs."""
        return cone_search_join(self.frames, self.catalog, self.radius)

    def with_catalog(self, catalog: DataFrame) -> "Cones":
        return Cones(self.frames, catalog, self.radius)

    def split(self) -> tuple["Cones", "Cones | None"]:
        """(frames of their own number, frames without a number or sharing one): the cones of the latter together are one group, wherever they look."""
        shared = self.frames.groupBy("fid").count().where("count > 1 OR fid IS NULL").select("fid")
        if shared.isEmpty():
            return self, None
        shared = cut_lineage(shared)
        apart = [Cones(_of_keys(self.frames, shared, how), self.catalog, self.radius) for how in ("left_anti", "left_semi")]
        return apart[0], apart[1]

    def _homes(self) -> tuple[DataFrame, DataFrame]:
        """Frames with their home, and the homes with the circle and the declinations that their cones reach."""
        f = self.frames.withColumn("_r", self.radius).where("ra0 IS NOT NULL AND dec0 IS NOT NULL AND _r IS NOT NULL")
        depth = _depth(F.col("_r"))
        f = f.withColumn("_depth", F.greatest(F.lit(0), depth - 2)).withColumn("_least", depth)
        f = f.withColumns(dict(zip(("_row", "_col"), _cell(F.col("ra0"), F.col("dec0"), F.col("_depth")))))
        depths = sorted(r[0] for r in f.select("_depth").distinct().collect())  # at most nine numbers
        place = ["_depth", "_row", "_col"]
        # Counted once: a catalogue's rows may be costly to read.
        sky = cut_lineage(_with_cells(self.catalog.select("ra_deg", "dec_deg"), depths or [0]).groupBy(*place).count().where(F.col("count") > self.CROWDED))
        f = f.join(F.broadcast(sky.withColumnRenamed("count", "_many")), place, "left")  # as many as fit the table
        f = f.withColumn("_depth", F.when(F.col("_many").isNull(), F.col("_depth")).otherwise(F.col("_least"))).drop("_many", "_least")
        f = f.withColumns(dict(zip(("_row", "_col"), _cell(F.col("ra0"), F.col("dec0"), F.col("_depth")))))
        f = f.withColumn("_home", F.shiftleft(F.col("_depth").cast("long"), 48) + F.shiftleft(F.col("_row").cast("long"), 24) + F.col("_col"))
        hot = F.broadcast(f.groupBy("_home").count().where(F.col("count") > self.FULL).select("_home", F.ceil(F.col("count") / self.FULL).cast("int").alias("_groups")))
        f = f.join(hot, "_home", "left").withColumn("_group", F.pmod(F.xxhash64("fid"), F.coalesce("_groups", F.lit(1))).cast("int")).drop("_groups")
        side = F.pow(F.lit(2.0), "_depth") / BASE_DEG
        mid_dec = (F.col("_row") + 0.5) / side - 90.0
        mid_ra = (F.col("_col") + 0.5) / (_bands(_shifted(F.col("_row"), F.col("_depth"))) * F.pow(F.lit(2.0), "_depth")) * 360.0
        f = f.withColumn("_ra", mid_ra).withColumn("_dec", mid_dec)
        reach = geo.ang_sep_deg(F.col("_ra"), F.col("_dec"), F.col("ra0"), F.col("dec0")) + F.col("_r") + EPS
        homes = f.groupBy("_home", "_group").agg(
            F.first("_ra").alias("ra0"), F.first("_dec").alias("dec0"), F.least(F.lit(180.0), F.max(reach)).alias("_reach"),
            F.min(F.col("dec0") - F.col("_r")).alias("_south"), F.max(F.col("dec0") + F.col("_r")).alias("_north"))
        return f, cut_lineage(homes)

    def form(self, read: "Callable[[dict[str, pa.Array], dict[str, pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]]", out: str,
             order: list[str], late: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """What `read` makes of the cones, home by home: it gets the home's frames, its catalogue rows in the given order, and (frame, row) pairs as places in
        both: whole cones, each frame's rows in that order. `late` adds columns to catalogue rows that have been dealt, so that these are not shuffled."""
        f, homes = self._homes()
        few = homes.count() <= 20_000
        cells = _with_cone_cells(homes, F.col("_reach")).select("_depth", "_row", "_col", "_home", "_group", "_reach", "_south", "_north", F.col("ra0").alias("_ra0"), F.col("dec0").alias("_dec0"))
        depths = sorted(r[0] for r in cells.select("_depth").distinct().collect())
        own = self.catalog.columns
        sky = _with_cells(self.catalog, depths or [0]).join(cells.hint("broadcast" if few else "merge"), ["_depth", "_row", "_col"])
        sky = sky.where((geo.ang_sep_deg(F.col("_ra0"), F.col("_dec0"), F.col("ra_deg"), F.col("dec_deg")) <= F.col("_reach") + EPS)
                        & (F.col("dec_deg") >= F.col("_south") - EPS) & (F.col("dec_deg") <= F.col("_north") + EPS))
        sky = sky.select("_home", "_group", F.lit(1).alias("_kind"), *own)
        cone = F.struct(*self.frames.columns, "_r").alias("_f")
        rows = spread(f.select("_home", "_group", F.lit(0).alias("_kind"), cone).unionByName(sky, allowMissingColumns=True), "_home", "_group")
        rows = rows.sortWithinPartitions("_home", "_group", "_kind", *order)
        rows = rows.withColumns({f"_{t.__name__}{at}": t(F.radians(c)) for t in (F.sin, F.cos) for at, c in (("", "dec_deg"), ("0", "_f.dec0"))})
        rows, most = rows if late is None else late(rows), self.CANDIDATES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for home in _runs(batches, ("_home", "_group")):
                n = int(np.count_nonzero(home.column("_kind").to_numpy() == 0))
                if 0 < n < len(home):
                    cones, rows = home.slice(0, n), home.slice(n)
                    frames = _fields(cones.column("_f")) | {c: cones.column(c).combine_chunks() for c in ("_sin0", "_cos0")}
                    sky = {c: rows.column(c).combine_chunks() for c in rows.column_names if c != "_f"}
                    yield from read(frames, sky, _near_pairs(frames, sky, most))

        return rows.mapInArrow(run, out)


    def picked(self, pick: "Pick") -> DataFrame:
        """The pairs that `pick` does not rule out, with the columns of both sides. Frames sharing a number keep all their pairs."""
        own, shared = self.split()
        columns = [*self.frames.columns, *[c for c in self.catalog.columns if c not in self.frames.columns]]
        kind = dict(self.catalog.dtypes) | dict(self.frames.dtypes)
        most = self.CANDIDATES

        def read(frames, rows, _):
            for f, s in pick.pairs(Looks(frames, rows, most), frames, rows):
                yield pa.RecordBatch.from_arrays([frames[c].take(pa.array(f)) if c in frames else rows[c].take(pa.array(s)) for c in columns], columns)

        pairs = own.form(read, ", ".join(f"`{c}` {kind[c]}" for c in columns), [], pick.late)
        pairs = pairs.withColumn("sep_deg", geo.ang_sep_deg(F.col("ra0"), F.col("dec0"), F.col("ra_deg"), F.col("dec_deg")))
        return pairs if shared is None else pairs.unionByName(shared.rows().select(*pairs.columns))


class Pick:
    """Which pairs of whole cones a later step may need. What is left out must not change the step's result."""

    def late(self, rows: DataFrame) -> DataFrame:
        """Catalogue rows with what `pairs` reads of them."""
        return rows

    def pairs(self, looks: "Looks", frames: dict[str, pa.Array], rows: dict[str, pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        raise NotImplementedError


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, which follow one another, as a table."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in key:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        bounds = [0, *np.flatnonzero(new), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            at = tuple(batch.column(c)[int(a)].as_py() for c in key)
            if held and at != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
            last = at
    if held:
        yield pa.Table.from_batches(held)


def _fields(column: pa.ChunkedArray) -> dict[str, pa.Array]:
    """The fields of a struct column, each as one array."""
    t = pa.Table.from_struct_array(column)
    return {c: t.column(c).combine_chunks() for c in t.column_names}


class Looks:
    """The frames of a home and its catalogue rows, some frames at a time with the strip of rows that any of them reaches; the distance test is that of `_cone_pairs`."""

    def __init__(self, frames: dict[str, pa.Array], sky: dict[str, pa.Array], most: int):
        self.ra0, self.dec0, self.r, self.sin0, self.cos0 = (frames[c].to_numpy(zero_copy_only=False).astype(float) for c in ("ra0", "dec0", "_r", "_sin0", "_cos0"))
        self.ra, self.dec, self.sin, self.cos = (sky[c].to_numpy(zero_copy_only=False).astype(float) for c in ("ra_deg", "dec_deg", "_sin", "_cos"))
        self.axes = np.stack([self.cos * np.cos(np.radians(self.ra)), self.cos * np.sin(np.radians(self.ra)), self.sin])
        self.heads = np.stack([self.cos0 * np.cos(np.radians(self.ra0)), self.cos0 * np.sin(np.radians(self.ra0)), self.sin0], axis=1)
        self.low = np.where(self.r < 180.0, np.cos(np.radians(np.minimum(self.r, 180.0))) - 1e-12, -2.0)
        self.most = most

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(frames, rows, their cosines within rounding)."""
        turn, at = np.argsort(self.dec0, kind="stable"), 0
        while at < len(turn):
            some = turn[at:at + max(16, 3 * self.most // len(self.dec))]
            strip = np.flatnonzero((self.dec >= np.min(self.dec0[some] - self.r[some]) - EPS) & (self.dec <= np.max(self.dec0[some] + self.r[some]) + EPS))
            some = some[:max(1, self.most // max(1, len(strip)))]
            at += len(some)
            yield some, strip, self.heads[some] @ (self.axes if len(strip) == len(self.dec) else self.axes[:, strip])

    def near(self, some: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(frame, row) pairs of some frames and some rows, some frames at a time."""
        n = max(1, self.most // max(1, len(rows)))
        for at in range(0, len(some), n):
            part = some[at:at + n]
            f, s = np.nonzero(self.heads[part] @ self.axes[:, rows] >= (self.low[part] - SLACK)[:, None])
            f, s = part[f], rows[s]
            near = self.test(f, s)
            yield f[near], s[near]

    def test(self, f: np.ndarray, s: np.ndarray) -> np.ndarray:
        cosine = self.sin0[f] * self.sin[s] + self.cos0[f] * self.cos[s] * np.cos(np.radians(self.ra0[f] - self.ra[s]))
        return (cosine >= self.low[f]) & (np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0))) <= self.r[f])


#: How far the product of two unit vectors may be from the cosine of the distance test: far above rounding.
SLACK = 1e-9


def _near_pairs(frames: dict[str, pa.Array], sky: dict[str, pa.Array], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(frame, row) of whole cones, some frames at a time."""
    looks = Looks(frames, sky, most)
    for some, strip, cosines in looks:
        f, s = np.nonzero(cosines >= (looks.low[some] - SLACK)[:, None])
        f, s = some[f], strip[s]
        near = looks.test(f, s)
        if near.any():
            yield f[near], s[near]


def near_counts(frames: dict[str, pa.Array], sky: dict[str, pa.Array], group: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(frames, rows of each group in their cones), some frames at a time; groups are numbered from 0 and follow one another. Only rows at a cone's edge are taken up one by one."""
    looks, n = Looks(frames, sky, most), int(group.max(initial=-1)) + 1
    for some, strip, cosines in looks:
        low = looks.low[some][:, None]
        ends = np.searchsorted(group[strip], np.arange(n + 1))
        sure = cosines >= low + SLACK
        counts = np.stack([np.count_nonzero(sure[:, a:b], axis=1) for a, b in zip(ends[:-1], ends[1:])], axis=1)
        sure ^= cosines >= low - SLACK
        f, s = np.nonzero(sure)
        near = looks.test(some[f], strip[s])
        np.add.at(counts, (f[near], group[strip[s[near]]]), 1)
        yield some, counts


def in_frame_join(frames: DataFrame, catalog: DataFrame, margin: float = 0.05, pick: Pick | None = None) -> DataFrame:
    """Cone search, projection to pixels, and the in-frame test with a margin; of the pairs that `pick` does not rule out, where one is given."""
    if pick is not None:
        pairs = Cones(frames, catalog, geo.field_radius_deg(geo.wcs_of())).picked(pick)
        xy = pin(pairs, _xy=geo.world_to_pixel(geo.wcs_of(), F.col("ra_deg"), F.col("dec_deg")))
        xy = xy.withColumn("px", F.col("_xy.px")).withColumn("py", F.col("_xy.py")).drop("_xy")
        return xy.where(geo.in_image(geo.wcs_of(), F.col("px"), F.col("py"), margin * F.greatest("width", "height")))
    turned = frames.withColumns({"sin_th": F.sin(F.radians("orientation_deg")), "cos_th": F.cos(F.radians("orientation_deg")), "scale_rad": F.radians("scale_deg")})
    wcs = {**geo.wcs_of(), **{c: F.col(c) for c in (*geo.TRIG_FIELDS, "sin_dec", "cos_dec")}}
    xy = pin(_cone_pairs(turned, catalog, None), _xy=geo.world_to_pixel(wcs, F.col("ra_deg"), F.col("dec_deg")))
    xy = xy.withColumn("px", F.col("_xy.px")).withColumn("py", F.col("_xy.py")).drop("_xy", "sin_th", "cos_th", "scale_rad", *_PAIR)
    edge = margin * F.greatest("width", "height")
    return xy.where(geo.in_image(wcs, F.col("px"), F.col("py"), edge))


def write_zoned_catalog(catalog: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a catalogue by base cell of the sky, sorted by place within, so that cone searches open the cells they touch.

    Rows are dealt by ranges of (cell, declination row, right ascension), so a crowded cell is written by several tasks as several files.
    """
    placed = catalog.withColumn("sky_cell", sky_cell(F.col("ra_deg"), F.col("dec_deg")))
    place = ["sky_cell", _row(F.col("dec_deg"), DEEPEST), "ra_deg"]
    placed.repartitionByRange(*place).sortWithinPartitions(*place).write.mode(mode).partitionBy("sky_cell").parquet(path)


def read_zoned_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue stored by `write_zoned_catalog`, with its sky_cell."""
    stored = spark.read.parquet(path)
    return stored.withColumn("sky_cell", F.col("sky_cell").cast("int"))


def _cube(ra: Column, dec: Column, side: Column) -> list[Column]:
    """Cell of a sky point in a cubic grid around the unit sphere: no seam and no poles."""
    return [F.floor(axis / side).cast("long") for axis in geo.unit_vector(ra, dec)]


def _around(cells: list[Column]) -> Column:
    """The 27 cells around a cell, as an array of structs."""
    axes = [F.array(c - 1, c, c + 1) for c in cells]
    return F.flatten(F.transform(axes[0], lambda x: F.flatten(F.transform(
        axes[1], lambda y: F.transform(axes[2], lambda z: F.struct(
            x.alias("x"), y.alias("y"), z.alias("z")))))))


def same_complex_pairs(catalog: DataFrame, key: str = "obj_id", strict: bool = False) -> DataFrame:
    """Concentric emission/reflection pairs of comparable size.

    Cells are sized by the smaller member's reach and both members must be within a
    factor 2.5 in size, so a row only meets rows it could nearly pair with.
    """
    rows = (
        catalog.withColumn("category", object_category(F.col("otype")))
        .where(F.col("category").isin("emission_nebula", "reflection_nebula") & (F.col("size_major") > 0))
        .select(key, "category", "ra_deg", "dec_deg", "size_major")
        .withColumn("_level", F.floor(F.log2("size_major")).cast("int"))
    )
    # Reach of a member of level L is under 0.3 * 2^(L+1) arcmin, and a little more on the sphere.
    def reach(level: Column) -> Column:
        return F.radians(F.pow(F.lit(2.0), level + 1) * 0.3 / 60.0) * 1.5

    left = rows.where("category = 'emission_nebula'")
    right = rows.where("category = 'reflection_nebula'")
    side = reach(F.col("_small"))
    # A pair's cells follow its smaller level; levels of a pair differ by at most two.
    span = F.array(*[F.col("_level") - d for d in range(3)])
    a = left.withColumn("_small", F.explode(span))
    b = right.withColumn("_small", F.explode(span))
    ax = _cube(F.col("ra_deg"), F.col("dec_deg"), side)
    a = a.withColumn("_cell", F.explode(_around(ax)))
    bx = _cube(F.col("ra_deg"), F.col("dec_deg"), side)
    b = b.withColumn("_cell", F.struct(bx[0].alias("x"), bx[1].alias("y"), bx[2].alias("z")))
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in (key, "ra_deg", "dec_deg", "size_major", "_level")], "_small", "_cell")
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in (key, "ra_deg", "dec_deg", "size_major", "_level")], "_small", "_cell")
    j = a.join(b, ["_small", "_cell"]).where(F.least("a__level", "b__level") == F.col("_small"))
    sep = geo.flat_sep_arcmin(F.col("a_ra_deg"), F.col("a_dec_deg"), F.col("b_ra_deg"), F.col("b_dec_deg"), strict)
    small, big = F.least("a_size_major", "b_size_major"), F.greatest("a_size_major", "b_size_major")
    return (
        j.withColumn("sep_arcmin", sep)
        .where((small >= 0.4 * big) & (F.col("sep_arcmin") <= 0.3 * small))
        .select(F.col(f"a_{key}").alias("emission_id"), F.col(f"b_{key}").alias("reflection_id"), "sep_arcmin")
    )


def duplicate_reach_arcmin(size_major: Column) -> Column:
    """How far a row can interact with another during a merge, growth included."""
    return F.greatest(F.lit(10.0), 1.2 * F.coalesce(size_major, F.lit(0.0))) * 1.05


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node id of each component.

    Every round each tree hooks onto the smallest label next to any of its members, then all
    labels jump to their label's label, so rounds grow with the logarithm of a component's
    diameter. Each round is checkpointed; ids are integers.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = cut_lineage(pairs.union(pairs.select(F.col("v"), F.col("u"))).distinct())
    p = cut_lineage(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")))
    for _ in range(max_rounds):
        near = e.join(p.select(F.col("u").alias("v"), "p"), "v").groupBy("u").agg(F.min("p").alias("m"))
        step = p.join(near, "u").select("u", "p", F.least("p", "m").alias("m"))
        hook = step.groupBy("p").agg(F.min("m").alias("h"))
        hooked = cut_lineage(step.join(hook, "p").select("u", F.col("p").alias("old"), F.least("m", "h").alias("p")))
        root = hooked.select(F.col("u").alias("p"), F.col("p").alias("up"))
        jumped = hooked.join(root, "p", "left").select("u", "old", F.least("p", F.coalesce("up", "p")).alias("p"))
        jumped = cut_lineage(jumped)
        if jumped.where("p <> old").isEmpty():
            return jumped.select(F.col("u").alias("node"), F.col("p").alias("component"))
        p = jumped.drop("old")
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def duplicate_components(catalog: DataFrame, key: str = "obj_id", max_level: int = 7) -> DataFrame:
    """(key, component): groups of rows that a whole-sky merge must see together.

    Rows are first reduced to occupied sky cells per (merge block, size level); the sky
    holds a bounded number of cells, so a hot spot of copies becomes one node and no pair
    of rows is formed. A cell links to its 27 neighbours on its own level and smaller
    levels link upward to such touched cells: every pair within reach ends up connected.
    Cells of a patch of 3 x 3 x 3 share a neighbour two by two, so the graph is one of patches,
    each named by its least node.
    """
    sky = merge_block(catalog).where(F.col("block").isNotNull())
    level = F.least(
        F.lit(max_level),
        F.greatest(F.lit(0), F.ceil(F.log2(duplicate_reach_arcmin(F.col("size_major")) / 10.5 - 1e-9))),
    ).cast("int")
    biggest = 10.5 * 2 ** max_level
    sky = sky.withColumn("_level", level).withColumn(
        "_level", F.when(duplicate_reach_arcmin(F.col("size_major")) > biggest, max_level + 1).otherwise(F.col("_level"))
    )

    def side(lv: Column) -> Column:
        # Flat separation can understate the arc by at most sqrt(2); one level above all holds the sky.
        arc = F.radians(F.pow(F.lit(2.0), lv) * 10.5 / 60.0) * 1.5
        return F.when(lv > max_level, 4.0).otherwise(arc)

    def vertex(kind: str, lv: Column, x: Column, y: Column, z: Column) -> Column:
        return F.xxhash64(F.col("block"), F.lit(kind), lv, x, y, z)

    cells = _cube(F.col("ra_deg"), F.col("dec_deg"), side(F.col("_level")))
    sky = sky.withColumn("_node", vertex("n", F.col("_level"), *cells))
    native = sky.select("_node", "block", "_level", *[c.alias(a) for c, a in zip(cells, "xyz")]).distinct()
    patch = ["block", "_level", *[f"_{a}" for a in "xyz"]]
    native = native.select("*", *[F.floor(F.col(a) / 3).alias(f"_{a}") for a in "xyz"])
    native = cut_lineage(native.withColumn("_patch", F.min("_node").over(Window.partitionBy(*patch))))
    near = native.repartition(*patch)
    touched = near.withColumn("_c", F.explode(_around([F.col(a) for a in "xyz"]))).select(
        *patch, "_patch", vertex("c", F.col("_level"), F.col("_c.x"), F.col("_c.y"), F.col("_c.z")).alias("_vertex"), F.lit(True).alias("_own")
    )
    # A node's cell at each higher level. Sides double from level to level and the top one parts the sky at zero, so cells nest exactly: the
    # nodes tell it, and rows are not spread over all levels.
    upward = near.withColumn("_up", F.explode(F.sequence("_level", F.lit(max_level + 1))))

    def above(axis: str) -> Column:
        c = F.col(axis)
        top = F.when(c < 0, F.lit(-1)).when(c >= 0, F.lit(0))
        return F.when(F.col("_up") == F.col("_level"), c).when(F.col("_up") > max_level, top.cast("long")).otherwise(F.expr(f"shiftright({axis}, _up - _level)"))

    upward = upward.select(*patch, "_patch", vertex("c", F.col("_up"), *[above(a) for a in "xyz"]).alias("_vertex"), F.lit(False).alias("_own"))
    # What meets in a touched cell all links to the least patch there. Patches are dealt whole, so copies collapse before they are shuffled.
    meet = [d.groupBy(*patch, "_patch", "_vertex", "_own").agg(F.count("*")).select("_patch", "_vertex", "_own") for d in (touched, upward)]
    meet = meet[0].unionByName(meet[1]).repartition("_vertex")
    place = Window.partitionBy("_vertex")
    edges = meet.select(F.col("_patch").alias("a"), F.min("_patch").over(place).alias("b"), F.max("_own").over(place).alias("_own")).where("_own AND a <> b")
    edges = edges.select("a", "b").distinct()
    comp = connected_components(edges).withColumnRenamed("node", "_patch")
    # A patch without neighbours is its own component.
    nodes = native.select("_node", "_patch").join(comp, "_patch", "left").groupBy("_node").agg(F.min(F.coalesce("component", "_patch")).alias("component"))
    return sky.select(key, "_node").join(nodes, "_node").select(key, "component")


def merge_block(catalog: DataFrame) -> DataFrame:
    """Adds category and block: only rows of one block can ever merge; NULL never merges."""
    out = catalog.withColumn("category", object_category(F.col("otype")))
    bright = F.col("category").isin("emission_nebula", "reflection_nebula")
    return out.withColumn("block", F.when(bright, "bright_nebula").otherwise(F.col("category")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
