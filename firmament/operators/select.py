"""Gating, ranking and selection of the objects worth annotating in each frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmament.dims.vocab import NICKNAMES
from firmament.functions import geo, kinds, names
from firmament.functions.names import normalize_designation
from firmament.operators.spatial import Looks, Pick
from firmament.session import cut_lineage, literal_map, pin

TIE = ("src_rank", "row_idx")
CAPS = {"star": 2, "cluster": 2, "nebula": 2, "galaxy": 1}
KIND_ORDER = {"star": 0, "cluster": 1, "nebula": 2, "galaxy": 3}


def _identity_strings() -> Column:
    return F.concat(F.map_values("catalog_ids"), F.col("names"), F.array("main_id"))


def nickname_overlay(candidates: DataFrame, nicknames: DataFrame | None = None, key: tuple[str, ...] = ("fid", "obj_id")) -> DataFrame:
    """Curated common names: adds `curated` and overrides common_name (own zh kept if none given).

    With no table given, the built-in names are folded into the plan as literals. A table
    (designation, en, zh) is joined on the normalised designation; the first matching
    identity string wins either way.
    """
    if nicknames is None:
        en = literal_map({k.upper(): v[0] for k, v in NICKNAMES.items()})
        zh = literal_map({k.upper(): v[1] for k, v in NICKNAMES.items()})
        hits = F.filter(
            F.transform(_identity_strings(), normalize_designation),
            lambda d: d.isin(*[k.upper() for k in NICKNAMES]),
        )
        out = pin(candidates, _hit=F.try_element_at(hits, F.lit(1)))
        nick_en, nick_zh = F.try_element_at(en, F.col("_hit")), F.try_element_at(zh, F.col("_hit"))
        out = out.withColumn("_en", nick_en).withColumn("_zh", nick_zh)
    else:
        table = nicknames.select(normalize_designation(F.col("designation")).alias("_d"), "en", "zh")
        hit = (
            candidates.select(*key, F.posexplode(_identity_strings()).alias("_pos", "_id"))
            .withColumn("_d", normalize_designation(F.col("_id")))
            .join(table, "_d")
            .groupBy(*key).agg(F.min_by(F.struct("en", "zh"), "_pos").alias("_nick"))
        )
        out = candidates.join(hit, list(key), "left")
        out = out.withColumn("_en", F.col("_nick.en")).withColumn("_zh", F.col("_nick.zh")).drop("_nick")
    return (
        out.withColumn("curated", F.col("_en").isNotNull())
        .withColumn("common_name", F.when(F.col("curated"), F.struct(
            F.coalesce("_zh", "common_name.zh").alias("zh"), F.col("_en").alias("en"))).otherwise(F.col("common_name")))
        .drop("_hit", "_en", "_zh")
    )


def appraise(catalog: DataFrame, star_mag_max: float = 4.0, nebula_min: float = 8.0, galaxy_min: float = 3.0) -> DataFrame:
    """What a catalogue row alone decides, once a row and not once a pair: the optical rows of a known category, with category and, where the
    rows carry their identities and `curated`, `weight` (significance) and `noted` (prominence by the given bounds)."""
    c = pin(catalog.where(kinds.is_optical(F.col("otype"))), category=kinds.object_category(F.col("otype"))).where(F.col("category").isNotNull())
    if "curated" not in c.columns:
        return c
    return pin(c, weight=kinds.significance(F.col("catalog_ids"), F.col("size_major"), F.col("common_name"), F.col("mag")),
               noted=F.coalesce(_noted(star_mag_max, nebula_min, galaxy_min), F.lit(False)))


def gate_candidates(
    candidates_px: DataFrame, margin: float = 0.05, min_cover: float = 0.5, appraised: bool = False
) -> DataFrame:
    """Optical, of a known category, in the frame, and not mostly outside it. Rows of an appraised catalogue are optical and have their category."""
    c = candidates_px if appraised else pin(
        candidates_px.where(kinds.is_optical(F.col("otype"))), category=kinds.object_category(F.col("otype"))
    ).where(F.col("category").isNotNull())
    c = c.where(geo.in_image(geo.wcs_of(), F.col("px"), F.col("py"), margin * F.greatest("width", "height")))
    r = geo.size_to_px(F.col("size_major"), F.col("scale_deg"))
    cover = geo.disc_frame_coverage(F.col("px"), F.col("py"), r, F.col("width"), F.col("height"))
    shown = (cover["coverage"] >= min_cover) | cover["covers_centre"]
    return c.where(F.col("size_major").isNull() | (r <= 1.0) | shown)


def score_candidates(gated: DataFrame) -> DataFrame:
    """Adds `score`: significance (the `weight` of an appraised row) weighted by how centred the object is."""
    weight = F.col("weight") if "weight" in gated.columns else kinds.significance(
        F.col("catalog_ids"), F.col("size_major"), F.col("common_name"), F.col("mag"))
    return gated.withColumn("score", weight * geo.center_factor(F.col("px"), F.col("py"), F.col("width"), F.col("height")))


def rank_candidates(gated: DataFrame, tie: tuple[str, ...] = TIE) -> DataFrame:
    """Adds `rank` within a frame by score, then input order."""
    scored = gated if "score" in gated.columns else score_candidates(gated)
    w = Window.partitionBy("fid").orderBy(F.desc("score"), *tie)
    return scored.withColumn("rank", F.row_number().over(w))


def _noted(star_mag_max: float, nebula_min: float, galaxy_min: float) -> Column:
    recognizable = names.has_recognizable_name(
        F.col("main_id"), F.col("names"), F.col("catalog_ids"), F.col("curated")
    )
    return kinds.is_prominent(
        F.col("category"), F.col("catalog_ids"), F.col("size_major"), F.col("mag"), recognizable,
        star_mag_max, nebula_min, galaxy_min,
    )


def is_shown(gated: DataFrame, star_mag_max: float = 4.0, nebula_min: float = 8.0, galaxy_min: float = 3.0) -> Column:
    """Whether a candidate is prominent (`noted` of an appraised row) and, where its brightness in the picture is known, visible."""
    ok = F.col("noted") if "noted" in gated.columns else _noted(star_mag_max, nebula_min, galaxy_min)
    if "lum" in gated.columns:
        ok = ok & kinds.is_visible(F.col("category"), F.col("curated"), F.col("lum"), F.col("background"))
    return ok


def prominent(gated: DataFrame, star_mag_max: float = 4.0, nebula_min: float = 8.0, galaxy_min: float = 3.0) -> DataFrame:
    return gated.where(is_shown(gated, star_mag_max, nebula_min, galaxy_min))


def _kind_order() -> Column:
    return F.when(F.col("kind") == "star", F.coalesce("mag", F.lit(99.0))).otherwise(-F.col("score"))


def top_per_kind(gated: DataFrame, caps: dict[str, int] | None = None, tie: tuple[str, ...] = TIE) -> DataFrame:
    """The best few of each kind per frame: stars by magnitude, the rest by score.

    The literal bound lets the optimizer keep only that many rows per group before the shuffle.
    """
    caps = caps or CAPS
    scored = gated if "score" in gated.columns else score_candidates(gated)
    scored = scored.withColumn("kind", kinds.kind_of(F.col("category")))
    w = Window.partitionBy("fid", "kind").orderBy(_kind_order(), *tie)
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("kind"))
    return (
        scored.withColumn("kind_rank", F.row_number().over(w))
        .where((F.col("kind_rank") <= max(caps.values())) & (F.col("kind_rank") <= cap))
    )


def _bubbles(selected: DataFrame) -> DataFrame:
    return selected.where((F.col("category") == "emission_nebula") & F.col("size_major").isNotNull() & names.is_wind_bubble(F.col("names")))


def bubble_star(selected: DataFrame, gated: DataFrame, key: str = "obj_id", tie: tuple[str, ...] = TIE) -> DataFrame:
    """For each selected wind bubble, the nearest exciting star inside it not yet selected.

    Bubbles of a frame choose in rank order; a star is given once. The k-th bubble finds at most
    k - 1 of its stars taken, so its k nearest always suffice.
    """
    bubbles = _bubbles(selected).select("fid", F.col("rank").alias("_neb"), F.col("ra_deg").alias("_ra"), F.col("dec_deg").alias("_dec"),
             (F.col("size_major") / 120.0).alias("_r"))
    bubbles = bubbles.withColumn("_turn", F.row_number().over(Window.partitionBy("fid").orderBy("_neb")))
    stars = gated.where(names.is_exciting_star(F.col("otype"))).join(
        selected.select("fid", key), ["fid", key], "left_anti"
    )
    sep = geo.ang_sep_deg(F.col("_ra"), F.col("_dec"), F.col("ra_deg"), F.col("dec_deg"))
    near = stars.join(bubbles, "fid").withColumn("_sep", sep).where(F.col("_sep") < F.col("_r"))
    w = Window.partitionBy("fid", "_neb").orderBy("_sep", *tie)
    near = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("_turn"))
    lists = near.groupBy("fid", "_neb").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", key))), lambda x: x[key]).alias("_stars")
    ).groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("_neb", "_stars"))).alias("_all"))
    taken = F.aggregate(
        F.col("_all"), F.array().cast("array<bigint>"),
        lambda acc, b: F.concat(acc, F.array_compact(F.array(F.try_element_at(
            F.filter(b["_stars"], lambda s: ~F.array_contains(acc, s)), F.lit(1))))),
    )
    chosen = lists.select("fid", F.explode(taken).alias(key))
    return stars.join(chosen, ["fid", key], "left_semi")


class Selectable(Pick):
    """Pairs that `select_objects` may pick of an appraised catalogue's, found without forming the rest.

    An object's score is at most its weight. Each route of the selection reads its objects in the order of what they can score at best and stops
    when nothing that follows can reach the places it fills; where the sky is crowded that is a small part. What is close to the limit of a gate or a place is left to
    the exact steps that follow. Margin and cover are those of the gate, bounds and caps those of the selection.
    """

    START, TOGETHER = 512, 4096

    def __init__(self, margin: float = 0.05, min_cover: float = 0.5, caps: dict[str, int] | None = None):
        self.margin, self.min_cover, self.caps = margin, min_cover, caps or CAPS

    def late(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_sort": kinds.kind_of(F.col("category")), "_bubble": F.coalesce(
            (F.col("category") == "emission_nebula") & F.col("size_major").isNotNull() & names.is_wind_bubble(F.col("names")), F.lit(False)),
            "_exciting": F.coalesce(names.is_exciting_star(F.col("otype")), F.lit(False))})

    def pairs(self, looks: Looks, frames: dict[str, pa.Array], rows: dict[str, pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        plain = lambda t, c: t[c].to_numpy(zero_copy_only=False).astype(float)
        flag = lambda c: pc.fill_null(rows[c], False).to_numpy(False)
        weight, mag = plain(rows, "weight"), plain(rows, "mag")
        unweighed, no_mag = ~rows["weight"].is_valid().to_numpy(False), ~rows["mag"].is_valid().to_numpy(False)
        # Below zero, a weight is not the most that its row can score. By descending scores NaN comes first and null last, by the negated ones of a kind the other way.
        nan = np.isnan(weight) & ~unweighed
        most = np.where(weight >= 0, weight, np.inf)
        best_of_kind, best_of_all = (np.where(unweighed, null, np.where(nan, -null, most)) for null in (np.inf, -np.inf))
        light = np.where(no_mag, -99.0, np.where(np.isnan(mag), -np.inf, -mag))
        noted, sorts = flag("noted"), pc.dictionary_encode(rows["_sort"])
        code, label = sorts.indices.to_numpy(zero_copy_only=False), sorts.dictionary.to_pylist()
        routes = [(np.flatnonzero(noted & (code == k)), light if name == "star" else best_of_kind, self.caps.get(name, 0), name == "star") for k, name in enumerate(label)]
        routes.append((np.arange(len(most)), best_of_all, 1, False))
        routes = [(at[np.argsort(-best[at], kind="stable")], best, cap, exact) for at, best, cap, exact in routes if cap > 0]
        every = [np.flatnonzero(flag("curated")), np.flatnonzero(flag("_bubble")), np.flatnonzero(flag("_exciting"))]
        judge = self._judge(looks, frames, rows, weight)
        turn = np.argsort(looks.dec0, kind="stable")
        for a in range(0, len(turn), self.TOGETHER):
            some, found = turn[a:a + self.TOGETHER], []
            for order, best, cap, exact in routes:
                found += self._route(looks, judge, some, order, best, cap, exact)
            found += [(f, s) for f, s in looks.near(some, every[0])]
            held = [np.unique(f) for f, _ in looks.near(some, every[1])]  # frames that may hold a bubble
            if held:
                found += [(f, s) for f, s in looks.near(np.unique(np.concatenate(held)), every[2])]
            keys = np.unique(np.concatenate([f.astype(np.int64) * len(most) + s for f, s in found] or [np.zeros(0, np.int64)]))
            if len(keys):
                yield keys // len(most), keys % len(most)

    def _route(self, looks: Looks, judge, some: np.ndarray, order: np.ndarray, best: np.ndarray, cap: int, exact: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs that may be among the first `cap` of a route in their frame."""
        found, left, m = [], some, self.START
        while len(left) and len(order):
            rows = order[:m]
            after = best[order[m]] if m < len(order) else -np.inf
            more = []
            n = max(1, looks.most // len(rows))
            for at in range(0, len(left), n):
                part = left[at:at + n]
                for f, s in looks.near(part, rows):
                    maybe, sure, score = judge(f, s)
                    value = np.where(exact | np.isnan(score), best[s], score)
                    at_least = np.full(len(looks.r), -np.inf)
                    g, v = f[sure], value[sure]
                    by = np.lexsort((-v, g))
                    g, v = g[by], v[by]
                    heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
                    last = heads + cap - 1
                    ok = np.flatnonzero(last < np.r_[heads[1:], len(g)])
                    at_least[g[heads[ok]]] = v[last[ok]]
                    # What rounding could hide is kept.
                    at_least = np.where(np.isfinite(at_least), at_least - 1e-6 * np.maximum(1.0, np.abs(at_least)), at_least)
                    done = (at_least > after) | (m >= len(order))
                    keep = maybe & done[f] & (value >= at_least[f])
                    found.append((f[keep], s[keep]))
                    more.append(part[~done[part]])
            left, m = np.concatenate(more) if more else left[:0], m * 4
        return found

    def _judge(self, looks: Looks, frames: dict[str, pa.Array], rows: dict[str, pa.Array], weight: np.ndarray):
        """(may pass the gate, surely passes it, score) of pairs; the formulas of world_to_pixel, disc_frame_coverage and center_factor."""
        plain = lambda t, c: t[c].to_numpy(zero_copy_only=False).astype(float)
        cx, cy, scale, turned, parity, w, h = (plain(frames, c) for c in ("crpix_x", "crpix_y", "scale_deg", "orientation_deg", "parity", "width", "height"))
        sin_th, cos_th, size = np.sin(np.radians(turned)), np.cos(np.radians(turned)), plain(rows, "size_major")
        unsized = ~rows["size_major"].is_valid().to_numpy(False)
        odd = np.isnan(size) & ~unsized
        tiny = 1e-6

        def judge(f: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            with np.errstate(all="ignore"):
                dra = np.radians(looks.ra[s] - looks.ra0[f])
                depth = looks.sin0[f] * looks.sin[s] + looks.cos0[f] * looks.cos[s] * np.cos(dra)
                rad = np.radians(scale[f])
                xi = looks.cos[s] * np.sin(dra) / depth / rad
                eta = (looks.cos0[f] * looks.sin[s] - looks.sin0[f] * looks.cos[s] * np.cos(dra)) / depth / rad
                px = cx[f] + parity[f] * (cos_th[f] * xi + sin_th[f] * eta)
                py = cy[f] - (cos_th[f] * eta - sin_th[f] * xi)
                wide, high = w[f], h[f]
                edge = self.margin * np.maximum(wide, high)
                # Pixels to the nearest side of the frame and its margin.
                inside = np.minimum(np.minimum(px, wide - px), np.minimum(py, high - py)) + edge
                r = size[s] / 2.0 / (scale[f] * 60.0)
                cover = (np.maximum(0.0, np.minimum(px + r, wide) - np.maximum(px - r, 0.0)) * np.maximum(0.0, np.minimum(py + r, high) - np.maximum(py - r, 0.0)) / (4.0 * r * r)) - self.min_cover
                centre = r - np.maximum(np.abs(px - wide / 2.0), np.abs(py - high / 2.0))
                sure = (depth > tiny) & (inside > tiny) & (unsized[s] | (r <= 1.0 - tiny) | (cover > tiny) | (centre > tiny))
                maybe = (depth > -tiny) & (inside > -tiny) & (unsized[s] | odd[s] | (r <= 1.0 + tiny) | (cover > -tiny) | (centre > -tiny))
                out = np.maximum(np.abs(px - wide / 2.0) / (wide / 2.0), np.abs(py - high / 2.0) / (high / 2.0))
                score = weight[s] * (1.0 - 0.4 * np.maximum(0.0, (out - 0.5) / 0.5))
            return maybe, sure, score

        return judge


def shortlist(gated: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Candidates that `select_objects` may pick, cut where they arise: of each run of rows of one frame those that could fill a place, ties, landmarks and exciting stars.

    Where a frame's rows come one after another few of them remain. A frame that comes in several runs keeps more, never less.
    """
    caps, columns = caps or CAPS, gated.columns
    scored = score_candidates(gated).withColumn("kind", kinds.kind_of(F.col("category")))
    always = F.coalesce(F.col("curated") | names.is_exciting_star(F.col("otype")), F.lit(False))
    marked = pin(scored, _place=_kind_order(), _score=F.col("score"), _shown=F.coalesce(is_shown(scored), F.lit(False)), _always=always)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fid = pc.dictionary_encode(batch.column("fid"), null_encoding="encode").indices.to_numpy()
            part = np.cumsum(np.r_[0, fid[1:] != fid[:-1]])[:batch.num_rows]
            keep = batch.column("_always").to_numpy(zero_copy_only=False).astype(bool)
            # Ascending places with nulls first and NaN last; descending scores the other way.
            for column, sign, good, cap in [("_score", -1.0, None, 1), *[("_place", 1.0, k, n) for k, n in caps.items() if n > 0]]:
                v = batch.column(column)
                value = sign * v.to_numpy(zero_copy_only=False).astype(float)
                value = np.where(~v.is_valid().to_numpy(False), -sign * np.inf, np.where(np.isnan(value), sign * np.inf, value))
                at = np.arange(len(part)) if good is None else np.flatnonzero(
                    batch.column("_shown").to_numpy(zero_copy_only=False).astype(bool) & pc.equal(batch.column("kind"), good).to_numpy(False))
                by = at[np.lexsort((value[at], part[at]))]
                g, x = part[by], value[by]
                heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[:len(g)]
                size = np.diff(np.r_[heads, len(g)])
                limit = x[heads + np.minimum(cap, size) - 1] if len(g) else x
                keep[by[x <= np.repeat(limit, size)]] = True
            if keep.any():
                yield batch.filter(pa.array(keep)).select(columns)

    out = ", ".join(f"`{c}` {t}" for c, t in gated.dtypes)
    return marked.mapInArrow(run, out)


def select_objects(
    gated: DataFrame, star_mag_max: float = 4.0, nebula_min: float = 8.0, galaxy_min: float = 3.0,
    caps: dict[str, int] | None = None, top_n: int = 6, tie: tuple[str, ...] = TIE, key: str = "obj_id",
    few: bool = False,
) -> DataFrame:
    """The annotated objects of each frame with their final `rank`.

    Best of each kind, plus the best-composed object, cut to `top_n`; curated landmarks and
    a wind bubble's exciting star are added after the cut. Candidates that are `few` (those of a `Selectable` search) are read once, ranked by
    every route together.
    """
    scored = score_candidates(gated)
    group = F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv]), F.col("kind"))
    if few:
        shown = F.coalesce(is_shown(scored, star_mag_max, nebula_min, galaxy_min), F.lit(False))
        rows = scored.withColumn("kind", kinds.kind_of(F.col("category"))).withColumn("_shown", shown)
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("fid", "kind", "_shown").orderBy(_kind_order(), *tie)))
        rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy("fid").orderBy(F.desc("score"), *tie)))
        cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in (caps or CAPS).items() for x in kv]), F.col("kind"))
        route = lambda good, g, k: F.when(good, F.struct(g.cast("int").alias("_g"), k.cast("int").alias("_k")))
        routes = F.array_compact(F.array(
            route(F.col("_shown") & (F.col("_k") <= cap), group, F.col("_k")), route(F.col("_t") == 1, F.lit(9), F.lit(1)), route(F.col("curated"), F.lit(10), F.lit(1))))
        pool = rows.select(*scored.columns, F.inline(routes))
    else:
        # Each route cuts the candidates to a few rows of a frame where they arise, before any shuffle.
        best = top_per_kind(prominent(scored, star_mag_max, nebula_min, galaxy_min), caps, tie)
        best = best.withColumn("_g", group).select(*scored.columns, "_g", F.col("kind_rank").alias("_k"))
        top = first_hit(scored, ["fid"], [F.desc("score"), *tie], F.lit(True)).select(*scored.columns, F.lit(9).alias("_g"), F.lit(1).alias("_k"))
        landmarks = scored.where("curated").withColumn("_g", F.lit(10)).withColumn("_k", F.lit(1))
        pool = best.unionByName(top).unionByName(landmarks)
    # A few rows per frame from here on. A row's first route decides its place.
    once = Window.partitionBy("fid", key).orderBy("_g")
    pool = pool.withColumn("_once", F.row_number().over(once)).where("_once = 1")
    pool = pool.withColumn("_cut", F.row_number().over(
        Window.partitionBy("fid", F.col("_g") < 10).orderBy(F.desc("score"), "_g", "_k")))
    pool = pool.withColumn("_late", (F.col("_g") >= 10) | (F.col("_cut") > top_n)).where(~F.col("_late") | F.col("curated"))
    late = Window.partitionBy("fid", "_late").orderBy(*tie)
    chosen = cut_lineage(pool.withColumn(
        "rank", F.when(F.col("_late"), 100 + F.row_number().over(late)).otherwise(F.col("_cut"))
    ).drop("_g", "_k", "_once", "_cut", "_late"))
    ranked = Window.partitionBy("fid").orderBy("rank")
    bubbles = cut_lineage(_bubbles(chosen).select("fid").distinct())
    if bubbles.isEmpty():
        return chosen.withColumn("rank", F.row_number().over(ranked))
    # Only frames with a bubble look for its star.
    stars = bubble_star(chosen, scored.where(names.is_exciting_star(F.col("otype"))).join(bubbles, "fid", "left_semi"), key, tie)
    after = Window.partitionBy("fid").orderBy(*tie)
    stars = stars.withColumn("rank", F.lit(100_000) + F.row_number().over(after))
    out = chosen.unionByName(stars.select(*chosen.columns))
    return out.withColumn("rank", F.row_number().over(ranked))


def first_hit(df: DataFrame, part: list[str], order: list, pred: Column) -> DataFrame:
    """First row of each group, in rank order, that satisfies a predicate."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.where(pred).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 1).drop("_n")


def dedup_by_key(df: DataFrame, by: tuple[str, ...] = ("fid",), tie: tuple[str, ...] = TIE) -> DataFrame:
    """Keep the first row per main id (or position when blank) in query order."""
    blank = F.coalesce(F.col("main_id"), F.lit("")) == ""
    place = F.concat_ws(",", "ra_deg", "dec_deg")
    keyed = df.withColumn("_key", F.when(blank, place).otherwise(F.col("main_id")))
    return first_hit(keyed, [*by, "_key"], list(tie), F.lit(True)).drop("_key")


def sized_objects_topn(cone: DataFrame, n: int | None = None, tie: tuple[str, ...] = TIE) -> DataFrame:
    """The sized objects of each frame's cone by size; only the n largest where n is given."""
    w = Window.partitionBy("fid").orderBy(F.desc("size_major"), *tie)
    ranked = cone.where(F.col("size_major").isNotNull()).withColumn("size_rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("size_rank") <= n)


def capped_fetch(cone: DataFrame, part: list[str], order: list, n: int | None = None) -> DataFrame:
    """Rows of a cone query ranked within their group in a stated order; at most n of each where n is given."""
    w = Window.partitionBy(*part).orderBy(*order)
    ranked = cone.withColumn("fetch_rank", F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col("fetch_rank") <= n)


def fluxes_join(
    basic: DataFrame, fluxes: DataFrame, ident: DataFrame, frames: DataFrame, star_mag_max: float = 6.0,
    curated_ids=tuple(NICKNAMES), limits: tuple[int | None, ...] = (None, None, None, None),
) -> DataFrame:
    """The four sub-queries of a catalogue cone (sized, bright, exciting, curated), merged in order, with proper names.

    basic(oid, main_id, otype, ra_deg, dec_deg, size_major, size_minor), fluxes(oid, v_mag), ident(oid, id, id_ord). Fluxes, names
    and the curated mark are joined to the catalogue once per object, before the cone; the sub-queries are conditions of one pass
    over it. A row belongs to the first sub-query it meets. `limits` cuts a sub-query to so many rows per frame, as a remote service
    would; nothing is cut unless asked.
    """
    from firmament.operators.spatial import cone_search_join

    by_id = ident.groupBy("oid").agg(
        F.max(F.col("id").isin(*curated_ids)).alias("_cur"),
        F.min_by(F.when(F.col("id").like("NAME %"), F.trim(F.regexp_replace("id", r"^NAME\s+", ""))),
                 F.when(F.col("id").like("NAME %"), F.col("id_ord"))).alias("proper_name"))
    rows = cone_search_join(frames, basic.join(fluxes, "oid", "left").join(by_id, "oid", "left"))
    sub = [
        (F.col("size_major").isNotNull(), [F.desc("size_major"), "oid"]),
        (F.col("v_mag") < star_mag_max, ["v_mag", "oid"]),
        (names.is_exciting_star(F.col("otype")), [F.col("v_mag").asc_nulls_last(), "oid"]),
        (F.col("_cur"), ["oid"]),
    ]
    met = []
    for i, ((pred, order), n) in enumerate(zip(sub, limits)):
        inside = F.coalesce(pred, F.lit(False))
        if n is not None:
            rows = rows.withColumn(f"_in{i}", inside)
            place = F.row_number().over(Window.partitionBy("fid", f"_in{i}").orderBy(*order))
            rows = rows.withColumn(f"_at{i}", place)
            inside = F.col(f"_in{i}") & (F.col(f"_at{i}") <= n)
        met.append(F.when(inside, F.lit(i)))
    rows = rows.withColumn("query", F.coalesce(*met)).where(F.col("query").isNotNull())
    rows = rows.withColumn("mag", F.when(F.col("query") > 0, F.col("v_mag")))
    return rows.drop("_cur", "v_mag", *[f"_{k}{i}" for i in range(4) for k in ("in", "at")])
