"""Self-join of documents on the Jaccard similarity of their word shingles, by T-occurrence search with DivideSkip.

Two sets of n and m shingles are similar at 3/4 when they share at least T = ceil(3 (n + m) / 7). Every document looks for the
others in the inverted lists of its shingles. DivideSkip sets the longest lists aside: of the n lists of a document only the
n - ceil(3 n / 4) + 1 shortest are merged, as any partner must occur in one of these; partners met are kept while the
positions still allow T, and the lists set aside are then probed by binary search in the partner's sorted set.

In Spark:

1. `profiles`: one scan gives each document's set size and a 128-bit digest of its set. Equal sets become one class with its least
   id; only classes are joined.
2. `list_lengths`: one scan counts the documents of every shingle (packed key counts). Two bitmaps of fixed size come of it: the shingles
   of two documents or more, and the order of magnitude of long lists. Bits shared by chance only lengthen some lists.
3. `short_lists` picks every class's lists to merge. Star links: classes that share a shingle minimum are compared, exactly, with the
   most central of them, and carry its label if linked, so a large group of near copies is one label instead of all its pairs. This only
   saves work: step 4 misses no link between labels.
4. Short lists travel to ranges of shingle hashes and are merged there: pairs of different labels that pass size and positions
   come out with their occurrences. No pair within a label, of equal sets, or from a list that was set aside is ever formed.
5. Candidates are verified on whole sets; components of all links (reliable checkpoints each round) name the groups.

Sets travel as sorted 64-bit hashes; within a pair of sets a chance collision has odds of n m / 2**64. No cap on lists, partners or
candidates. A list whose documents mostly carry other labels costs its square in comparisons in one range; that takes many documents
made of the same few passages whose rest is too small to tell them apart, yet dissimilar.

Empty and null texts have an empty set, n_shingles 0 and no link. A text of fewer words than the shingle width is one shingle.
Rows that repeat an id are one node: each row is returned, and links of any of its texts count. Rows without id link to nothing
and have a null component. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import key_counts, marked, marks, mix, packed, shingle_sets, slices, table
from firmament.llm.registry import query
from firmament.operators.spatial import connected_components
from firmament.session import cut_lineage

KEY_BITS = 40      # bits of a shingle hash that name its inverted list
LONG = 16          # documents from which a list's order of magnitude is kept
FILTER_BITS = 26   # bitmap of the shingles of two documents or more
CELL_BITS = 22     # cells for the lengths of long lists


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n with any similar set."""
    return -(-3 * n // 4)


def overlap(n, m):
    """T of two sets: 100 I >= 75 (n + m - I)."""
    return -(-3 * (n + m) // 7)


def _digest(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=np.uint64).view(np.int64))


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def profiles(src: DataFrame, width: int) -> DataFrame:
    """id, set size n and two digest words of the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, d1, d2 = [], [], []
            for s in shingle_sets(part.column(1), width):
                n.append(len(s))
                d1.append(_digest(s))
                d2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n, d1, d2))], ["id", "n", "d1", "d2"])

    return src.mapInArrow(run, "id long, n long, d1 long, d2 long")


def _sets(src: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The sorted sets of (nearly only) the rows whose id is among `ids`."""
    near = marked(src, F.col("id"), marks(ids, F.col("id"))).where("_maybe").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), packed(list(shingle_sets(part.column(1), width)))], ["id", "set"])

    return near.mapInArrow(run, "id long, set binary")


def _verify(pairs: DataFrame, src: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) that are similar, by binary probes of one set in the other."""
    sets = _sets(src, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width)
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(len(x) > 0 and same >= overlap(len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


def _labels(links: DataFrame) -> DataFrame:
    """(id, label): a linked class takes the label of its centre, that of the centre's own centre if there is one."""
    up = links.select(F.col("a").alias("b"), F.col("b").alias("top"))
    return links.join(up, "b", "left").select(F.col("a").alias("id"), F.coalesce("top", "b").alias("label"))


def list_lengths(src: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of the lists of two documents or more, order of magnitude of long lists by cell), both of fixed size."""
    drop = np.uint64(64 - KEY_BITS)

    def keys_of(part: pa.RecordBatch):
        sets = list(shingle_sets(part.column(1), width))
        keys = np.concatenate(sets) >> drop if sets else np.zeros(0, np.uint64)
        return keys, np.ones((len(keys), 1), np.uint32)

    def shared(keys: np.ndarray, counts: np.ndarray) -> dict:
        n = counts[:, 0]
        level = np.where(n >= LONG, np.log2(n).astype(np.uint8), 0).astype(np.uint8)
        return {"keys": packed([keys[n > 1]]), "level": packed([level[n > 1]])}

    found = cut_lineage(key_counts(src, keys_of, 1, shared, "keys binary, level binary", text=1, uniform_bits=KEY_BITS))

    def unpack(batches: Iterator[pa.RecordBatch], cells: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, v in zip(batch.column(0), batch.column(1)):
                keys, level = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint8)
                if cells:
                    keys, level = keys[level > 0] >> np.uint64(KEY_BITS - CELL_BITS), level[level > 0]
                else:
                    keys = _spot(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(level.astype(np.int32))], ["spot", "level"])

    schema = "spot long, level int"
    bits = found.mapInArrow(lambda it: unpack(it, False), schema).groupBy(F.floor(F.col("spot") / 32768).alias("bucket")).agg(
        F.expr("bitmap_construct_agg(spot % 32768)").alias("bitmap")).toArrow()  # at most 2**FILTER_BITS bits
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for bucket, b in zip(bits.column("bucket").to_pylist(), bits.column("bitmap").to_pylist()):
        bitmap[bucket * 4096:(bucket + 1) * 4096] = np.frombuffer(b, np.uint8)
    tall = found.mapInArrow(lambda it: unpack(it, True), schema).groupBy("spot").agg(F.max("level").alias("level")).toArrow()
    cells = np.zeros(1 << CELL_BITS, np.uint8)  # at most so many rows
    cells[tall.column("spot").to_numpy()] = tall.column("level").to_numpy()
    return bitmap, cells


def _spot(keys: np.ndarray) -> np.ndarray:
    return mix(keys) >> np.uint64(64 - FILTER_BITS)


def short_lists(src: DataFrame, classes: DataFrame, lengths: tuple[np.ndarray, np.ndarray], width: int, bands: int = 8) -> DataFrame:
    """Per class, the keys of its shortest lists that other documents are in, and their places among its shortest lists; own: how many
    of those no other document is in; minima: the least shingle hash of each of `bands` ranges (null where there is none)."""
    bitmap, cells = lengths
    drop = np.uint64(64 - KEY_BITS)
    if bands > 8:
        raise ValueError("at most 8 bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out, where, size, d1, own, low = [], [], [], [], [], []
            for s in shingle_sets(part.column(1), width):
                n = len(s)
                keys = s >> drop
                level = cells[keys >> np.uint64(KEY_BITS - CELL_BITS)]
                order = np.lexsort((keys, level))[:n - int(needed(n)) + 1] if n else np.zeros(0, np.int64)
                spot = _spot(keys[order])
                met = np.flatnonzero((bitmap[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1)
                out.append(keys[order[met]])
                where.append(met.astype(np.uint32))
                size.append(n)
                d1.append(_digest(s))
                own.append(len(order) - len(met))
                at = np.searchsorted(s, np.arange(bands, dtype=np.uint64) << np.uint64(61))
                low.append([int(s[a].view(np.int64)) if a < b else None for a, b in zip(at.tolist(), [*at[1:].tolist(), n])])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.int64()) for x in (size, d1, own)), pa.array(low, pa.list_(pa.int64())), packed(out), packed(where)],
                ["id", "n", "d1", "own", "minima", "keys", "at"]).filter(pa.array([len(k) > 0 for k in out], pa.bool_()))

    lists = src.mapInArrow(run, "id long, n long, d1 long, own long, minima array<long>, keys binary, at binary")
    return cut_lineage(lists.join(classes.select("id", "n", "d1"), ["id", "n", "d1"], "left_semi"))


def star_links(lists: DataFrame, src: DataFrame, width: int) -> DataFrame:
    """Verified links (a, b) of classes to a more central class b they share a shingle minimum with.

    Central is who has the fewest lists to itself: of a text and its edited copies, the text all were made from.
    """
    place = F.struct((-F.col("own") / F.col("n")).alias("rank"), "id", "n")
    keys = lists.select("id", "n", place.alias("place"), F.posexplode("minima").alias("band", "low")).where("low is not null")
    head = keys.groupBy("band", "low").agg(F.max("place").alias("head"), F.count("*").alias("c")).where("c > 1")
    met = keys.join(head, ["band", "low"]).where("head.id <> id and 4 * least(n, head.n) >= 3 * greatest(n, head.n)")
    votes = met.groupBy("id", "head").agg(F.count("*").alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", "head")).alias("m")).select(F.col("id").alias("a"), F.col("m.head.id").alias("b"))
    return cut_lineage(_verify(cut_lineage(best), src, width))


def candidates(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different labels that meet in a merged list and may reach T."""
    shards = 2 * max(1, int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = lists.join(labels, "id", "left").select("id", "n", F.coalesce("label", "id").alias("label"), "keys", "at")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=3, max_bytes=1 << 22):
            cols = [batch.column(c).to_numpy() for c in range(3)]
            keys = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(3)]
            at = [np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(4)]
            if not keys:
                continue
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            key, at = np.concatenate(keys), np.concatenate(at)
            shard = (key >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)
            order = np.argsort(shard, kind="stable")
            row, key, at, shard = row[order], key[order], at[order], shard[order]
            first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            ends = [*first[1:], len(shard)]
            made = [pa.array(shard[first].astype(np.int32)), packed([key[a:b] for a, b in zip(first, ends)]),
                    packed([at[a:b].astype(np.int64) for a, b in zip(first, ends)])]
            made += [packed([c[row[a:b]] for a, b in zip(first, ends)]) for c in cols]
            yield pa.RecordBatch.from_arrays(made, ["shard", "key", "at", "id", "n", "label"])

    def merge(group: pa.Table) -> pa.Table:
        key, at, doc, n, label = (np.concatenate([np.frombuffer(b, np.uint64 if c == "key" else np.int64) for b in group.column(c).to_pylist()])
                                  for c in ("key", "at", "id", "n", "label"))
        order = np.argsort(key, kind="stable")
        key, at, doc, n, label = key[order], at[order], doc[order], n[order], label[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(key))
        pairs: list[np.ndarray] = []
        for a, b in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist()):
            names, which, size = np.unique(label[a:b], return_inverse=True, return_counts=True)
            if len(names) == 1:
                continue
            # The largest label meets the others; it is never compared with itself.
            rank = np.argsort(np.argsort(size, kind="stable"), kind="stable")[which]
            for i in np.flatnonzero(rank < len(names) - 1).tolist():
                x = a + i
                y = a + np.flatnonzero(rank > rank[i])
                room = np.minimum(n[x] - at[x], n[y] - at[y])
                y = y[(room >= overlap(n[x], n[y])) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y]))]
                if len(y):
                    pairs.append(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])], axis=1))
        found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        found, times = np.unique(found, axis=0, return_counts=True)
        return pa.table({"a": found[:, 0], "b": found[:, 1], "met": times.astype(np.int64)})

    met = lists.mapInArrow(deal, "shard int, key binary, at binary, id binary, n binary, label binary").groupBy("shard").applyInArrow(
        merge, "a long, b long, met long")
    return met.groupBy("a", "b").agg(F.sum("met").alias("met"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable by links of similarity 3/4 or more)."""
    src = _sources(docs, id_col, text_col)
    rows = cut_lineage(profiles(src, width))
    digest = ["n", "d1", "d2"]
    full = rows.where("n > 0 and id is not null")
    classes = cut_lineage(full.groupBy(*digest).agg(F.min("id").alias("id")))
    lists = short_lists(src, classes, list_lengths(src, width), width)
    links = star_links(lists, src, width)
    pairs = candidates(lists, _labels(links))
    # A class keeps its id as node. An id that repeats with other texts ties the classes it is in together.
    more = _verify(cut_lineage(pairs.select("a", "b")), src, width)
    member = full.join(classes.select(*digest, F.col("id").alias("rep")), digest).select("id", "rep").distinct()
    edges = cut_lineage(links.unionByName(more).unionByName(member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    named = connected_components(edges).withColumnRenamed("node", "id")
    return rows.join(named, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                                                 F.coalesce("component", "id").alias("component_id"))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"))
