"""Cross-entropy difference scoring with two matched bigram models.

A target model (labelled good documents) and a background model (all documents) share one vocabulary, order and smoothing; a
document's score is its per-token loss under the target model less that under the background model (lower: more like the target).

Counts cover every token of every document, and every word and every bigram keeps its counts, however rare and at any corpus size:
P(w|h) = (c(h,w) + a P(w)) / (c(h) + a), with P(w) from add-one counts of words. No model is held or sent whole. `score_all` cuts the
documents into chunks of some 1.5 `held` words and writes each once, as numbers into its word list. A chunk sends the sorted hashed keys of its
distinct words and bigrams with their counts, by key range. Ranges are summed over the chunks and answer each chunk's keys with the
totals of both corpora; a chunk then sums the log probabilities of its documents. A key travels once a chunk, so a frequent one is no
hot task, and what a task holds is a chunk or a range; ranges follow spark.sql.shuffle.partitions.

A target document's own counts are taken out of the target model before it is scored (its chunk knows them), so it is judged, as any
other document, by what the target documents beside it say; copies of it among them still count. The background model holds every document.

Target ids meet their texts in a join behind a bitmap filter, so only (nearly) target texts are shuffled; they are then cut and counted once, for
both models. Null and empty texts
have no tokens and a null score. With no target rows the target model is uniform over the vocabulary. Repeated rows count
and score each; a label repeated for a document counts once, and good only if all its labels are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import _deltas, _undelta, marked, marks, merge_counts, mix, slices, table, words, write_table
from firmament.llm.registry import query

_PAIR = np.uint64(0xA24BAED4963EE407)
_START, _END = (np.uint64(x) for x in (0x8D51C3A07F2E9B46, 0x3B9F60E7D214A5C8))  # stand for start and end in bigram keys


_CODEC = pa.Codec("zstd", compression_level=1)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes: high bytes are mostly zero."""
    raw = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True) if raw else b""


def _unplane(b: bytes, kind: type) -> np.ndarray:
    raw = _CODEC.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) if b else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass(frozen=True)
class Chunk:
    """The words of some documents: numbers into the sorted word keys, and the words of every document."""
    names: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray

    def events(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys, counts, histories, words, place of the bigram, bigram of every event, first events).

        Keys of words are even and those of bigrams odd. Histories and words of bigrams are numbers + 2; 0 is the start and 1 the end.
        """
        n = self.sizes[self.sizes > 0]
        ids = np.insert(self.numbers.astype(np.int64) + 2, np.cumsum(n), 1)
        first = np.cumsum(n + 1) - n - 1
        history = np.empty_like(ids)
        history[1:] = ids[:-1]
        history[first] = 0
        size = len(self.names) + 2
        pairs, event, times = np.unique(history * size + ids, return_inverse=True, return_counts=True)
        h, w = pairs // size, pairs % size
        named = np.concatenate(([_START, _END], self.names))
        keys = np.concatenate((self.names, mix(named[h] * _PAIR + named[w]) | np.uint64(1)))
        counts = np.concatenate((np.bincount(self.numbers, minlength=len(self.names)), times)).astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], counts[order], h, w, place, event, first


BLOCK = 1 << 17  # events of a chunk that are scored at a time; a longer document is one block
SCORED, TARGET, BOTH = 0, 1, 2  # rows of `docs` alone, of `target` alone, and rows of `docs` that are target documents


def score_all(docs: DataFrame, target: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", strength: float = 64.0,
              held: int = 1 << 20, target_col: str | None = None) -> DataFrame:
    """id, n_tokens, loss_target, loss_background (nats per token), loss_difference of every row, under whole models of both.

    Target documents are the rows of `docs` whose `target_col` is true, which are cut and counted once for both models, or the texts of
    `target`, which need not be among `docs`; only the former are scored without their own counts.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    kind = id_type.simpleString()
    corpus = F.when(F.col(target_col), BOTH).otherwise(SCORED) if target_col else F.lit(SCORED)
    both = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), corpus.alias("corpus"))
    if target is not None:
        both = both.unionByName(target.select(F.lit(None).cast(id_type).alias("id"), F.col(text_col).alias("text"), F.lit(TARGET).alias("corpus")))
    shards = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    def cut(corpus: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        hashes, bounds = words(table.column("text").combine_chunks())
        n = np.diff(bounds)
        names, numbers = np.unique(hashes & ~np.uint64(1), return_inverse=True)
        ids = table.column("id").combine_chunks() if corpus != TARGET else table.column("id").combine_chunks()[:0]
        return pa.RecordBatch.from_arrays([
            pa.array([uuid.uuid4().int >> 65]), pa.array([corpus], pa.int32()), pa.array([int(n.sum())]), pa.array([int((n > 0).sum())]),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([_planes(n.astype(np.uint64))], pa.binary()),
            pa.array([_deltas(names)], pa.binary()), pa.array([_planes(numbers.astype(np.uint32))], pa.binary())],
            ["chunk", "corpus", "n_words", "n_filled", "ids", "sizes", "names", "numbers"])

    def ranges(keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """(number, start, end) of every key range that the sorted keys touch."""
        shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), shard[1:] != shard[:-1])))
        return shard[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {SCORED: [], TARGET: [], BOTH: []}
        size = dict.fromkeys(waiting, 0)
        for part in slices(batches, text=1):
            for corpus in part.column(2).unique().to_pylist():
                own = part.filter(pc.equal(part.column(2), corpus))
                waiting[corpus].append(own)
                size[corpus] += own.column(1).nbytes
                if size[corpus] >= 9 * held:
                    yield cut(corpus, waiting[corpus])
                    waiting[corpus], size[corpus] = [], 0
        for corpus, parts in waiting.items():
            if parts:
                yield cut(corpus, parts)

    written = write_table(both.mapInArrow(chunks, f"chunk long, corpus int, n_words long, n_filled long, ids array<{kind}>, sizes binary, "
                                                  "names binary, numbers binary"))

    def word_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0):
                names = _undelta(b.as_py())
                shard, at, to = ranges(names)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([_deltas(names[x:y]) for x, y in zip(at, to)], pa.binary())],
                                                 ["shard", "names"])

    def distinct_words(group: pa.Table) -> pa.Table:
        return pa.table({"n": [len(np.unique(np.concatenate([_undelta(b) for b in group.column("names").to_pylist()])))]})

    distinct = written.select("names").mapInArrow(word_ranges, "shard int, names binary").groupBy("shard").applyInArrow(
        distinct_words, "n long").agg(F.sum("n")).first()[0] or 0
    sums = {r.corpus: r for r in written.groupBy("corpus").agg(F.sum("n_words").alias("n"), F.sum("n_filled").alias("d")).collect()}
    n_words, n_docs = (np.array([float(sum(sums[c][k] for c in own if c in sums)) for own in ((TARGET, BOTH), (SCORED, BOTH))]) for k in ("n", "d"))
    everything = n_words + n_docs + distinct + 3  # unknown, start and end are in the vocabulary

    def chunk_of(row: dict) -> Chunk:
        return Chunk(_undelta(row["names"]), _unplane(row["numbers"], np.uint32), _unplane(row["sizes"], np.uint64).astype(np.int64))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                keys, counts, *_ = chunk_of(row).events()
                shard, at, to = ranges(keys)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["chunk"]] * len(at), pa.int64()), pa.array([row["corpus"]] * len(at), pa.int32()), pa.array(shard, pa.int32()),
                    pa.array([_deltas(keys[x:y]) for x, y in zip(at, to)], pa.binary()),
                    pa.array([_planes(counts[x:y]) for x, y in zip(at, to)], pa.binary())], ["chunk", "corpus", "shard", "keys", "counts"])

    asked = written.select("chunk", "corpus", "sizes", "names", "numbers").mapInArrow(ask, "chunk long, corpus int, shard int, keys binary, counts binary")

    def answer(group: pa.Table) -> pa.Table:
        """The totals of a range for each chunk of documents, in the order of the chunk's keys."""
        rows = list(zip(*(group.column(c).to_pylist() for c in ("chunk", "corpus", "keys", "counts"))))
        keys = [_undelta(k) for *_, k, _ in rows]
        corpora = np.repeat([c for _, c, *_ in rows], [len(k) for k in keys])
        said = np.concatenate([_unplane(c, np.uint64) for *_, c in rows])
        counts = np.stack([np.where(corpora != SCORED, said, 0), np.where(corpora != TARGET, said, 0)], axis=1).astype(np.uint64)
        known, totals = merge_counts(np.concatenate(keys), counts)
        wanted = [(c, k) for (c, corpus, *_), k in zip(rows, keys) if corpus != TARGET]
        return pa.table({"chunk": pa.array([c for c, _ in wanted], pa.int64()), "shard": pa.array([group.column("shard")[0].as_py()] * len(wanted), pa.int32()),
                         "totals": pa.array([_planes(totals[np.searchsorted(known, k)].T.ravel()) for _, k in wanted], pa.binary())})

    replies = asked.groupBy("shard").applyInArrow(answer, "chunk long, shard int, totals binary")

    def own(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How often each x is said in its document."""
        _, at, times = np.unique(doc * (int(x.max()) + 1) + x, return_inverse=True, return_counts=True)
        return times[at]

    def judge(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        chunk = chunk_of(group.select(["sizes", "names", "numbers"]).slice(0, 1).to_pylist()[0])
        _, _, h, w, place, event, first = chunk.events()
        totals = [_unplane(b, np.uint64).reshape(2, -1).T for b in group.column("totals").to_pylist()[1:]]
        totals = np.concatenate([np.zeros((0, 2), np.uint64), *totals]).astype(float)[place]
        said = np.concatenate([[n_docs, n_docs], totals[:len(chunk.names)]])
        log = np.log((totals[len(chunk.names):] + strength * (said[w] + 1) / everything) / (said[h] + strength))
        n = chunk.sizes
        filled = n > 0
        loss = np.full((len(n), 2), np.nan)
        sizes, whole = n[filled] + 1, np.full((int(filled.sum()), 2), np.nan)
        last = np.cumsum(sizes)
        starts = np.flatnonzero(np.diff((last - 1) // BLOCK, prepend=-1))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(sizes)]):  # a block of documents, so that what is held beside the chunk is small
            e = event[first[i]:last[j - 1]]
            said_here = log[e]
            if group.column("corpus")[0].as_py() == BOTH:
                doc, hist, word = np.repeat(np.arange(j - i), sizes[i:j]), h[e], w[e]
                p = (said[word, 0] - own(doc, word) + 1) / (everything[0] - sizes[i:j][doc])
                said_here[:, 0] = np.log((totals[len(chunk.names) + e, 0] - own(doc, e) + strength * p) / (said[hist, 0] - own(doc, hist) + strength))
            whole[i:j] = -np.add.reduceat(said_here, first[i:j] - first[i], axis=0) / sizes[i:j, None]
        loss[filled] = whole
        t, b = loss[:, 0], loss[:, 1]
        ids = group.column("ids").combine_chunks().slice(0, 1).flatten()
        return pa.table([ids, pa.array(n), *(pa.array(x, mask=~filled) for x in (t, b, t - b))],
                        [id_col, "n_tokens", "loss_target", "loss_background", "loss_difference"])

    bodies = written.where(F.col("corpus") != TARGET).select("chunk", F.lit(-1).alias("shard"), F.lit(None).cast("binary").alias("totals"), "corpus", "ids", "sizes", "names", "numbers")
    replies = replies.select("chunk", "shard", "totals", F.lit(None).cast("int").alias("corpus"), F.lit(None).cast(f"array<{kind}>").alias("ids"),
                             *(F.lit(None).cast("binary").alias(c) for c in ("sizes", "names", "numbers")))
    return bodies.unionByName(replies).groupBy("chunk").applyInArrow(
        judge, f"`{id_col}` {kind}, n_tokens long, loss_target double, loss_background double, loss_difference double")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts whose id is among `ids`. A bitmap filter goes before the join: other texts are not shuffled.

    Both sides are sorted and merged at every size, so that cost grows evenly with the input.
    """
    wanted = ids.select(id_col).distinct()
    near = marked(docs.select(id_col, text_col), F.col(id_col), marks(wanted, F.col(id_col)))
    return near.where("_maybe").drop("_maybe").join(wanted.hint("merge"), id_col, "left_semi")


def flagged(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag: str = "_target") -> DataFrame:
    """id, text and whether the id is among `ids`. Texts that the bitmap rules out are not shuffled; as in `texts_of`, the rest is merged."""
    wanted = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    near = marked(docs.select(id_col, text_col), F.col(id_col), marks(wanted, F.col(id_col)))
    out = near.where("not _maybe").select(id_col, text_col, F.lit(False).alias(flag))
    told = near.where("_maybe").select(id_col, text_col).join(wanted.withColumn(flag, F.lit(True)).hint("merge"), id_col, "left")
    return out.unionByName(told.select(id_col, text_col, F.coalesce(flag, F.lit(False)).alias(flag)))


@query("op5_lm_scoring")
def op5_lm_scoring(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 and coalesce(x, 0) = 0")
    return score_all(flagged(docs, good), target_col="_target")
