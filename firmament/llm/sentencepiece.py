"""SentencePiece encoding and decoding of whole corpora, giant documents by a max-plus parallel scan.

Encoding picks the segmentation into vocabulary pieces with the greatest sum of the model file's scores; a character no piece
covers falls back to its UTF-8 bytes. The space marker of the file is a plain space here, so every text decodes to itself, the
marker character included.

No piece runs on from a non-space into a space, so words (leading spaces included) are independent and each worker remembers the
best pieces of words it has met (the memory is cleared at a fixed size). Texts over `chunk` characters are split into chunks spread over
the cluster. A chunk, with a look-ahead of one piece, yields a transfer matrix: entry (i, j) is the best score of segmenting it
from i characters past its start to j past its end. Matrices combine associatively under (max, +) in a doubling scan per document,
which fixes the state at every chunk boundary; then each chunk is backtraced on its own. Only slim matrices are gathered per document.

Null and empty texts have no tokens and decode to the empty text. Of segmentations of equal score the one whose last piece is longest
wins, then its last piece but one, and so on; chunks carry that order beside their matrices, so ids do not depend on `chunk` as long as
sums of scores are exact (whole or float32 scores, sums below 2**53 of their steps). Repeated rows are encoded each; an empty table gives
an empty result; only the text and the columns asked for are read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmament.llm.common import slices, table
from firmament.llm.registry import query
from firmament.session import cut_lineage

MODEL = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
SEGMENT = re.compile(r" +[^ ]*|[^ ]+")
NONE = -np.inf


class Pieces(dict):
    """The vocabulary, and a bounded memory of words: word -> ids of its best segmentation as int32 bytes.

    The memory has two generations of at most `room` words each; a full one becomes the older, and words met again come back from it. It
    outlives a task, as the worker does.
    """

    def __init__(self, path: str, room: int = 120_000):
        import sentencepiece

        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.room, self.score, self.ids, self.scores = room, {}, {}, {}
        self.older: dict[str, bytes] = {}
        self.raw: list[bytes] = []
        self.trie: dict = {}  # character -> node; None -> score of the piece that ends here
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.raw.append(text.encode())
                self.ids[text], self.score[text] = i, sp.get_score(i)
                node = self.trie
                for c in text:
                    node = node.setdefault(c, {})
                node[None] = sp.get_score(i)
                if re.search(r"[^ ] ", text):
                    raise ValueError("a piece spans two words; this model needs another way of cutting")
        self.byte = [next(i for i in range(sp.vocab_size()) if sp.is_byte(i) and self.raw[i] == bytes([b])) for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.score.values()) - 10
        self.size = np.array([len(r) for r in self.raw])
        self.place = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def forward(self, text: str, start: int, end: int) -> tuple[list[float], list[int]]:
        """Best score of reaching every position from `start` by pieces that start before `end`, and where the last one began.

        A lone character that no piece covers counts as one unknown piece.
        """
        n, trie, unknown = len(text), self.trie, self.unknown
        best, back = [NONE] * (n + 1), [0] * (n + 1)
        best[start] = 0.0
        for at in range(start, end):
            have = best[at]
            if have == NONE:
                continue
            node, k, alone = trie, at, True
            while k < n:
                node = node.get(text[k])
                if node is None:
                    break
                k += 1
                score = node.get(None)
                if score is not None:
                    if k == at + 1:
                        alone = False
                    score += have
                    if score > best[k]:
                        best[k], back[k] = score, at
            if alone and have + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = have + unknown, at
        return best, back

    def trace(self, text: str, back: list[int], start: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > start:
            part = text[back[end]:end]
            out.append([self.ids[part]] if part in self.ids else [self.byte[b] for b in part.encode()])
            end = back[end]
        return list(chain.from_iterable(reversed(out)))

    def __missing__(self, word: str) -> bytes:
        known = self.older.get(word)
        if known is not None:
            self[word] = known
            return known
        _, back = self.forward(word, 0, len(word))
        ids = np.array(self.trace(word, back, 0, len(word)), np.int32).tobytes()
        if len(word) <= 20:
            self[word] = ids
        return ids

    def word_score(self, word: str) -> float:
        score = self.scores.get(word)
        if score is None:
            score = self.forward(word, 0, len(word))[0][-1]
            if len(word) <= 20:
                self.scores[word] = score
        return score

    def encode(self, spaced: str) -> bytes:
        """The ids of a text that starts with its space, as int32 bytes."""
        return b"".join(map(self.__getitem__, SEGMENT.findall(spaced)))

    def tidy(self) -> None:
        if len(self) > self.room:
            self.older = dict(self)
            self.clear()
        if len(self.scores) > self.room:
            self.scores.clear()

    def value(self, ids: list[int]) -> float:
        """The score of a segmentation."""
        total = 0.0
        for i in ids:
            text = self.raw[i].decode(errors="replace")
            if self.ids.get(text) == i:
                total += self.score[text]
            else:  # one uncovered character is as many byte pieces as its UTF-8 length
                total += self.unknown if self.raw[i][0] & 0xC0 != 0x80 else 0.0
        return total

    def transfer(self, text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The matrix of a chunk and its tie order: `text` is the chunk's characters and, after `length`, those of the look-ahead.

        Order (i, j) is the place of entry state i among all that lead to j at equal score: paths are compared from their ends, the
        longer last piece first, and a path that has come to its entry precedes one that goes on, as its next piece starts before the chunk.
        """
        m = self.longest
        out, order = np.full((m, m), NONE), np.zeros((m, m), np.int16)
        cuts = [x.start() for x in re.finditer(r"(?<=[^ ]) ", text[:length])]
        first = next((c for c in cuts if c >= m - 1), None)
        last = cuts[-1] if cuts else None
        if first is None or last < first:
            first = last = None
        stop = length if first is None else first
        best = np.full((len(text) + 1, m), NONE)
        back = np.full((len(text) + 1, m), -1, np.int32)
        place = np.zeros((len(text) + 1, m), np.int16)
        entry = np.arange(m)
        for s in range(min(m, length + 1)):
            best[s, s] = 0.0

        def reach(at: int, k: int, score: float) -> None:  # starts come in ascending order, so the longest piece stays on ties
            have = best[at] + score
            better = have > best[k]
            best[k][better] = have[better]
            back[k][better] = at

        def rank(at: int) -> None:
            came = back[at]
            place[at][np.argsort(np.where(came < 0, -1, came.astype(np.int64) * m + place[came, entry]), kind="stable")] = entry

        for at in range(stop):
            rank(at)
            alone = True
            node, k = self.trie, at
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if None in node:
                    alone &= k > at + 1
                    reach(at, k, node[None])
            if alone:
                reach(at, at + 1, self.unknown)
        if first is None:
            for j in range(min(m, len(text) - length + 1)):
                rank(length + j)
                out[:, j], order[:, j] = best[length + j], place[length + j]
            return out, order
        rank(first)  # every path is cut there, so nothing behind it tells entries apart
        middle = sum(map(self.word_score, SEGMENT.findall(text[first:last])))
        tail, _ = self.forward(text[last:], 0, length - last)
        for j in range(min(m, len(text) - length + 1)):
            out[:, j], order[:, j] = best[first] + middle + tail[length - last + j], place[first]
        return out, order

    def backtrace(self, text: str, length: int, enter: int, leave: int) -> bytes:
        """The ids of a chunk whose boundary states are known."""
        cuts = [x.start() for x in re.finditer(r"(?<=[^ ]) ", text[:length])]
        cuts = [c for c in cuts if c >= enter]
        if not cuts:
            _, back = self.forward(text, enter, length)
            return np.array(self.trace(text, back, enter, length + leave), np.int32).tobytes()
        _, back = self.forward(text[:cuts[0]], enter, cuts[0])
        head = np.array(self.trace(text, back, enter, cuts[0]), np.int32).tobytes()
        rest = text[cuts[-1]:]
        _, back = self.forward(rest, 0, length - cuts[-1])
        tail = np.array(self.trace(rest, back, 0, length - cuts[-1] + leave), np.int32).tobytes()
        return head + self.encode(text[cuts[0]:cuts[-1]]) + tail

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of rows of ids (row r has sizes[r] of them), without the space each starts with."""
        width = self.size[ids]
        total = np.concatenate(([0], np.cumsum(width)))
        raw = self.bytes[np.repeat(self.place[ids] - total[:-1], width) + np.arange(total[-1])]
        ends = total[np.cumsum(sizes)]
        starts = np.concatenate(([0], ends[:-1]))
        keep = np.ones(len(raw), bool)
        led = starts[(ends > starts)]
        keep[led[raw[led] == 32]] = False
        offsets = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], ends))]
        raw = raw[keep]
        made = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
        try:
            made.validate(full=True)
            return made.cast(pa.string())
        except pa.ArrowInvalid:  # ids of bytes that are no UTF-8
            return pa.array([raw[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets, offsets[1:])], pa.string())


def id_lists(made: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(b) >> 2 for b in made]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of all prefixes, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        for lo in range(len(out) - 1, step - 1, -256):  # in pieces, from the end, so that memory stays small
            at = np.arange(max(step, lo - 255), lo + 1)
            out[at] = compose(out[at - step], out[at])
        step *= 2
    return out


def boundary_states(matrices: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The state at every boundary (before the first chunk, between chunks, after the last) on the best path; `orders` settle ties."""
    reach = scan(matrices)[:, 0, :]
    states = np.zeros(len(matrices) + 1, np.int64)
    for k in range(len(matrices) - 1, 0, -1):
        total = reach[k - 1] + matrices[k][:, states[k + 1]]
        tied = np.flatnonzero(total == total.max())
        states[k] = tied[orders[k][tied, states[k + 1]].argmin()]
    return states


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL,
           chunk: int = 32768) -> DataFrame:
    """The columns in `keep`, and ids array<int>, for every row of `docs`."""
    look = pieces(model).longest - 1
    if chunk <= look:
        raise ValueError(f"a chunk must hold the longest piece, {look + 1} characters")
    text = F.concat(F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    src = docs.select(F.struct(*keep).alias("_row"), text.alias("_text"))
    fields = [docs.schema[c] for c in keep]
    row = T.StructField("_row", T.StructType(fields))
    plain = T.StructType([row, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for part in slices(batches, text=1, max_bytes=1 << 21):
            ids = id_lists([vocabulary.encode(t) if len(t) > 1 else b"" for t in part.column(1).to_pylist()])
            vocabulary.tidy()
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["_row", "ids"])

    size = F.length("_text")
    small = src.where(size <= chunk).mapInArrow(whole, plain)

    giant = src.where(size > chunk).withColumn("_rid", F.monotonically_increasing_id()).withColumn("_size", size)
    parts = giant.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_size") - 1) / chunk).cast("int")))).select(
        "_row", "_rid", "_k", F.expr(f"substring(_text, _k * {chunk} + 1, {chunk + look})").alias("_part"),
        F.least(F.lit(chunk), F.col("_size") - F.col("_k") * chunk).cast("int").alias("_len"))
    # Written out: row ids must not change when a lost task is run again. Chunks of one document go to different tasks.
    parts = cut_lineage(parts.repartition("_rid", "_k"))

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for part in slices(batches, text=2, max_bytes=1 << 21):
            made = [vocabulary.transfer(t, n) for t, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            vocabulary.tidy()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in zip(*made))],
                                             ["_rid", "_k", "_matrix", "_order"])

    def states(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_k")
        side = pieces(model).longest
        s = boundary_states(*(np.stack([np.frombuffer(b, t).reshape(side, side) for b in group[c]]) for c, t in (("_matrix", np.float64), ("_order", np.int16))))
        return pd.DataFrame({"_rid": group["_rid"], "_k": group["_k"], "_enter": s[:-1], "_leave": s[1:]})

    matrices = parts.select("_rid", "_k", "_part", "_len").mapInArrow(transfers, "_rid long, _k int, _matrix binary, _order binary")
    known = matrices.groupBy("_rid").applyInPandas(states, "_rid long, _k int, _enter long, _leave long")

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for part in slices(batches, text=3, max_bytes=1 << 21):
            ids = [vocabulary.backtrace(*x) for x in zip(*(part.column(c).to_pylist() for c in (3, 4, 5, 6)))]
            vocabulary.tidy()
            yield pa.RecordBatch.from_arrays([*part.columns[:3], id_lists(ids)], ["_row", "_rid", "_k", "ids"])

    found = parts.join(known, ["_rid", "_k"]).select("_row", "_rid", "_k", "_part", "_len", "_enter", "_leave").mapInArrow(
        traces, T.StructType([row, T.StructField("_rid", T.LongType()), T.StructField("_k", T.IntegerType()),
                              T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    # One document's tokens, as large as the row it came from.
    large = found.groupBy("_rid").agg(F.min_by("_row", "_k").alias("_row"), F.sort_array(F.collect_list(F.struct("_k", "ids"))).alias("_c")).select(
        "_row", F.flatten("_c.ids").alias("ids"))
    return small.unionByName(large).select("_row.*", "ids")


def decode(tokens: DataFrame, ids_col: str = "ids", to_name: str = "text", model: str = MODEL) -> DataFrame:
    """All columns of `tokens` and the decoded text of every row's ids; null ids give the empty text."""
    keep = [c for c in tokens.columns if c != to_name]
    src = tokens.select(*keep)
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            size = np.nan_to_num(pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            done, total = 0, np.cumsum(size)
            while done < batch.num_rows:  # about half a million ids at a time
                base = total[done - 1] if done else 0
                to = max(done + 1, int(np.searchsorted(total, base + (1 << 19), "right")))
                part = batch.slice(done, to - done)
                texts = vocabulary.texts(part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64), size[done:to])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, to_name])
                done = to
            del batch
        pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(to_name, T.StringType())]))


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    """Per document: token count, a digest of the ids, and whether decoding them gives back the whole text."""
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    back = decode(encode(docs, keep=("doc_id", "text_hash")), to_name="decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
                       F.length("decoded").cast("long").alias("n_chars"), (F.sha2("decoded", 256) == F.col("text_hash")).alias("round_trip"))
