"""Subject areas of documents: bisecting k-means over document vectors, leaves labelled by their terms, leaf mixtures.

1. Texts become sentences of 64-bit word hashes, written once. Every later
   pass works on these by Arrow batch, in array operations.
2. Document vectors are term counts in hashed dimensions, weighted by the
   inverse document frequency over all documents and normalised, in whole
   numbers, written once. Bisecting k-means under the cosine distance is
   fitted on all of them: a round divides many clusters, and each iteration of
   a round is one pass over the vectors, in blocks, that leaves a sum a
   cluster; the first also moves the documents. Sums of whole numbers are exact, so
   the tree is the same however the table is laid out, and the same where few
   vectors are fitted within one task. The tree is a constant (``LEAVES`` - 1
   splits); every document goes down it.
3. A leaf's mixture over subjects is counted from all hand-labelled documents
   in it, drawn towards the overall mixture. Labels enter nowhere else.
4. A term's subjects are unmixed from the leaves it occurs in: the mixtures of
   its leaves, each weighted by how often and how much more than elsewhere the
   term occurs there (its discriminative weight), then one step of expectation
   maximisation, which shares each leaf's occurrences out among the subjects
   the term has so far. A term that owes most of its occurrences to one subject
   is discriminative and speaks; words of all trades do not.
5. A sentence with speaking terms goes to the subject with the greatest sum of
   the terms' log affinities and the log mixture of its document's leaf. A
   document has every subject that takes at least ``share`` of its sentences
   about any subject.

What reaches the driver is bounded by parameters: the tree, for each task of a
pass (``TASKS`` at most) a sum a cluster, document frequencies by dimension, leaf sizes, leaves times subjects label counts.
Speaking terms are shipped to the workers only up to ``SHIPPED`` of them;
beyond, sentences meet their terms in a join, with the same result.

Defined results: null or empty texts have no subject; code blocks, inline code
and case make no difference; without any labels no document has a subject;
repeated documents (same id) are assigned once per row; rows without an id are
assigned too; label rows with null or unknown subject or unknown documents are
ignored, repeated labels count once; ties between subjects go to the first by
name; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernglass.session import forget, materialize

#: Leaves of the tree, hashed dimensions of a document's vector, the whole number that stands for 1 in it.
LEAVES, DIMENSIONS, ONE = 256, 1 << 13, (1 << 15) - 1
#: Cells of all vectors up to which one task fits the tree; beyond, a task of a pass takes as many, or more where tasks are this many.
TOGETHER, TASKS = 1 << 22, 48
#: Cells divided at once, which are a block, a row of the table that passes read; how that is written and read, as its rows are large.
CACHED = 1 << 15
FEW = {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
BLOCKS = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": str(1 << 22), "parquet.page.size.row.check.min": "10"}
#: A cluster of fewer documents is not divided; iterations of each division.
LEAST_CLUSTER, ITERATIONS = 32, 6
#: The part of a term's occurrences that it must owe to one subject to speak, and the documents it must occur in.
SPEAKS, LEAST_DOCUMENTS = 0.6, 3
#: Speaking terms that are shipped to the workers; beyond, they are joined.
SHIPPED = 1 << 20
#: Tokens handled at once within an Arrow batch.
SLICE = 1 << 20

_BLOCK = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|&(?:[a-z]+|#\d+);|\\[nrt]")
_STOP = re.compile(r"[.!?]+(?=\s)")
_APART = str.maketrans({c: " " for c in ",;:.?!()[]{}\"“”„«»#>*     ​　\t\r"})


def sentences(text: str) -> list[str]:
    """The prose of a document, lower case, without code, one sentence an item."""
    if "```" in text:
        text = _BLOCK.sub("\n", text)
    return _STOP.sub("\n", _INLINE.sub(" ", text).lower()).translate(_APART).split("\n")


#: Ends a sentence among its words; no word is a comma. What is a space to Python besides the plain one and the line's end.
MARK = ","
_SPACES = dict.fromkeys([*range(0x9, 0xA), *range(0xB, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], " ")


def _blank(text: str, table: dict[int, str]) -> str:
    if text.isascii():
        return text.translate(table)
    # beyond ASCII, translating goes by the character
    for c in table:
        text = text.replace(chr(c), " ")
    return text


def words(text: str) -> str:
    """The words of its ``sentences`` between spaces, ``MARK`` after each sentence."""
    if "```" in text:
        text = _BLOCK.sub("\n", text)
    text = _blank(_INLINE.sub(" ", text).lower(), _SPACES)
    for stop in ".!?":
        text = text.replace(f"{stop} ", "\n ")
    return f"{_blank(text, _APART)}\n".replace("\n", f" {MARK} ")


class Hashes(dict):
    """Word to its 64-bit hash, 0 for what is no word, ``BREAK`` for ``MARK``; forgets when it has grown large."""

    MOST = 1 << 20

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = BREAK if word == MARK else 0
        if len(word) > 1 and word[0].isalpha():
            h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1
        self[word] = h
        return h


#: Stands between sentences. No word hashes to it but with the chance of any 64-bit value.
BREAK = -1


def prepare(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens) of every document, written once: word hashes, with a break after each sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            lists = pc.split_pattern(pa.array([words(text or "") for text in batch.column("text").to_pylist()], pa.string()), " ")
            coded = lists.values.dictionary_encode()
            flat = np.array([known[w] for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            is_word = np.flatnonzero(flat)
            flat = flat[is_word]
            # a break follows a word, so a document, which ends in one, doesn't begin with one
            kept = (flat != BREAK) | (np.append(BREAK, flat[:-1]) != BREAK)[: len(flat)]
            at = np.searchsorted(is_word[kept], lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat[kept]))], names=["doc_id", "tokens"])

    return materialize(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, tokens array<bigint>"))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of lists, or of 32-bit numbers that are bytes to Spark, which passes those on as they are."""
    if not pa.types.is_binary(column.type):
        return column.values.to_numpy(), column.offsets.to_numpy()
    _, at, values = column.buffers()
    return np.frombuffer(values or b"", np.int32), np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1] // 4


def _bytes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """What ``_numbers`` reads."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values, np.int32))])


def slices(batches: Iterator[pa.RecordBatch], column: str = "tokens") -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, tokens, offsets) of a few documents at a time, however long they are."""
    for batch in batches:
        values, at = _numbers(batch.column(column))
        lo, n = 0, len(batch)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, side="right")) - 1)
            yield batch.column(0).slice(lo, hi - lo), values[at[lo] : at[hi]], (at[lo : hi + 1] - at[lo]).astype(np.int64)
            lo = hi


def _of_document(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def counted(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, dimension, count), in the order of the documents."""
    said = tokens != BREAK
    key, n = np.unique(_of_document(offsets)[said] * DIMENSIONS + (tokens[said] & (DIMENSIONS - 1)), return_counts=True)
    return key // DIMENSIONS, key % DIMENSIONS, n


def document_frequencies(prepared: DataFrame) -> tuple[np.ndarray, int]:
    """(documents by dimension, documents) over all documents; each partition sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for ids, tokens, offsets in slices(batches):
            n += len(ids)
            df += np.bincount(counted(tokens, offsets)[1], minlength=DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.append(n, df))], names=["dim", "n"])

    rows = prepared.mapInArrow(run, "dim bigint, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # one row a dimension
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r.dim + 1] = r.n
    return out[1:], int(out[0])


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return np.where(df >= 3, np.log((n + 1.0) / (df + 1.0)), 0.0).astype(np.float32)


@dataclass
class Tree:
    """Node i sends a document left or right by the sign of its product with ``weights[i]``; a negative child ~j is leaf j."""

    weights: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def descend(self, document: np.ndarray, dim: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Leaf of each of ``n`` documents given by sparse (document, dimension, value)."""
        out = np.full(n, ~0)
        flat, value, at = self.weights.reshape(-1), value.astype(np.float32), np.searchsorted(document, np.arange(n + 1))
        lo = 0 if len(self.left) else n
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CACHED, side="right")) - 1)
            # of the documents that have not come to a leaf
            on, lengths, node = np.arange(lo, hi), np.diff(at[lo : hi + 1]), np.zeros(hi - lo, np.int64)
            k, v = dim[at[lo] : at[hi]], value[at[lo] : at[hi]]
            while len(on):
                own = np.repeat(np.arange(len(on)), lengths)
                left = np.bincount(own, flat[np.repeat(node * DIMENSIONS, lengths) + k] * v, minlength=len(on)) >= 0
                node = np.where(left, self.left[node], self.right[node])
                out[on] = node
                go = node >= 0
                if not go.all():
                    cells = np.repeat(go, lengths)
                    on, lengths, node, k, v = on[go], lengths[go], node[go], k[cells], v[cells]
            lo = hi
        return ~out


@dataclass
class Tally:
    """Of clusters that are divided: documents on the left and the right of each, the sum of those on the left, and two of each side."""

    n: np.ndarray
    left: np.ndarray
    seeds: list[dict[int, np.ndarray]]

    @staticmethod
    def none(m: int) -> Tally:
        return Tally(np.zeros(2 * m, np.int64), np.zeros((m, DIMENSIONS)), [{} for _ in range(2 * m)])

    def __iadd__(self, other: Tally) -> Tally:
        self.n += other.n
        self.left += other.left
        self.seeds = [_least({**a, **b}) for a, b in zip(self.seeds, other.seeds, strict=True)]
        return self


def _least(seeds: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The two of least hash, by which equal vectors are one."""
    return {h: seeds[h] for h in sorted(seeds)[:2]}


def _divided(cells: np.ndarray, offsets: np.ndarray, slot: np.ndarray, clusters: np.ndarray, ways: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, place of their cluster, whether they go left, lengths, place and dimension of every cell, value) of the documents at ``slot`` in ``clusters``, some at a time."""
    which = np.full(1 + max(slot.max(initial=0), clusters.max()), -1)
    which[clusters] = np.arange(len(clusters))
    lo = 0
    while lo < len(slot):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CACHED, side="right")) - 1)
        at, lengths, part = which[slot[lo:hi]], np.diff(offsets[lo : hi + 1]), cells[offsets[lo] : offsets[hi]]
        d = np.flatnonzero(at >= 0)
        if len(d) < len(at):
            part, at, lengths = part[np.repeat(at >= 0, lengths)], at[d], lengths[d]
        if len(d):
            key = np.repeat(at * DIMENSIONS, lengths)
            key += part >> 16
            value = (part & 0xFFFF).astype(np.float64)
            left = np.add.reduceat(ways.reshape(-1).take(key) * value, np.cumsum(lengths) - lengths) >= 0
            yield lo + d, at, left, lengths, key, value
        lo = hi


def tally(out: Tally, cells: np.ndarray, offsets: np.ndarray, slot: np.ndarray, clusters: np.ndarray, ways: np.ndarray, seeds: bool) -> None:
    """Add to ``out`` what the documents at ``slot`` add to ``clusters``, each divided by the sign of the product with its way."""
    if seeds:
        # any order will do that does not hang on the layout
        mixed = (cells.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        h = np.add.reduceat(mixed, offsets[:-1]) if len(slot) else mixed
    for d, at, left, lengths, key, value in _divided(cells, offsets, slot, clusters, ways):
        side = 2 * at + ~left
        out.n += np.bincount(side, minlength=len(out.n))
        on = np.repeat(left, lengths)
        np.add.at(out.left.reshape(-1), key[on], value[on])
        if seeds:
            by = np.lexsort((h[d], side))
            d, side = d[by], side[by]
            new = np.append(True, (side[1:] != side[:-1]) | (h[d][1:] != h[d][:-1]))
            d, side = d[new], side[new]
            first = np.append(True, side[1:] != side[:-1])
            two = first | np.append(False, first[:-1])
            for i, j in zip(d[two], side[two], strict=True):
                out.seeds[j] = _least({**out.seeds[j], int(h[i]): cells[offsets[i] : offsets[i + 1]].copy()})


def moved(cells: np.ndarray, offsets: np.ndarray, slot: np.ndarray, clusters: np.ndarray, ways: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``slot`` after ``clusters`` are divided: those on the right go to ``others``."""
    slot = slot.copy()
    for d, at, left, *_ in _divided(cells, offsets, slot, clusters, ways):
        slot[d[~left]] = others[at[~left]]
    return slot


def beside(cells: np.ndarray, offsets: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents anew, those of a cluster beside each other, so that what a pass gathers for a cluster stays near."""
    order = np.argsort(slot, kind="stable")
    lengths = np.diff(offsets)[order]
    ends = np.append(0, np.cumsum(lengths))
    return cells[np.repeat(offsets[:-1][order] - ends[:-1], lengths) + np.arange(ends[-1])], ends, slot[order]


class Together:
    """Documents in memory, each at its cluster."""

    def __init__(self, cells: np.ndarray, offsets: np.ndarray):
        # without those that have no cell
        self.cells, self.offsets = cells, np.unique(offsets)
        self.slot = np.zeros(len(self.offsets) - 1, np.int64)

    def tally(self, clusters: np.ndarray, ways: np.ndarray, seeds: bool, last: tuple | None = None) -> Tally:
        if last:
            self.cells, self.offsets, self.slot = beside(self.cells, self.offsets, moved(self.cells, self.offsets, self.slot, *last))
        out = Tally.none(len(clusters))
        tally(out, self.cells, self.offsets, self.slot, clusters, ways.astype(np.float64), seeds)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slot, cells, offsets) of the documents of each block."""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("slots", "lengths", "cells")), strict=True):
            slot, lengths, cells = (np.frombuffer(x.as_buffer(), np.int32) for x in row)
            yield slot.astype(np.int64), cells, np.append(0, np.cumsum(lengths, dtype=np.int64))


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same documents, some ``SLICE`` cells at a time."""
    held, n = [], 0

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.append(0, np.cumsum(np.concatenate([np.diff(x[2]) for x in held])))

    for part in parts:
        held.append(part)
        n += len(part[1])
        if n >= SLICE:
            yield whole()
            held, n = [], 0
    if n:
        yield whole()


def _written(slot: np.ndarray, cells: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of blocks that ``_blocks`` reads."""
    lo, n, lengths = 0, len(slot), np.diff(offsets)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CACHED, side="right")) - 1)
        row = [x.astype(np.int32).tobytes() for x in (slot[lo:hi], lengths[lo:hi], cells[offsets[lo] : offsets[hi]])]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*row, None)], names=["slots", "lengths", "cells", "part"])
        lo = hi


class Apart:
    """Documents in a written table of blocks of them, each at its cluster.

    The first pass of a round moves the documents and writes the table anew,
    and what it counts beside it; the table before it is deleted.
    """

    def __init__(self, vectors: DataFrame, tasks: int):
        self.said, self.tasks, self.written = vectors.select("cells").filter("length(cells) > 0"), tasks, False
        # settings of the caller's session stay as they are
        self.session = vectors.sparkSession.newSession()
        for k, v in FEW.items():
            self.session.conf.set(k, v)

    def tally(self, clusters: np.ndarray, ways: np.ndarray, seeds: bool, last: tuple | None = None) -> Tally:
        sent, written = self.said.sparkSession.sparkContext.broadcast((clusters, ways, last)), self.written

        def packed(part: Tally) -> pa.Array:
            if part.left.max(initial=0) < 1 << 31:
                part.left = part.left.astype(np.int32)
            return pa.array([pickle.dumps(part)], pa.binary())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clusters, ways, _ = sent.value
            part, ways = Tally.none(len(clusters)), ways.astype(np.float64)
            for slot, cells, offsets in _blocks(batches):
                tally(part, cells, offsets, slot, clusters, ways, seeds)
            if part.n.any():
                yield pa.RecordBatch.from_arrays([packed(part)], names=["part"])

        def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clusters, ways, last = sent.value
            part, ways = Tally.none(len(clusters)), ways.astype(np.float64)
            for slot, cells, offsets in _gathered(_blocks(batches) if written else ((np.zeros(len(ids), np.int64), cells, offsets) for ids, cells, offsets in slices(batches, "cells"))):
                if last:
                    cells, offsets, slot = beside(cells, offsets, moved(cells, offsets, slot, *last))
                tally(part, cells, offsets, slot, clusters, ways, seeds)
                yield from _written(slot, cells, offsets)
            if part.n.any():
                none = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([none, none, none, packed(part)], names=["slots", "lengths", "cells", "part"])

        said = self.said.coalesce(self.tasks)
        if last or not written:
            table = materialize(said.mapInArrow(anew, "slots binary, lengths binary, cells binary, part binary"), **BLOCKS)
            if written:
                forget(self.said)
            else:
                table = self.session.read.schema(table.schema).parquet(table.inputFiles()[0].rpartition("/")[0])
            self.said, self.written = table.filter("cells is not null").select("slots", "lengths", "cells"), True
            parts = table.filter("part is not null").select("part").coalesce(self.tasks)
        else:
            parts = said.mapInArrow(run, "part binary")
        out = Tally.none(len(clusters))
        for r in parts.collect():  # a row a task
            out += pickle.loads(r.part)
        sent.destroy()
        return out

    def end(self) -> None:
        if self.written:
            forget(self.said)


def grow(documents: Together | Apart, leaves: int) -> Tree:
    """Bisecting k-means, by passes over all documents: those clusters are divided first whose total distance from the centre is greatest.

    A round divides together the open clusters that have at least an even share
    of the whole distance, were it spread over ``leaves`` clusters. A cluster
    starts from two of its documents.
    """
    weights, left, right = [], [], []

    def centre(sums: np.ndarray) -> np.ndarray:
        return sums / np.maximum(1e-9, np.linalg.norm(sums, axis=-1, keepdims=True))

    def seed(cells: np.ndarray) -> np.ndarray:
        return np.bincount(cells >> 16, cells & 0xFFFF, minlength=DIMENSIONS)

    whole = documents.tally(np.zeros(1, np.int64), np.zeros((1, DIMENSIONS), np.float32), True)
    # of every cluster: documents, sum, seeds, whether it may be divided, and where the tree has it
    size, total, seeds, open_, held = [int(whole.n[0])], [whole.left[0]], [whole.seeds[0]], [True], [None]
    last = None
    while True:
        loss = [n - float(np.linalg.norm(t)) / ONE for n, t in zip(size, total, strict=True)]
        may = sorted((c for c in range(len(size)) if open_[c] and size[c] >= LEAST_CLUSTER and len(seeds[c]) == 2), key=lambda c: (-loss[c], c))
        least = min(sum(loss) / leaves, loss[may[0]]) if may else 0
        clusters = np.array([c for c in may[: leaves - len(size)] if loss[c] >= least], np.int64)
        if not len(clusters):
            break
        ways = np.array([np.subtract(*centre(np.array([seed(x) for x in seeds[c].values()]))) for c in clusters], np.float32)
        for i in range(ITERATIONS + 1):
            got = documents.tally(clusters, ways, i == ITERATIONS, None if i else last)
            both = (got.n.reshape(-1, 2) > 0).all(1)
            for c in clusters[~both]:
                open_[c] = False
            clusters, ways, of_left = clusters[both], ways[both], got.left[both]
            if not len(clusters):
                break
            if i < ITERATIONS:
                ways = (centre(of_left) - centre(np.array([total[c] for c in clusters]) - of_left)).astype(np.float32)
        others = len(size) + np.arange(len(clusters))
        for c, other, way, sums, k in zip(clusters, others, ways, of_left, np.flatnonzero(both), strict=True):
            me = len(left)
            if held[c]:
                held[c][0][held[c][1]] = me
            weights.append(way)
            left.append(~c)
            right.append(~other)
            held[c] = (left, me)
            held.append((right, me))
            size.append(int(got.n[2 * k + 1]))
            total.append(total[c] - sums)
            seeds.append(got.seeds[2 * k + 1])
            open_.append(True)
            size[c], total[c], seeds[c] = int(got.n[2 * k]), sums, got.seeds[2 * k]
        last = (clusters, ways, others) if len(clusters) else None
    return Tree(np.array(weights, np.float32).reshape(-1, DIMENSIONS), np.array(left, np.int64), np.array(right, np.int64), len(size))


def bisect_cells(cells: np.ndarray, offsets: np.ndarray, leaves: int) -> Tree:
    """The tree of documents in memory."""
    return grow(Together(cells, offsets), leaves)


def bisect(document: np.ndarray, dim: np.ndarray, value: np.ndarray, n: int, leaves: int) -> Tree:
    """The tree of ``n`` unit vectors, in the order of the documents."""
    return bisect_cells(packed(dim, value), np.searchsorted(document, np.arange(n + 1)), leaves)


def packed(dim: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A cell of a vector in a number: dimension and value, of which ``ONE`` is 1."""
    return (dim.astype(np.int32) << 16) | np.rint(value * ONE).astype(np.int32)


def vectors(prepared: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, cells): the vector of every document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, offsets in slices(batches):
            d, k, v = _weighted(tokens, offsets, idf)
            said = v > 0
            ends = np.searchsorted(d[said], np.arange(len(offsets)))
            yield pa.RecordBatch.from_arrays([ids, _bytes(packed(k[said], v[said] / ONE), ends)], names=["doc_id", "cells"])

    return materialize(prepared.mapInArrow(run, "doc_id bigint, cells binary"))


def fit(vectors: DataFrame, leaves: int = LEAVES, together: int = TOGETHER) -> Tree:
    """The tree of at most ``leaves`` leaves over all documents with words: in one task up to ``together`` cells, else by passes, with the same result."""
    said = vectors.select("cells").filter("length(cells) > 0")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [(cells, np.diff(offsets)) for _, cells, offsets in slices(batches, "cells")]
        cells, lengths = (np.concatenate(x) for x in zip(*lists, strict=True)) if lists else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(bisect_cells(cells, np.append(0, np.cumsum(lengths, dtype=np.int64)), leaves))])], names=["part"])

    n = (said.agg(F.sum(F.length("cells"))).first()[0] or 0) // 4
    if n <= together:
        return pickle.loads(said.repartition(1).mapInArrow(whole, "part binary").first().part)
    documents = Apart(vectors, min(TASKS, -(-n // max(1, together))))
    tree = grow(documents, leaves)
    documents.end()
    return tree


def _weighted(tokens: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of documents as (document, dimension, value), in whole numbers of which ``ONE`` is 1."""
    d, k, n = counted(tokens, offsets)
    v = n * idf[k]
    norm = np.sqrt(np.bincount(d, v * v, minlength=len(offsets) - 1))
    return d, k, np.rint(v / np.maximum(norm, 1e-9)[d] * ONE).astype(np.float32)


class Leaves:
    """Tree and weights as the workers use them: one broadcast, whose size the parameters fix."""

    def __init__(self, spark, tree: Tree, idf: np.ndarray):
        self.shipped, self.n = spark.sparkContext.broadcast((tree, idf)), tree.leaves

    def of(self, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        tree, idf = self.shipped.value
        return tree.descend(*_weighted(tokens, offsets, idf), len(offsets) - 1)


def leaf_table(vectors: DataFrame, leaves: Leaves) -> DataFrame:
    """(doc_id, leaf) of every document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, cells, offsets in slices(batches, "cells"):
            leaf = leaves.shipped.value[0].descend(_of_document(offsets), cells >> 16, cells & 0xFFFF, len(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.array(leaf)], names=["doc_id", "leaf"])

    return materialize(vectors.mapInArrow(run, "doc_id bigint, leaf bigint"))


def term_counts(prepared: DataFrame, leaves: Leaves) -> DataFrame:
    """(term, leaf, n): documents of each leaf that contain a term, over all documents. Combined before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, offsets in slices(batches):
            leaf, said = leaves.of(tokens, offsets), tokens != BREAK
            coded = pa.array(tokens[said]).dictionary_encode()
            term, m = coded.dictionary.to_numpy(), max(1, len(coded.dictionary))
            # once per document, then once per leaf
            own = np.unique(_of_document(offsets)[said] * m + coded.indices.to_numpy())
            key, n = np.unique(leaf[own // m] * m + own % m, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term[key % m], pa.int64()), pa.array(key // m), pa.array(n)], names=["term", "leaf", "n"])

    return prepared.mapInArrow(run, "term bigint, leaf bigint, n bigint").groupBy("term", "leaf").agg(F.sum("n").alias("n"))


def leaf_mixtures(table: DataFrame, labels: DataFrame, subjects: list[str], tree: Tree, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(mixture of every leaf, overall mixture, documents of every leaf); None without labels.

    Every cluster's mixture is drawn towards that of the cluster it was divided from, down from the root.
    """
    once = labels.select("doc_id", "subject").dropna().distinct().filter(F.col("subject").isin(subjects))
    size, count = np.zeros(tree.leaves), np.zeros((tree.leaves, len(subjects)))
    for r in table.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # one row a leaf
        size[r.leaf] = r.n
    at = {s: i for i, s in enumerate(subjects)}
    # labels grow with the corpus: merged, not broadcast
    for r in table.join(once.hint("merge"), "doc_id").groupBy("leaf", "subject").agg(F.count("*").alias("n")).collect():  # leaves times subjects
        count[r.leaf, at[r.subject]] = r.n
    if not count.any():
        return None
    base = (count.sum(0) + 1) / (count.sum() + len(subjects))
    # children come after the cluster they were divided from
    inner = np.zeros((len(tree.left), len(subjects)))
    for i in reversed(range(len(tree.left))):
        for child in (tree.left[i], tree.right[i]):
            inner[i] += inner[child] if child >= 0 else count[~child]
    mixed, drawn = np.tile(base, (max(1, len(tree.left)), 1)), (count + weight * base) / (count.sum(1, keepdims=True) + weight)
    for i in range(len(tree.left)):
        for child in (tree.left[i], tree.right[i]):
            own = inner[child] if child >= 0 else count[~child]
            (mixed if child >= 0 else drawn)[child if child >= 0 else ~child] = (own + weight * mixed[i]) / (own.sum() + weight)
    return drawn, base, size


def unmix(leaf: np.ndarray, n: np.ndarray, offsets: np.ndarray, mixtures: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Affinity of each term to each subject; term i has the leaves and document counts from ``offsets[i]`` to ``offsets[i + 1]``."""
    own, first = _of_document(offsets), offsets[:-1]
    total = np.add.reduceat(n, first).astype(float)
    lift = (n / size[leaf]) / (total / size.sum())[own]
    weight = (n * np.sqrt(lift))[:, None]
    start = np.add.reduceat(weight * mixtures[leaf], first)
    start /= start.sum(1, keepdims=True)
    trust = (total / (total + 1))[:, None]
    start = start * trust + (1 - trust) * base
    over = mixtures[leaf] / base
    shared = start * np.add.reduceat(weight / (start[own] * over).sum(1, keepdims=True) * over, first)
    shared /= shared.sum(1, keepdims=True)
    trust = (total / (total + 2))[:, None]
    return shared * trust + (1 - trust) * base


def speaking_terms(counts: DataFrame, mixtures: np.ndarray, base: np.ndarray, size: np.ndarray) -> DataFrame:
    """(term, score): log affinity, less that of any word, of every term that speaks for a subject; written. A term has as many counts as leaves at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            seen = batch.column("seen")
            at = seen.offsets.to_numpy().astype(np.int64)
            entries = seen.values.slice(at[0], at[-1] - at[0])
            a = unmix(entries.field("leaf").to_numpy(), entries.field("n").to_numpy(), at - at[0], mixtures, base, size)
            speak = np.flatnonzero(a.max(1) >= SPEAKS)
            score = (np.log(a[speak] + 0.01) - np.log(base + 0.01)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, score.size + 1, score.shape[1], dtype=np.int32)), pa.array(score.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(speak)), lists], names=["term", "score"])

    grouped = counts.groupBy("term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("leaf", "n")).alias("seen")).filter(F.col("total") >= LEAST_DOCUMENTS)
    return materialize(grouped.select("term", F.array_sort("seen").alias("seen")).mapInArrow(run, "term bigint, score array<float>"))


PRIOR = 0.3


def _prior(mixtures: np.ndarray) -> np.ndarray:
    """What a document's leaf adds to each of its sentences."""
    return PRIOR * np.log(mixtures + 0.02)


def assign_shipped(prepared: DataFrame, leaves: Leaves, terms: DataFrame, mixtures: np.ndarray, subjects: list[str], share: float) -> DataFrame:
    """(doc_id, subject, weight), with the speaking terms in every worker."""
    rows = terms.collect()  # SHIPPED at most, as the caller has counted
    rows.sort(key=lambda r: r.term)
    shipped = prepared.sparkSession.sparkContext.broadcast((np.array([r.term for r in rows], np.int64), np.array([r.score for r in rows], np.float32).reshape(len(rows), len(subjects))))
    prior, names, m = _prior(mixtures), pa.array(subjects), len(subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, score = shipped.value
        for ids, tokens, offsets in slices(batches):
            n = len(ids)
            leaf, own = leaves.of(tokens, offsets), _of_document(offsets)
            line = np.cumsum(tokens == BREAK) - (tokens == BREAK)
            coded = pa.array(tokens).dictionary_encode()
            every = coded.dictionary.to_numpy()
            at = np.minimum(np.searchsorted(term, every), max(0, len(term) - 1))
            at = (np.where(term[at] == every, at, -1) if len(term) else np.full(len(every), -1))[coded.indices.to_numpy()]
            hit = np.flatnonzero(at >= 0)
            lines, first = np.unique(line[hit], return_index=True)
            total = np.add.reduceat(score[at[hit]], first) if len(hit) else np.zeros((0, m))
            document = own[hit[first]]
            best = (total + prior[leaf[document]]).argmax(1)
            found = np.bincount(document * m + best, minlength=n * m).reshape(n, m)
            whole = found.sum(1, keepdims=True)
            d, s = np.nonzero((found > 0) & (found >= share * whole))
            weight = found[d, s] / np.maximum(whole[d, 0], 1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), names.take(pa.array(s)), pa.array(weight)], names=["doc_id", "subject", "weight"])

    return prepared.mapInArrow(run, "doc_id bigint, subject string, weight double")


def assign_joined(prepared: DataFrame, leaves: Leaves, terms: DataFrame, mixtures: np.ndarray, subjects: list[str], share: float) -> DataFrame:
    """The same as ``assign_shipped`` for any number of speaking terms: sentences meet them in a join."""
    m = len(subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, offsets in slices(batches):
            leaf, own = leaves.of(tokens, offsets), _of_document(offsets)
            line = np.cumsum(tokens == BREAK) - (tokens == BREAK)
            w = tokens != BREAK
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[w])), pa.array(own[w]), pa.array(leaf[own[w]]), pa.array(line[w]), pa.array(tokens[w])], names=["doc_id", "row", "leaf", "line", "term"])

    # rows that repeat an id are told apart by their place, which is settled once by writing it
    placed = materialize(prepared.select("doc_id", "tokens").withColumn("place", F.monotonically_increasing_id()))
    said = placed.select(F.col("place").alias("doc_id"), "tokens").mapInArrow(run, "doc_id bigint, row bigint, leaf bigint, line bigint, term bigint")
    prior = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in _prior(mixtures)])
    sums = said.join(terms, "term").groupBy("doc_id", "line").agg(F.max("leaf").alias("leaf"), *[F.sum(F.col("score")[i].cast("double")).alias(f"s{i}") for i in range(m)])
    score = [F.col(f"s{i}") + F.get(F.get(prior, F.col("leaf").cast("int")), F.lit(i)) for i in range(m)]
    best = F.array_position(F.array(*score), F.greatest(*score)) - 1
    found = sums.select("doc_id", best.cast("int").alias("best")).groupBy("doc_id", "best").agg(F.count("*").alias("n"))
    weight = F.col("n") / F.sum("n").over(Window.partitionBy("doc_id"))
    named = found.select("doc_id", F.get(F.array(*[F.lit(s) for s in subjects]), F.col("best")).alias("subject"), weight.alias("weight")).filter(F.col("weight") >= share)
    return named.withColumnRenamed("doc_id", "place").join(placed.select("doc_id", "place"), "place").select("doc_id", "subject", "weight")


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: list[str], *, leaves: int = LEAVES, share: float = 0.25, shipped: int = SHIPPED) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(assignments, leaf table, term counts) of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    prepared = prepare(documents)
    df, n = document_frequencies(prepared)
    idf = inverse_frequencies(df, n)
    said = vectors(prepared, idf)
    tree = Leaves(spark, fit(said, leaves), idf)
    table = leaf_table(said, tree)
    mixed = leaf_mixtures(table, labels, subjects, tree.shipped.value[0])
    counts = term_counts(prepared, tree)
    if mixed is None:
        return spark.createDataFrame([], "doc_id bigint, subject string, weight double"), table, counts
    mixtures, base, size = mixed
    terms = speaking_terms(counts, mixtures, base, np.maximum(size, 1))
    assign = assign_shipped if terms.count() <= shipped else assign_joined
    return assign(prepared, tree, terms, mixtures, subjects, share), table, counts


def leaf_terms(table: DataFrame, counts: DataFrame, documents: DataFrame, n_terms: int = 20, least_part: float = 0.02) -> DataFrame:
    """(leaf, rank, word, n, total, score): the most discriminative words that label each leaf."""
    size = table.groupBy("leaf").agg(F.count("*").alias("size"))
    every = table.agg(F.count("*").alias("all"))
    rows = counts.withColumn("total", F.sum("n").over(Window.partitionBy("term"))).filter("n >= 2")
    # a row a leaf, and one row
    rows = rows.join(F.broadcast(size), "leaf").join(F.broadcast(every), F.lit(True))
    p, q = F.col("n") / F.col("size"), F.col("total") / F.col("all")
    rows = rows.withColumn("score", p * F.log(p / q)).filter((F.col("score") > 0) & (p >= least_part))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("score"), "term"))).filter(F.col("rank") <= n_terms)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = Hashes()
            for text in batch.column("text").to_pylist():
                for s in sentences(text or ""):
                    for w in s.split():
                        known[w]
            said = [(h, w) for w, h in known.items() if h]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in said], pa.int64()), pa.array([w for _, w in said], pa.string())], names=["term", "word"])

    named = documents.select("text").mapInArrow(names, "term bigint, word string").groupBy("term").agg(F.min("word").alias("word"))
    return rows.join(named, "term").select("leaf", "rank", "word", "n", "total", "score")
