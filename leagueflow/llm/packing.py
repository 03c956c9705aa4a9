"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document's tokens are cut into full windows first; what is left of it, less
than a window, is one piece. The pieces go into windows from the longest to
the shortest, each into the open window with the least room that still holds
it, or into a new one.

Best-fit decreasing looks at lengths only, so the decisions are made for
lengths with counts instead of pieces: pieces of one length take the open
windows of the tightest remaining capacity one after the other, until these or
the pieces run out. A segment tree over the capacities finds the tightest one.
The plan needs one row per length, whatever the corpus, and says for each run
of equal pieces which windows it takes and at which offset. Pieces find their
place by their number among the pieces of their length, which comes from
counts per task.

Texts become token ids in slices: a text is cut where its tokens certainly
part, equal stretches of a slice are encoded once, and their ids are put
together again.

Defined results for odd input: a null text is empty and consists of its end
token; repeated rows and rows with a null id are packed each; a text of any
length is cut into windows; an empty table gives no rows; further columns are
not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, table
from leagueflow.llm.tokens import slices

#: Tokens of a sequence.
WINDOW = 1024
#: Token that ends a document.
END_ID = 0
#: Stretches whose ids a task remembers; beyond that it starts anew.
REMEMBERED = 1 << 19
#: Stretches that are encoded at once: the tokenizer's answer holds far more than the ids until they are read off.
ENCODED = 1 << 12
#: Bytes of text that are cut into stretches at a time.
SLICE = 1 << 20


# ---------------------------------------------------------------- token ids


def _parts(data: np.ndarray) -> np.ndarray:
    """Places of UTF-8 bytes where a new stretch may begin.

    That is before white space or punctuation that follows a letter, before
    white space that follows any other character, and after a single line
    break. Only ASCII and two-byte characters from U+00C0 on count, of which no
    one is white space. No token of the byte-level pattern crosses such a
    place, and none looks across it.
    """
    kind = _KINDS[data]
    solid = kind >= 2
    follows = solid.copy()
    follows[1:] |= data[:-1] >= 0xC3  # the second byte of a two-byte character
    follows &= (data < 0x80) | np.append(False, (data[:-1] >= 0xC3) & (data[:-1] < 0xE0))
    place = np.zeros(len(data), bool)
    place[1:] = (kind[1:] == 1) & follows[:-1] | (kind[1:] == 2) & (kind[:-1] == 3)
    if len(data) > 2:
        begins = solid | (data >= 0xC3) & (data < 0xE0)
        place[2:] |= follows[:-2] & (data[1:-1] == 0x0A) & begins[2:]
    return place


#: Of each byte: 1 ASCII white space, 2 ASCII punctuation, 3 ASCII letters, 4 ASCII digits, 0 the rest.
_KINDS = np.array([1 if c in (0x20, *range(0x09, 0x0E)) else 0 if c < 0x20 or c > 0x7E else 3 if chr(c).isalpha() else 4 if chr(c).isdigit() else 2 for c in range(256)], np.uint8)


def stretches(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Consecutive stretches of all texts, and how many each text has (empty texts: none)."""
    texts = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    texts = pa.concat_arrays([texts.fill_null("")])  # without an offset into a larger buffer
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    begin = _parts(data)
    filled = offsets[:-1] < offsets[1:]
    begin[offsets[:-1][filled]] = True
    starts = np.flatnonzero(begin)
    starts = starts[starts >= offsets[0]]
    edges = np.append(starts, offsets[-1]).astype(np.int64)
    out = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data)])
    return out, np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])


class Encoder:
    """Token ids of Arrow texts by a tokenizer file; strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._sizes, self._begins, self._pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        sizes, pool = [self._sizes], [self._pool]
        for a in range(0, len(new), ENCODED):
            ids = [x.ids for x in self._tokenizer.encode_batch_fast(new[a : a + ENCODED], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            pool.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        self._known.update(zip(new, range(len(self._sizes), len(self._sizes) + len(new)), strict=True))
        added = np.concatenate(sizes[1:]) if new else sizes[0][:0]
        self._begins = np.append(self._begins, len(self._pool) + np.cumsum(added) - added)
        self._sizes, self._pool = np.append(self._sizes, added), np.concatenate(pool)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        parts, counts = stretches(column)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)  # strings made at once: to_pylist makes a scalar for each
        if len(self._known) > REMEMBERED:
            self._forget()
        place = np.fromiter(map(self._known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        place[new] = np.arange(len(self._sizes), len(self._sizes) + len(new))
        self._learn(distinct[new].tolist())
        own = place[coded.indices.to_numpy(zero_copy_only=False)]
        length = self._sizes[own]
        ends = np.cumsum(length)
        # place in the pool of each id: begin of its stretch there plus its number in the stretch
        shift = self._begins[own] - (ends - length)
        ids = self._pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, length)]
        return ids, np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])


def _with_end(ids: np.ndarray, each: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(each), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(each)), each)] = ids
    return out, each + 1


def _pieces(path: str, window: int, end: int, with_ids: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = Encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids, each = _with_end(*encode(part.column(1)), end)
                whole, first = -(-each // window), np.cumsum(each) - each
                doc = np.repeat(np.arange(len(each)), whole)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * window
                length = np.minimum(window, each[doc] - start)
                begin = first[doc] + start
                # number of each piece among the task's pieces of its length
                order = np.argsort(length, kind="stable")
                heads = np.searchsorted(length[order], np.arange(window + 2))
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - heads[length[order]] + seen[length[order]]
                seen += np.diff(heads)
                own = memoryview(ids.astype("<u4").tobytes())
                spans = [own[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                columns += [pa.array(each[doc]), pa.array(np.full(len(doc), task, np.int64)), pa.array(nth)]
                if with_ids:
                    columns.append(pa.array(spans, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


# ------------------------------------------------------------------ the plan


class CapacityTree:
    """Segment tree over remaining capacities: how many open windows each range of capacities has."""

    def __init__(self, window: int) -> None:
        self._leaves = 1 << window.bit_length()
        self._sums = [0] * (2 * self._leaves)

    def add(self, capacity: int, windows: int) -> None:
        at = capacity + self._leaves
        while at:
            self._sums[at] += windows
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of at least ``least`` that an open window has."""
        at = least + self._leaves
        while not self._sums[at]:
            while at & 1:  # a right child: nothing to the right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self._leaves:
            at = 2 * at if self._sums[2 * at] else 2 * at + 1
        return at - self._leaves


@dataclass(frozen=True)
class Run:
    """Pieces ``first`` .. ``first + count - 1`` of one length: ``each`` per window, from window ``window`` on, at ``offset``."""

    length: int
    first: int
    count: int
    window: int
    each: int
    offset: int


def plan_windows(counts: dict[int, int], window: int = WINDOW) -> list[Run]:
    """Best-fit decreasing for so many pieces of each length (at most ``window``)."""
    tree = CapacityTree(window)
    open_windows: dict[int, list[list[int]]] = {}  # by capacity: runs of [first window, windows]
    runs: list[Run] = []
    opened = 0

    def keep(capacity: int, first: int, windows: int) -> None:
        if capacity and windows:
            tree.add(capacity, windows)
            own = open_windows.setdefault(capacity, [])
            if own and own[-1][0] + own[-1][1] == first:
                own[-1][1] += windows
            else:
                own.append([first, windows])

    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            capacity = tree.tightest(length)
            if capacity is None:  # new windows, as many as the rest needs
                capacity, ranges = window, [[opened, -(-(n - done) // (window // length))]]
                opened += ranges[0][1]
            else:
                ranges = open_windows.pop(capacity)
                tree.add(capacity, -sum(k for _, k in ranges))
            each = capacity // length  # a window stays the tightest until it holds no more
            for first, windows in ranges:
                m = min(n - done, windows * each)
                full, rest = divmod(m, each)
                if m:
                    runs.append(Run(length, done, m, first, each, window - capacity))
                done += m
                keep(capacity - each * length, first, full)
                keep(capacity - rest * length, first + full, 1 if rest else 0)
                used = full + (rest > 0)
                keep(capacity, first + used, windows - used)
    return runs


def _places(runs: list[Run], names: list[str], kinds: int):
    """Sequence and offset of each piece by its length and number."""
    by: dict[int, np.ndarray] = {}
    for r in runs:
        by.setdefault(r.length, []).append((r.first, r.window, r.each, r.offset))
    by = {k: np.array(v, np.int64) for k, v in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                own, at = by[int(k)], np.flatnonzero(length == k)
                first, window, each, begin = own[np.searchsorted(own[:, 0], number[at], "right") - 1].T
                nth = number[at] - first
                sequence[at], offset[at] = window + nth // each, begin + nth % each * k
            columns = [batch.column(i) for i in range(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    return run


# ------------------------------------------------------------------ operators


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a tokenizer file on every machine. ``with_ids``
    adds ``ids``, the piece's token ids as little-endian 32-bit numbers. Pieces
    are written once; the counts per task and length number them, and the plan
    goes to the tasks as runs (at most one per pair of length and capacity and
    split, whatever the corpus).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = [("id", kind), *((c, "long") for c in ("start", "length", "ids_crc32", "doc_tokens", "task", "nth"))] + [("ids", "binary")] * with_ids
    pieces = checkpointed(rows.mapInArrow(_pieces(tokenizer, window, end, with_ids, [c for c, _ in fields]), ", ".join(f"{c} {t}" for c, t in fields)))
    counted = checkpointed(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    # what a task's pieces of one length come after: a running sum over the tasks, one row each
    before = counted.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    numbered = pieces.join(before, ["length", "task"]).withColumn("number", F.col("before") + F.col("nth"))
    out = [c for c, _ in fields if c not in ("task", "nth")]
    schema = ", ".join(f"{c} {t}" for c, t in fields if c in out) + ", sequence_id long, offset long"
    placed = numbered.select(*out, "number").mapInArrow(_places(plan_windows(counts, window), [*out, "sequence_id", "offset"], len(out)), schema)
    return placed.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence of ``pack(..., with_ids=True)``: ``sequence_id``, ``length``, ``pieces`` (in order) and ``ids``."""
    piece = F.struct("offset", F.col(id_col).alias("id"), "start", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))  # at most a window's pieces
    ids = F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
    return whole.select("sequence_id", F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"), ids.alias("ids"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
