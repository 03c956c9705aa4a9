"""Ranked lexical search with Block-Max MaxScore.

A document's score for an item is the sum, over the item's terms, of a weight
of the term times the impact of the term in the document (see the functions
``term_weight`` and ``impacts``; all integers). The best ``k`` documents of
each item are found without scoring every document.

The index is a table with one row per segment, a run of documents of bounded
size: the documents' ids and lengths, the segment's terms, and for each term a
list of postings (document, frequency) in blocks. A block is compressed to the
bytes that its largest step and frequency need, and has its last document and
its largest impact beside it. Segments are made where their documents are, and
nothing of the index is shuffled.

In a segment an item has one list per term it holds. With ``theta`` the lowest
score that still counts, the lists whose largest impacts together stay below
``theta`` are not essential: no document can get there by them alone. The
essential lists give the candidates. Then the block maxima of the other lists
say, for each candidate, how much they can add at most; candidates that stay
below ``theta`` are rejected before anything of those lists is decompressed,
and the rest is looked up list by list, with the bound getting tighter. A task
carries an item's best documents from segment to segment, so ``theta`` rises;
at the end the tasks' best are merged.

Defined results for odd input: null and empty texts have no terms, an item
without terms has no rows; equal scores go by the smaller id, null ids last;
repeated documents are ranked each, repeated items each get their rows; a text
of any length is a segment of its own if need be; an empty table on either side
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, query_blocks, table, written
from leagueflow.llm.tokens import slices, words

#: Documents per item in the report.
TOP = 20
#: Postings in a block.
BLOCK = 64
#: Bytes of text in a segment; a longer text is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Items, and bytes of their texts, that are searched for in one pass over the index.
ITEMS, ITEM_BYTES = 4096, 8 << 20

#: Of each byte: a space for ASCII that is no letter or digit, small letters for capitals, else itself.
_FOLD = np.array([c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256)], np.uint8)


def folded(column: pa.Array) -> pa.Array:
    """Texts with spaces between their terms and nowhere else, A-Z as small letters; null is empty."""
    texts = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
    data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], pa.py_buffer(data)], offset=texts.offset)


def term_counts(column: pa.Array) -> np.ndarray:
    """Terms of each text."""
    texts = folded(column)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    inside = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]] != 0x20
    edges = edges - edges[0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < edges[1:]]
    begins[first] = inside[first]
    return np.diff(np.append(0, np.cumsum(begins))[edges])


@dataclass(frozen=True)
class Corpus:
    """Documents with at least one term, and all their terms."""

    documents: int
    terms: int

    def term_weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def norms(self, n: np.ndarray) -> np.ndarray:
        """What a document's length adds below the line of its impacts."""
        wide = n if 25 * int(n.max(initial=0)) * self.documents < 1 << 63 else n.astype(object)
        return np.array(100 - 25 + 25 * wide * self.documents // self.terms, np.int64)


def impacts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * norms)


# ----------------------------------------------------------------- the index

#: Bytes in which steps and frequencies are kept, by the width's number.
_KINDS = (np.uint8, np.uint16, np.uint32)
_STREAMS = [f"{what}{np.dtype(k).itemsize}" for what in ("steps", "frequencies") for k in _KINDS]
INDEX = "segment long, ids array<long>, norms binary, terms array<string>, df array<int>, last binary, most binary, widths binary, " + ", ".join(f"{s} binary" for s in _STREAMS)


def _blocks(df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of these lengths: first block of each list (and the end), postings of each block, and where each begins."""
    count = -(-df // BLOCK)
    first = np.append(0, np.cumsum(count))
    nth = np.arange(first[-1]) - np.repeat(first[:-1], count)
    sizes = np.minimum(BLOCK, np.repeat(df, count) - nth * BLOCK)
    return first, sizes, np.cumsum(sizes) - sizes


def _widths(most: np.ndarray) -> np.ndarray:
    return (most > 0xFF).astype(np.uint8) + (most > 0xFFFF)


def _segment(corpus: Corpus, name: int, ids: pa.Array, texts: pa.Array) -> list:
    """The columns of one row of the index."""
    order = pc.sort_indices(ids, null_placement="at_end")  # documents count up with their ids, so ties need no look at ids
    rank = np.empty(len(ids), np.int64)
    rank[order.to_numpy()] = np.arange(len(ids))
    numbers, dictionary, sizes = words(texts)
    norms = np.empty(len(ids), np.int64)
    norms[rank] = corpus.norms(sizes)
    keys, tf = np.unique(numbers.astype(np.int64) * len(ids) + np.repeat(rank, sizes), return_counts=True)
    term, doc = np.divmod(keys, len(ids))
    found, df = np.unique(term, return_counts=True)
    first, held, begin = _blocks(df)
    heads = np.zeros(len(doc), bool)
    heads[begin[first[:-1]]] = True
    steps = np.diff(doc, prepend=0)
    steps[heads] = doc[heads]  # a list begins at its first document
    wide = [_widths(np.maximum.reduceat(x, begin)) for x in (steps, tf)]
    streams = [x[np.repeat(w, held) == k].astype(kind).tobytes() for x, w in zip((steps, tf), wide, strict=True) for k, kind in enumerate(_KINDS)]
    last = doc[begin + held - 1].astype(np.uint32)
    most = np.maximum.reduceat(impacts(tf, norms[doc]), begin).astype(np.uint32)
    lists = [name, ids.take(order), norms.tobytes(), dictionary.take(pa.array(found)), df.astype(np.int32)]
    return lists + [last.tobytes(), most.tobytes(), (4 * wide[0] + wide[1]).tobytes(), *streams]


def _index(corpus: Corpus, segment_bytes: int):
    names = [c.split()[0] for c in INDEX.split(", ")]

    def row(values: list) -> pa.RecordBatch:
        out = []
        for v in values:
            if isinstance(v, pa.Array | np.ndarray):
                own = pa.array(v) if isinstance(v, np.ndarray) else v.cast(pa.string()) if pa.types.is_large_string(v.type) else v
                out.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
            else:
                out.append(pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()))
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, made = 0, 0
        for batch in batches:
            for part in slices(batch, 1, min(segment_bytes, 1 << 20)):
                texts = folded(part.column(1))
                some = pa.array(term_counts(texts) > 0)
                held.append((part.column(0).filter(some), texts.filter(some)))
                size += part.column(1).nbytes
                if size >= segment_bytes:
                    ids, texts = (pa.concat_arrays(x) for x in zip(*held, strict=True))
                    if len(ids):
                        yield row(_segment(corpus, (TaskContext.get().partitionId() << 32) + made, ids, texts))
                    held, size, made = [], 0, made + 1
        ids, texts = (pa.concat_arrays(x) for x in zip(*held, strict=True)) if held else ([], [])
        if len(ids):
            yield row(_segment(corpus, (TaskContext.get().partitionId() << 32) + made, ids, texts))

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0, 1 << 20):
            n = term_counts(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "terms"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, Corpus]:
    """The index, written as a table into the shared folder, and the counts of the corpus. Ids are whole numbers."""
    counted = docs.select(F.col(text).cast("string")).mapInArrow(_count, "documents long, terms long")
    n, terms = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("documents", "terms")]).first()
    corpus = Corpus(n, terms)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(_index(corpus, segment_bytes), INDEX), "lexical-index"), corpus


# ---------------------------------------------------------------- the search


class Segment:
    """The lists of one segment; blocks are decompressed when they are asked for, once each."""

    def __init__(self, batch: pa.RecordBatch, at: int) -> None:
        own = {c: batch.column(c)[at] for c in batch.schema.names}
        raw = lambda c, kind: np.frombuffer(own[c].as_buffer(), kind)
        self.ids: pa.Array = own["ids"].values
        self.terms: pa.Array = own["terms"].values
        self.norms, self.last, self.most = raw("norms", np.int64), raw("last", np.uint32), raw("most", np.uint32).astype(np.int64)
        self.first, self._sizes, _ = _blocks(own["df"].values.to_numpy().astype(np.int64))
        self._widths = np.divmod(raw("widths", np.uint8), 4)
        self._streams = [[raw(s, k) for s, k in zip(_STREAMS[i : i + 3], _KINDS, strict=True)] for i in (0, 3)]
        self._begins = []
        for wide in self._widths:
            begin = np.zeros(len(wide), np.int64)
            for k in range(3):
                sizes = self._sizes[wide == k]
                begin[wide == k] = np.cumsum(sizes) - sizes
            self._begins.append(begin)
        self._heads = np.zeros(len(self.last), bool)
        self._heads[self.first[:-1]] = True
        self._known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bound(self, term: int) -> int:
        return int(self.most[self.first[term] : self.first[term + 1]].max())

    def block(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if j not in self._known:
            n = self._sizes[j]
            steps, tf = (s[w[j]][b[j] : b[j] + n].astype(np.int64) for s, w, b in zip(self._streams, self._widths, self._begins, strict=True))
            docs = np.cumsum(steps) + (0 if self._heads[j] else int(self.last[j - 1]))
            self._known[j] = docs, impacts(tf, self.norms[docs])
        return self._known[j]

    def blocks_of(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The block in which each document would stand (the list's end: none)."""
        a, b = self.first[term], self.first[term + 1]
        return a + np.searchsorted(self.last[a:b], docs)

    def search(self, lists: list[tuple[int, int]], theta: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of ``theta`` or more, for lists of (term, weight); ``theta`` is positive."""
        bounds = sorted((w * self.bound(t), t, w) for t, w in lists)
        upto = np.cumsum([b for b, _, _ in bounds])  # what the lists up to here can give together
        cut = int(np.searchsorted(upto, theta))  # the lists before stay below theta
        if cut == len(bounds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores = np.zeros(len(self.ids), np.int64)
        for _, t, w in bounds[cut:]:
            for j in range(self.first[t], self.first[t + 1]):
                docs, got = self.block(j)
                scores[docs] += w * got
        alive = np.flatnonzero((scores > 0) & (scores + (upto[cut - 1] if cut else 0) >= theta))
        places, at_most = [], np.zeros((cut, len(alive)), np.int64)
        for k, (_, t, w) in enumerate(bounds[:cut]):
            places.append(j := self.blocks_of(t, alive))
            inside = j < self.first[t + 1]
            at_most[k, inside] = w * self.most[j[inside]]
        rest = at_most.sum(0)
        for k in range(cut - 1, -1, -1):
            keep = scores[alive] + rest >= theta  # by the blocks' maxima alone
            alive, rest, at_most = alive[keep], rest[keep], at_most[:, keep]
            places = [p[keep] for p in places]
            rest = rest - at_most[k]
            for j in np.unique(places[k][at_most[k] > 0]):
                docs, got = self.block(int(j))
                mine = alive[places[k] == j]
                at = np.searchsorted(docs, mine)
                hit = docs[np.minimum(at, len(docs) - 1)] == mine
                scores[mine[hit]] += bounds[k][2] * got[at[hit]]
        alive = alive[scores[alive] >= theta]
        return alive, scores[alive]


class Best:
    """The best documents so far: score down, id up, null ids last."""

    def __init__(self, k: int) -> None:
        self._k = k
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def theta(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self._k else 1

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        nulls = np.append(self.nulls, ids.is_null().to_numpy(zero_copy_only=False))
        ids = np.append(self.ids, ids.fill_null(0).to_numpy(zero_copy_only=False))
        scores = np.append(self.scores, scores)
        order = np.lexsort((ids, nulls, -scores))[: self._k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


def _found_df(terms: list[str]):
    asked = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                place = pc.index_in(asked, batch.column("terms")[at].values)
                known = place.is_valid()
                df = batch.column("df")[at].values.take(place.filter(known)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(known.to_numpy(zero_copy_only=False))), df], ["term", "df"])

    return run


def _search(items: list[tuple[int, dict[int, int]]], terms: list[str], k: int):
    """``items``: number, and weight of each of its terms (by its place in ``terms``)."""
    asked = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: Best(k) for number, _ in items}
        for batch in batches:
            for at in range(batch.num_rows):
                segment = Segment(batch, at)
                place = pc.index_in(asked, segment.terms).fill_null(-1).to_numpy()
                for number, weights in items:
                    lists = [(int(place[t]), w) for t, w in weights.items() if place[t] >= 0]
                    docs, scores = segment.search(lists, best[number].theta) if lists else ((), ())
                    if len(docs):
                        best[number].add(scores, segment.ids.take(pa.array(docs)))
        for number, b in best.items():
            if len(b.ids):
                ids = pa.array(b.ids, mask=b.nulls)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), number)), ids, pa.array(b.scores)], ["item", "doc_id", "score"])

    return run


def search(index: DataFrame, corpus: Corpus, items: DataFrame, item_col: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """The ``k`` best documents of each item: ``item_col``, ``rank`` (from 1), ``doc_id``, ``score`` (above 0).

    Items are taken in blocks of bounded size; a block's terms and weights go
    to all tasks, which read the index once per block.
    """
    asked = checkpointed(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("name"), F.col(text).cast("string").alias("text")))
    tops = []
    for block in query_blocks(asked, "item", F.octet_length("text"), ITEMS, ITEM_BYTES):
        rows = [(r["item"], r["text"]) for r in block.select("item", "text").collect()]
        numbers, dictionary, sizes = words(folded(pa.array([t for _, t in rows], pa.string())))
        terms = dictionary.to_pylist()
        found = index.select("terms", "df").mapInArrow(_found_df(terms), "term long, df long") if terms else None
        df = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()} if terms else {}
        weights = {t: corpus.term_weight(n) for t, n in df.items()}
        own = np.split(numbers, np.cumsum(sizes)[:-1])
        queries = [(number, {t: n * weights[t] for t, n in Counter(x.tolist()).items() if weights.get(t)}) for (number, _), x in zip(rows, own, strict=True)]
        queries = [q for q in queries if q[1]]
        if queries:
            tops.append(_top(index, queries, terms, k))
    best = tops[0] if tops else items.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")
    for more in tops[1:]:
        best = best.unionAll(more)
    return best.join(asked.select("item", "name"), "item").select(F.col("name").alias(item_col), "rank", "doc_id", "score")


def _top(index: DataFrame, queries: list, terms: list[str], k: int) -> DataFrame:
    """The tasks' best documents, merged."""
    each = index.mapInArrow(_search(queries, terms, k), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return checkpointed(each.select("item", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, corpus = build_index(table(spark, sf_dir, "documents"))
    return search(index, corpus, table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
q AS (SELECT i, item_id, term, count(*)::BIGINT AS k FROM (SELECT i, item_id, unnest(t) AS term FROM i) GROUP BY i, item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (SELECT i, item_id, doc_id, r,
             sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * docs) // terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (r) CROSS JOIN c GROUP BY i, item_id, doc_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
