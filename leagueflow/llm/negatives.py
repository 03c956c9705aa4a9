"""Hard negatives by angular triangle filtering.

Vectors are scored in integers: a component x counts as floor(256 x). For an
anchor the best rows of its own label are positives; for each positive the
best rows of other labels whose score lies between 80 % and 100 % of the
positive's are its hard negatives.

Every row has its norm and its angles to a few reference directions beside it.
The angle between two vectors is at least the difference and at most the sum
of their angles to any direction (or what is left to a full turn), so the
stored angles give an interval for the cosine, and the norms one for the
score, made wider than any rounding. Rows lie in slices of one label and one
nearest reference; the extreme angles of a slice reject it as a whole for an
anchor, then the interval of each row is held against the anchor's windows
(scores that still count), and only rows with an overlap are scored. The
references decide how much is skipped, never what is found.

Anchors are a stated query set: they go to the tasks in blocks of bounded
size, and each task keeps the best few per anchor and window, which are merged
afterwards. Work is the product of anchors and rows, less what the intervals
skip; what is written is tasks times anchors times a few rows.

Defined results for odd input: rows without a label, with a null vector, or
with a null or non-finite component take no part; shorter vectors end in
zeros, so an empty vector scores 0 with every row; equal scores go by the
smaller id, null ids last; a row with a null id is never an anchor; repeated
rows count each, also as anchors, and the copy of an anchor is another row;
components of 2^23 and more have no 32-bit integer and are refused with an
error; ids and labels are whole numbers; further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, query_blocks, table

#: Positives per anchor, and negatives per positive.
POSITIVES, NEGATIVES = 5, 5
#: Reference directions, and the rows from which they are picked.
REFERENCES, SAMPLE = 12, 1024
#: Anchors, and bytes of them, in one pass over the rows.
ANCHORS, ANCHOR_BYTES = 65536, 64 << 20
#: Rows and anchors that are held against each other at once.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 2048, 512
#: Share of the norms by which score bounds are widened: angles have four bytes, so a cosine is off by less than 1e-6.
SLACK = 2e-6

PREPARED = "id long, label long, vector binary, norm double, angles binary, nearest int"


def takes_part(label: str, vector: str) -> Column:
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & good


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors, filled with zeros up to ``dims``."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 1 << 31:
        raise OverflowError("a component has no 32-bit integer")
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def angles_to(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to unit directions; a zero vector, which scores 0 with everything, has right angles."""
    return np.arccos(np.clip(vectors @ references.T / np.maximum(norms, 1e-300)[:, None], -1, 1)).astype(np.float32)


def pick_references(vectors: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions out of ``vectors``, each the farthest from those before."""
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.eye(1, vectors.shape[1])
    picked, nearest = [0], units @ units[0]
    while len(picked) < min(count, len(units)) and nearest.min() < 1 - 1e-9:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[picked[-1]])
    return units[picked]


def _prepare(dims: int, references: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(2), dims)
            norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
            angles = angles_to(vectors, norms, references)
            small = vectors.astype(np.int32)
            columns = [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(norms), pa.array([x.tobytes() for x in angles], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(angles.argmin(1).astype(np.int32))], ["id", "label", "vector", "norm", "angles", "nearest"])

    return run


def prepare(rows: DataFrame, id_col: str, label: str, vector: str) -> DataFrame:
    """Written table of the rows that take part: integer vector, norm, angles, a number ``row`` of its own; alike rows lie together."""
    taking = rows.filter(takes_part(label, vector)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    n, dims = taking.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    every = max(1, n // SAMPLE)
    sample = taking.filter(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(every)) == 0).select("vector").limit(4 * SAMPLE).toArrow()["vector"].combine_chunks()
    references = pick_references(_matrix(sample, max(dims, 1))) if len(sample) else np.eye(1, max(dims, 1))
    made = taking.mapInArrow(_prepare(max(dims, 1), references), PREPARED).sortWithinPartitions("label", "nearest", "id")
    return checkpointed(made.withColumn("row", F.monotonically_increasing_id()))


@dataclass
class Block:
    """Rows or anchors as arrays."""

    row: np.ndarray
    id: np.ndarray
    null: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    norm: np.ndarray
    angle: np.ndarray

    @classmethod
    def of(cls, t: pa.RecordBatch | pa.Table) -> Block:
        one = lambda c: t.column(c).combine_chunks() if isinstance(t, pa.Table) else t.column(c)
        number = lambda c: one(c).to_numpy(zero_copy_only=False)
        wide = lambda c, kind: np.frombuffer(b"".join(one(c).to_pylist()), kind).reshape(t.num_rows, -1)
        null = one("id").is_null().to_numpy(zero_copy_only=False)
        ids = one("id").fill_null(0).to_numpy(zero_copy_only=False)
        return cls(number("row"), ids, null, number("label"), wide("vector", np.int32).astype(np.float64), number("norm"), wide("angles", np.float32).astype(np.float64))

    def __len__(self) -> int:
        return len(self.row)

    def take(self, at: np.ndarray | slice) -> Block:
        return Block(*(getattr(self, f)[at] for f in self.__dataclass_fields__))


def score_bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each pair, by the triangle inequality at every reference."""
    ca, sa, cb, sb = np.cos(a.angle), np.sin(a.angle), np.cos(b.angle), np.sin(b.angle)
    low, high = np.full((len(a), len(b)), -1.0), np.full((len(a), len(b)), 1.0)
    for r in range(ca.shape[1]):
        both, across = np.outer(ca[:, r], cb[:, r]), np.outer(sa[:, r], sb[:, r])
        np.minimum(high, both + across, out=high)  # the cosine of the angles' difference
        np.maximum(low, both - across, out=low)  # the cosine of their sum
    norms = np.outer(a.norm, b.norm)
    slack = SLACK * norms + 1e-3
    return low * norms - slack, high * norms + slack


def slice_bound(a: Block, b: Block) -> np.ndarray:
    """What no row of ``b`` can exceed, for each anchor, by the extreme angles and norms of ``b`` alone."""
    apart = np.maximum(b.angle.min(0) - a.angle, a.angle - b.angle.max(0)).max(1)
    cosine = np.cos(np.maximum(apart, 0))
    most = np.where(cosine > 0, b.norm.max(), b.norm.min()) * a.norm
    return cosine * most + SLACK * a.norm * b.norm.max() + 1e-3


def scores(a: Block, b: Block, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and integer score of the wanted pairs."""
    i, j = np.nonzero(wanted)
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    exact = a.norm.max() * b.norm.max()  # no sum of products is larger
    if exact >= 1 << 62:
        raise OverflowError("a score has no 64-bit integer")
    kind = np.float64 if exact < 1 << 52 else np.int64
    if len(i) * 8 > wanted.size:
        got = (a.vector.astype(kind) @ b.vector.astype(kind).T)[i, j]
    else:
        got = np.concatenate([np.einsum("ij,ij->i", a.vector[i[k : k + 65536]].astype(kind), b.vector[j[k : k + 65536]].astype(kind)) for k in range(0, len(i), 65536)])
    return i, j, got.astype(np.int64)


class Best:
    """The best ``k`` rows of each slot so far: score down, id up, null ids last."""

    def __init__(self, slots: int, k: int, floor: np.ndarray) -> None:
        self._k, self._slots = k, slots
        self.floor = floor.astype(np.float64)  # a score that counts is at least this
        self._tie = np.full(slots, np.inf)  # and at the floor has a smaller id than this
        self.slot, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        new = (score > self.floor[slot]) | (score == self.floor[slot]) & (np.where(null, np.inf, ids) <= self._tie[slot])
        if not new.any():
            return
        self.slot, self.score, self.id, self.null = (np.concatenate([x, y[new]]) for x, y in ((self.slot, slot), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((self.id, self.null, -self.score, self.slot))
        self.slot, self.score, self.id, self.null = (x[order] for x in (self.slot, self.score, self.id, self.null))
        nth = np.arange(len(order)) - np.searchsorted(self.slot, self.slot)
        keep = nth < self._k
        full = nth == self._k - 1
        self.floor[self.slot[full]] = self.score[full]
        self._tie[self.slot[full]] = np.where(self.null[full], np.inf, self.id[full])
        self.slot, self.score, self.id, self.null = (x[keep] for x in (self.slot, self.score, self.id, self.null))

    def columns(self, anchor: np.ndarray, window: np.ndarray | None = None) -> pa.RecordBatch:
        cols = [pa.array(anchor[self.slot]), pa.array(self.score if window is None else window[self.slot]), pa.array(self.score), pa.array(self.id, mask=self.null)]
        return pa.RecordBatch.from_arrays(cols, ["anchor", "window", "score", "id"])


FOUND = "anchor long, window long, score long, id long"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Rows of one label and nearest reference at a time."""
    for batch in batches:
        whole = Block.of(batch)
        nearest = batch.column("nearest").to_numpy()
        edges = np.flatnonzero(np.diff(whole.label, prepend=whole.label[:1] - 1) | np.diff(nearest, prepend=-1)) if len(whole) else []
        for a, b in zip(edges, [*edges[1:], len(whole)], strict=True):
            for k in range(a, b, ROWS_AT_ONCE):
                yield whole.take(slice(k, min(b, k + ROWS_AT_ONCE)))


def _positives(anchors: Block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for label in np.unique(anchors.label):
            at = np.flatnonzero(anchors.label == label)
            parts[label] = [(p := at[x : x + ANCHORS_AT_ONCE], Best(len(p), k, np.full(len(p), -np.inf))) for x in range(0, len(at), ANCHORS_AT_ONCE)]
        for rows in _slices(batches):
            for at, best in parts.get(rows.label[0], ()):
                near = np.flatnonzero(slice_bound(anchors.take(at), rows) >= best.floor)
                if len(near):
                    own = anchors.take(at[near])
                    _, high = score_bounds(own, rows)
                    i, j, got = scores(own, rows, (high >= best.floor[near][:, None]) & (own.row[:, None] != rows.row))
                    best.add(near[i], got, rows.id[j], rows.null[j])
        for part in parts.values():
            for at, best in part:
                if len(best.slot):
                    yield best.columns(anchors.row[at])

    return run


def _negatives(anchors: Block, tops: np.ndarray, share: tuple[int, int], k: int):
    """``tops``: positive scores of each anchor as columns, -1 where there is none."""
    part, whole = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for x in range(0, len(anchors), ANCHORS_AT_ONCE):
            top = tops[x : x + ANCHORS_AT_ONCE].ravel()
            # where there is no window nothing reaches the floor
            parts.append((slice(x, x + ANCHORS_AT_ONCE), top, Best(len(top), k, np.where(top >= 0, -(-part * top // whole), np.inf))))
        width = tops.shape[1]
        for rows in _slices(batches):
            for at, top, best in parts:
                own = anchors.take(at)
                floor = best.floor.reshape(-1, width)
                near = np.flatnonzero((slice_bound(own, rows) >= floor.min(1)) & (own.label != rows.label[0]))
                if not len(near):
                    continue
                own, floor, most = own.take(near), floor[near], top.reshape(-1, width)[near]
                low, high = score_bounds(own, rows)
                overlap = np.zeros(low.shape, bool)
                for w in range(width):
                    overlap |= (high >= floor[:, w, None]) & (low <= most[:, w, None])
                i, j, got = scores(own, rows, overlap)
                for w in range(width):
                    in_window = (got >= floor[i, w]) & (got <= most[i, w])
                    a, b = i[in_window], j[in_window]
                    best.add(near[a] * width + w, got[in_window], rows.id[b], rows.null[b])
        for at, top, best in parts:
            if len(best.slot):
                yield best.columns(np.repeat(anchors.row[at], width), top)

    return run


def _merged(found: DataFrame, k: int, *key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return checkpointed(found.withColumn("rank", rank).filter(F.col("rank") <= k))


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (80, 100), anchors_at_once: int = ANCHORS
) -> DataFrame:
    """One row per anchor, positive and negative: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition on the column ``id``. A negative's score is at
    least ``share[0] / share[1]`` of the positive's and at most the positive's.
    """
    all_rows = prepare(rows, id_col, label, vector)
    anchors = checkpointed(all_rows.filter(F.col("id").isNotNull() & anchor))
    size = F.octet_length("vector") + F.octet_length("angles") + F.lit(64)
    out = []
    for block in query_blocks(anchors, "row", size, anchors_at_once, ANCHOR_BYTES):
        own = Block.of(block.toArrow())
        best = _merged(all_rows.mapInArrow(_positives(own, positives), FOUND), positives, "anchor")
        tops = np.full((len(own), positives), -1, np.int64)
        order = np.argsort(own.row)
        place = {int(r): int(i) for r, i in zip(own.row[order], order, strict=True)}
        for r in best.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("scores")).collect():
            tops[place[r["anchor"]], : len(r["scores"])] = r["scores"]  # a few numbers per anchor of the block
        tops = np.maximum(tops, -1)  # no score is between 80 % and all of a negative one
        bad = _merged(all_rows.mapInArrow(_negatives(own, tops, share, negatives), FOUND), negatives, "anchor", "window")
        named = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("window"))
        pairs = named.join(bad, ["anchor", "window"]).join(block.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        out.append(pairs.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")))
    if not out:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionAll(more)
    return result


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c AS (SELECT r, vec_id, label, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score
      FROM c a JOIN c b ON a.i = b.i AND a.r <> b.r WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id NULLS LAST)::INT AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= {NEGATIVES}
"""
