"""Language-model scores from a weighted back-off automaton.

The model is an n-gram model (three words by default) with a Dirichlet prior
at each order: after the history h, the next word w has probability
(c(hw) + m p(w | h')) / (c(h) + m), where h' is h without its first word and
p(w) at the end is the unigram probability with absolute discounting. As an
automaton: each seen history of up to n-1 words is a state, and so is the
start of a text. A state has an arc for each word that was seen after it, and
a failure arc with weight m / (c(h) + m) to the state of h'; the root has an
arc for every word. A text is read once from left to right. The state is
carried along: an arc lengthens its history, up to n-1 words, a failure arc
shortens it, and the weights of all arcs taken add up.

The automaton of a large corpus fits into no task, so each task gets the part
that its texts can reach. Texts form blocks of bounded size. A block sends its
distinct words, pairs and longer grams, as sorted hashes with their counts in
training texts, to the hash ranges; a range sums what all blocks sent and
answers each block with the totals, in the order of its question. The block's
texts come to the answer as word numbers and are read there, all texts of the
block in step. Counts cover all training texts; nothing is pruned.

Defined results for odd input: a null text is empty and consists of its end; a
null id is neither held out nor learned from; with nothing to learn from all
probabilities are 1; repeated rows each get their row; an empty table gives no
rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, table
from leagueflow.llm.tokens import slices, words

#: Words in the longest gram.
ORDER = 3
#: Weight of the prior of pairs, triples and so on (the last one holds for longer grams): so many words of evidence.
PRIORS = (100.0, 5.0)
#: Bits of the hash of a gram; words have 64. With 10^13 different grams, one unseen gram in 7,000 would meet another's count.
GRAM_BITS = 56
#: Bytes of questions that a hash range should get, and what a byte of text asks.
RANGE_BYTES, ASKED = 32 << 20, 1.7
#: Tokens of a text that are read in one go; its next piece starts in the state that the last words before it lead to.
PIECE = 256
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Tokens of a block that are read at a time, in whole texts: their weights take far more than the counts.
SCORED = 1 << 18
#: Hashes of the start and the end of a text, which are no words.
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (" start", " end"))

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token (the words of each text, then its end) and the tokens of each text."""
    numbers, dictionary, sizes = words(pc.ascii_lower(column))
    codes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in dictionary.to_pylist()), np.uint64, len(dictionary))
    out = np.full(len(numbers) + len(sizes), END)
    place = np.arange(len(numbers)) + np.repeat(np.arange(len(sizes)), sizes)
    out[place] = codes[numbers] if len(numbers) else codes[:0]
    return out, sizes + 1


def grams(tokens: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 to ``order`` words: the places at which such a gram ends, and its hash.

    The start of a text stands before its first word; no gram goes further back.
    """
    begins = np.cumsum(sizes) - sizes
    offset = np.arange(len(tokens)) - np.repeat(begins, sizes)
    last = tokens
    for k in range(2, order + 1):
        before = np.empty_like(last)
        before[1:] = last[:-1]
        if k == 2:
            before[begins] = START
        h = before * _A + tokens * _B
        h ^= h >> np.uint64(32)
        last = (h * _A) >> np.uint64(64 - GRAM_BITS)
        del before, h
        places = np.flatnonzero(offset >= k - 2)
        yield places, last[places]


def distinct_grams(hashes: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and how many of each are learned from."""
    both = (hashes << np.uint64(1)) | learned.astype(np.uint64)
    both.sort()
    sorted_ = both >> np.uint64(1)
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(both) else np.zeros(0, np.int64)
    counts = np.add.reduceat(both & np.uint64(1), first) if len(both) else both
    return sorted_[first], counts.astype(np.uint32)


@dataclass
class Block:
    """Texts with their tokens. ``name`` depends on the content alone."""

    ids: pa.Array
    train: np.ndarray
    held_out: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray

    @property
    def name(self) -> int:
        return np.int64(np.uint64(xxhash.xxh64_intdigest(self.tokens.tobytes() + self.sizes.tobytes() + self.train.tobytes() + str(self.ids).encode()))).item()


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Block]:
    """Batches of (id, train, held_out, text) as blocks."""
    held: list[tuple] = []
    size = 0

    def join() -> Block:
        ids, train, out, tokens, sizes = zip(*held, strict=True)
        return Block(pa.concat_arrays(ids), *(np.concatenate(x) for x in (train, out, tokens, sizes)))

    for batch in batches:
        for part in slices(batch, 3, min(most, 4 << 20)):
            tokens, sizes = token_hashes(part.column(3))
            held.append((part.column(0), *(part.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (1, 2)), tokens, sizes))
            size += part.column(3).nbytes
            if size >= most:
                block, held, size = join(), [], 0
                yield block
                del block
    if held:
        block, held = join(), []
        yield block


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers as their steps: the low bytes as they are, the highest, whose values are few, compressed."""
    if not len(x):
        return b""
    steps = np.diff(x)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return x[:1].tobytes() + bytes([width]) + len(steps).to_bytes(8, "little") + planes[:-1].tobytes() + _pack(planes[-1])


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width, n = b[8], int.from_bytes(b[9:17], "little")
    low = (width - 1) * n
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : width - 1] = np.frombuffer(b, np.uint8, low, 17).reshape(width - 1, n).T
    steps[:, width - 1] = _unpack(b[17 + low :], np.uint8)
    return np.cumsum(np.append(np.frombuffer(b, np.uint64, 1), steps.view(np.uint64).ravel()), dtype=np.uint64)


def pack_numbers(x: np.ndarray) -> list[bytes]:
    """Each byte of 32-bit numbers by itself."""
    return [_pack(plane) for plane in np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)]


def unpack_numbers(planes: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.stack([_unpack(p, np.uint8) for p in planes], 1)).view(np.uint32).ravel()


def _ranges(hashes: np.ndarray, buckets: int, bits: int) -> list[np.ndarray]:
    """Sorted hashes cut into ``buckets`` equal ranges: where each begins and ends."""
    edges = [np.uint64((k << bits) // buckets) for k in range(buckets)]
    cut = np.append(np.searchsorted(hashes, np.array(edges, np.uint64)), len(hashes))
    return list(zip(cut[:-1], cut[1:], strict=True))


def _asked(block: Block, learned: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct words, then pairs and so on, each with their counts in training texts; one length is held at a time."""
    distinct, inverse = np.unique(block.tokens, return_inverse=True)
    counts = np.bincount(inverse[learned], minlength=len(distinct)).astype(np.uint32)
    del inverse
    yield distinct, counts
    for places, hashes in grams(block.tokens, block.sizes, order):
        yield distinct_grams(hashes, learned[places])


def _questions(most: int, buckets: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most):
            learned = np.repeat(block.train, block.sizes)
            columns = [pa.array(np.full(buckets, block.name)), pa.array(np.arange(buckets))]
            for k, (distinct, counts) in enumerate(_asked(block, learned, order)):
                parts = _ranges(distinct, buckets, GRAM_BITS if k else 64)
                columns += [pa.array([pack_sorted(distinct[a:b]) for a, b in parts], pa.binary()), pa.array([_pack(counts[a:b]) for a, b in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", *(f"{x}{k}" for k in range(1, order + 1) for x in ("asked", "counts"))])

    return run


def _answers(order: int):
    """Totals over all blocks for what each block asked of one hash range, and what the range knows of the corpus."""

    def run(bucket: pa.Table) -> pa.Table:
        out, facts = [], None
        for k in range(1, order + 1):
            asked = [unpack_sorted(x.as_py()) for x in bucket[f"asked{k}"]]
            lengths = [len(a) for a in asked]
            asked = np.concatenate(asked)
            inverse = np.unique(asked, return_inverse=True)[1]
            del asked
            counts = np.concatenate([_unpack(x.as_py(), np.uint32) for x in bucket[f"counts{k}"]])
            totals = np.bincount(inverse, counts).astype(np.int64)
            del counts
            if k == 1:
                facts = [int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum())]
            # totals that fit are sent in four bytes
            wide = np.int64 if len(totals) and totals.max() > 0xFFFFFFFF else np.uint32
            each = np.split(totals.astype(wide)[inverse], np.cumsum(lengths)[:-1])
            del inverse
            out.append(pa.array([bytes([np.dtype(wide).itemsize]) + _pack(x) for x in each], pa.binary()))
        n = bucket.num_rows
        # the facts of a range stand in one of its rows
        known = [pa.array([f] + [0] * (n - 1), pa.int64()) for f in facts]
        return pa.table([bucket["block"], bucket["bucket"], *out, *known], ["block", "bucket", *(f"total{k}" for k in range(1, order + 1)), "n", "v", "n1", "n2"])

    return run


def _texts(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most):
            distinct, numbers, often = np.unique(block.tokens, return_inverse=True, return_counts=True)
            place = np.empty(len(distinct), np.int64)
            place[np.argsort(-often, kind="stable")] = np.arange(len(distinct))  # frequent words have small numbers
            columns = [pa.array([block.name]), pa.array([block.ids.to_pylist()], pa.list_(block.ids.type)), pa.array([block.held_out.tobytes()], pa.binary())]
            columns += [pa.array([x], pa.binary()) for x in (_pack(block.sizes), pack_sorted(distinct))]
            columns += [pa.array([x], pa.list_(pa.binary())) for x in (pack_numbers(place), pack_numbers(place[numbers]))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "held_out", "sizes", "words", "places", "numbers"])

    return run


@dataclass(frozen=True)
class Corpus:
    """Training tokens, distinct ones, and the discount."""

    n: int
    v: int
    discount: float

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probability of words with these counts; unseen words share what V + 1 classes get by the discount."""
        if not self.n:
            return np.full(len(c), 1.0 / (self.v + 1))
        return np.maximum(c - self.discount, 0) / self.n + self.discount * self.v / (self.n * (self.v + 1.0))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.n + (self.v + 1.0)))


def arc_weights(corpus: Corpus, counts: np.ndarray, begins: np.ndarray, texts: int, priors: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the arcs and failure arcs at each place, a row per length of the state's history.

    Row k of ``counts`` has the training counts of the grams of k + 1 words
    that end at each place; ``texts`` is the count of the start.
    """
    arcs, fails = np.empty(counts.shape), np.zeros(counts.shape)
    p = corpus.unigram(counts[0])
    arcs[0] = np.log10(p)
    for k in range(1, len(counts)):
        m = priors[min(k, len(priors)) - 1]
        state = np.zeros(counts.shape[1])
        state[1:] = counts[k - 1][:-1]
        state[begins] = texts if k == 1 else 0
        p = (counts[k] + m * p) / (state + m)
        arcs[k], fails[k] = np.log10(p), np.log10(m / (state + m))
    return arcs, fails


def traverse(counts: np.ndarray, arcs: np.ndarray, fails: np.ndarray, sizes: np.ndarray, started: bool) -> np.ndarray:
    """Weight of each token when the automaton reads every text from left to right.

    ``started``: the start of a text is a state. All texts are read in step;
    long ones in pieces that read the words before them first, which leads to
    the same state, as it depends on no earlier word.
    """
    longest = len(counts) - 1
    out = np.zeros(counts.shape[1])
    pieces = -(-sizes // PIECE)
    offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    place = np.repeat(np.cumsum(sizes) - sizes, pieces) + offset
    length = np.minimum(np.repeat(sizes, pieces) - offset, PIECE)
    lead = np.where(offset > 0, longest, 0)  # a piece is longer than any history
    state = np.where(offset > 0, 0, min(longest, int(started)))
    order = np.argsort(-(length + lead), kind="stable")
    at, steps, lead, state = (place - lead)[order], (length + lead)[order], lead[order], state[order]
    active = np.searchsorted(-steps, -np.arange(steps[0] if len(steps) else 0), "left")
    for t, n in enumerate(active):
        here, now = at[:n] + t, state[:n]
        weight = np.zeros(n)
        go = np.arange(n)  # those that have not found an arc yet
        while len(go):
            level, x = now[go], here[go]
            seen = counts[level, x] > 0
            arc = seen | (level == 0)
            weight[go] += np.where(arc, arcs[level, x], fails[level, x])
            now[go] = np.where(arc, np.where(seen, np.minimum(level + 1, longest), 0), level - 1)
            go = go[~arc]
        own = t >= lead[:n]
        out[here[own]] = weight[own]
    return out


def _score(corpus: Corpus, priors: tuple[float, ...], buckets: int, order: int):
    def totals(answers: pa.Table, k: int) -> np.ndarray:
        parts = [(_unpack(x[1:], np.int64 if x[0] == 8 else np.uint32)) for x in answers[f"total{k}"].to_pylist()]
        return np.concatenate(parts)  # four bytes each, unless one of them needs more

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        alike = texts.num_rows  # blocks of one name have the same rows
        if not alike or answers.num_rows != alike * buckets:
            raise ValueError("the frame was cut into other partitions when it was read again: write it as a table first")
        row = texts.slice(0, 1).to_pylist()[0]
        answers = answers.sort_by("bucket").take(list(range(0, alike * buckets, alike)))
        sizes, distinct, place = _unpack(row["sizes"], np.int64), unpack_sorted(row["words"]), unpack_numbers(row["places"])
        numbers = np.argsort(place)[unpack_numbers(row["numbers"])]
        known = totals(answers, 1)
        learned = int(known[np.searchsorted(distinct, END)])  # as many texts start as end
        counts = [known[numbers]]
        tokens = distinct[numbers]
        del numbers, place
        for k, (places, hashes) in enumerate(grams(tokens, sizes, order), 2):
            inverse = np.unique(hashes, return_inverse=True)[1]
            own = totals(answers, k)
            counts.append(np.zeros(len(tokens), own.dtype))
            counts[-1][places] = own[inverse]
            del places, hashes, inverse, own
        del tokens
        begins = np.cumsum(sizes) - sizes
        seen, base, score = np.empty(len(sizes), np.int64), np.empty(len(sizes)), np.empty(len(sizes))
        edges = np.flatnonzero(np.diff(begins // SCORED, prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(sizes)], strict=True):
            each, first = sizes[a:b], begins[a:b] - begins[a]
            some = np.stack([c[begins[a] : begins[b - 1] + sizes[b - 1]].astype(np.int64) for c in counts])
            weights = traverse(some, *arc_weights(corpus, some, first, learned, priors), each, learned > 0)
            for out, x in ((seen, (some[0] > 0).astype(np.int64)), (base, corpus.base(some[0])), (score, weights)):
                out[a:b] = np.add.reduceat(x, first)
        columns = [
            pa.array(row["ids"], texts.schema.field("ids").type.value_type),
            pa.array(np.frombuffer(row["held_out"], bool)),
            pa.array(sizes),
            pa.array(seen),
            pa.array(np.full(len(sizes), corpus.n)),
            pa.array(base),
            pa.array(score),
        ]
        scored = pa.table(columns, [c.split()[0] for c in SCORE_COLUMNS.split(", ")])
        return pa.concat_tables([scored] * alike)

    return run


SCORE_COLUMNS = "id _, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(
    docs: DataFrame, train: Column, held_out: Column, id_col: str = "doc_id", text: str = "text", order: int = ORDER,
    priors: tuple[float, ...] = PRIORS, block_bytes: int = BLOCK_BYTES, buckets: int | None = None,
) -> DataFrame:
    """One row per document: ``id``, ``held_out`` and the counts and scores of the contract.

    ``docs`` is read twice and has to come in the same partitions, as a table
    does; other partitions are noticed and refused. ``order`` (1 or more) is
    the number of words in the longest gram. ``buckets`` is the number of hash
    ranges, each of which comes together in one task: by default as many as the
    counted bytes of text need, and no fewer than the session's shuffle
    partitions.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if buckets is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * ASKED * order / ORDER / RANGE_BYTES))
    kind = rows.schema["id"].dataType.simpleString()
    each = range(1, order + 1)
    asked = rows.mapInArrow(_questions(block_bytes, buckets, order), "block long, bucket long, " + ", ".join(f"asked{k} binary, counts{k} binary" for k in each))
    told = ", ".join(f"total{k} binary" for k in each)
    answers = checkpointed(asked.groupBy("bucket").applyInArrow(_answers(order), f"block long, bucket long, {told}, n long, v long, n1 long, n2 long"))
    n, v, once, twice = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2")]).first()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    texts = rows.mapInArrow(_texts(block_bytes), f"block long, ids array<{kind}>, held_out binary, sizes binary, words binary, places array<binary>, numbers array<binary>")
    answers = answers.drop("n", "v", "n1", "n2")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(Corpus(n, v, discount), priors, buckets, order), SCORE_COLUMNS.replace("_", kind, 1))


#: Documents whose crc32 has this remainder by 7 are held out.
HELD_OUT = 2


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    scored = score_texts(docs, remainder != HELD_OUT, remainder == HELD_OUT)
    return scored.withColumnRenamed("id", "doc_id")
