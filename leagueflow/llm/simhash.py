"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits,
each read as a word of 23 bits. The [23, 12] Golay code is perfect with radius
3: every word has one codeword within distance 3, and all codewords within
distance 4 are that one, or that one and five more. Two words that differ in
at most 2 bits have a word between them, 1 bit from either, and its codeword
is within distance 4 of both. So they share an entry of their lists.

Four errors fall on the three segments in one of two ways. Either a segment
has none, and then one of the other two has at most 2: keys of the first kind
are the bits of one segment with an entry of another's list (34 bits, 6 x at
most 6 keys). Or every segment has one, and then none has more than 2: keys of
the second kind are an entry of each of the three lists (36 bits, at most 216
keys). Any two fingerprints to be linked share a key; far ones meet in about 2
keys for a million pairs. The pairs within a key are verified by their distance.

Fingerprints are made distinct first, so copies of a text meet as one row.
Within a key the verified pairs are folded into stars at once (each
fingerprint to the smallest one that it hangs together with), which keeps all
that matters for components and never writes the pairs of a group out.

Defined results for odd input: a null text counts as empty; a text without
words has fingerprint zero; repeated rows each get their row; a null id never
is the smallest; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, table
from leagueflow.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42

#: Segments of the fingerprint: lowest bit and length. The code word has 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Shingles of one text that are held as bits at a time.
BLOCK = 1 << 16


def simhash(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - words_in_shingle + 1)
    starts = (ends - sizes)[:n].tolist()
    stops = ends[len(words) - n :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pieces = [joined[a:b] for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(HASH_SEED)), np.uint64, len(pieces))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of polynomials of degree 22 and less by the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def golay_patterns() -> np.ndarray:
    """For each of the 2048 remainders the error words of weight 4 and less: 1 or 6, filled up with -1."""
    bits = 1 << np.arange(23, dtype=np.int64)
    weights = [np.zeros(1, np.int64)]
    for w in range(1, 5):
        grown = (weights[-1][:, None] | bits[None, :]).ravel()
        weights.append(np.unique(grown[np.bitwise_count(grown) == w]))
    out = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for errors in weights:
        rest = _remainder(errors)
        order = np.argsort(rest, kind="stable")
        rest, errors = rest[order], errors[order]
        nth = np.arange(len(rest)) - np.searchsorted(rest, rest)
        out[rest, used[rest] + nth] = errors
        used += np.bincount(rest, minlength=2048)
    return out


def segment_words(fingerprints: np.ndarray, segment: int) -> np.ndarray:
    low, size = SEGMENTS[segment]
    return (fingerprints >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64)


def near_indices(words: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """For each word the indices (12 bits) of the codewords near it; -1 fills up."""
    errors = patterns[_remainder(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(fingerprints: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and for each the place of its fingerprint."""
    words = [segment_words(fingerprints, k) for k in range(3)]
    near = [near_indices(w, patterns) for w in words]
    keys, places = [], []

    def add(kind: int, key: np.ndarray, real: np.ndarray) -> None:
        keys.append(kind << 40 | key[real])
        places.append(np.nonzero(real)[0])

    for kind, (i, j) in enumerate(permutations(range(3), 2)):
        add(kind, words[i][:, None] << 12 | near[j], near[j] >= 0)
    a, b, c = near[0][:, :, None, None], near[1][:, None, :, None], near[2][:, None, None, :]
    add(6, a << 24 | b << 12 | c, (a >= 0) & (b >= 0) & (c >= 0))
    return np.concatenate(keys), np.concatenate(places)


def stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: each node but the smallest of its component, and that smallest one."""
    nodes, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = places[: len(left)], places[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _linked(keys: np.ndarray, prints: np.ndarray, max_bits: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the pairs of one key that differ in few bits. ``keys`` is sorted and its groups are whole."""
    _, first, inverse, size = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    after = first[inverse] + size[inverse] - np.arange(len(keys)) - 1  # rows of the key that follow
    unsigned = prints.view(np.uint64)
    left, right, held, distance = [], [], 0, 1
    at = np.nonzero(after >= 1)[0]
    while len(at):
        near = at[np.bitwise_count(unsigned[at] ^ unsigned[at + distance]) <= max_bits]
        if len(near):
            left.append(prints[near])
            right.append(prints[near + distance])
            held += len(near)
            if held > most:
                a, b = stars(np.concatenate(left), np.concatenate(right))
                left, right, held = [a], [b], len(a)
        distance += 1
        at = at[after[at] >= distance]
    if not left:
        return prints[:0], prints[:0]
    return stars(np.concatenate(left), np.concatenate(right))


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(k, v, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        # rows come sorted by key; the last key of a batch waits for the next batch
        parts, pending = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            pending += batch.num_rows
            if pending < 1 << 17 or parts[0][0][0] == parts[-1][0][-1]:
                continue
            key, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            yield out(key[:cut], value[:cut])
            parts, pending = [(key[cut:], value[cut:])], len(key) - cut
        if pending:
            yield out(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _fingerprints(words_in_shingle: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t, words_in_shingle) for t in batch.column(keep).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(prints.view(np.int64))], [*batch.schema.names[:keep], "fp"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    patterns = golay_patterns()
    for batch in batches:
        for part in range(0, batch.num_rows, 1000):
            prints = batch.column(0).slice(part, 1000).to_numpy(zero_copy_only=False)
            keys, places = fuzzy_keys(prints.view(np.uint64), patterns)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[places])], ["key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``id``, ``body`` (a hash of the text) and ``fp`` (the fingerprint as a signed long) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(words_in_shingle, 2), f"id {kind}, body long, fp long")


def fingerprint_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp`` and ``root`` of all distinct fingerprints that hang together with a smaller one."""
    if max_bits > 4:
        raise ValueError("the keys find all pairs only up to 4 differing bits")
    distinct = prints.select("fp").distinct()
    keyed = distinct.mapInArrow(_keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    links = keyed.mapInArrow(_links(max_bits), "a long, b long")
    return connected_components(links).select(F.col("node").alias("fp"), "root")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_in_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``id``, ``body``, ``fp`` and ``component_id`` (the smallest id that can be reached) of each row."""
    prints = checkpointed(fingerprints(docs, id_col, text, words_in_shingle))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    # both sides of the join on a root are written tables, so the join can split a component with very many fingerprints
    rooted = checkpointed(classes.join(fingerprint_components(prints, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_in_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one with the smallest id, ties to the smaller hash of the text."""
    groups = near_duplicate_groups(docs, id_col, text, words_in_shingle, max_bits)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body"))
    stays = groups.groupBy("root").agg(first.alias("s")).select(F.col("s.id").alias("__id"), F.col("s.body").alias("__body"))
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kept = docs.join(stays, F.col(id_col).eqNullSafe(F.col("__id")) & (body == F.col("__body")))
    # rows that agree in id and text are one document
    nth = F.row_number().over(Window.partitionBy("__id", "__body").orderBy("__id"))
    return kept.withColumn("__nth", nth).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
