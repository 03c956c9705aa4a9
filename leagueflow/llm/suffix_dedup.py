"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays.

A byte goes when a string of ``size`` bytes that covers it also starts
somewhere else. The work is arranged so that each suffix array stays small and
strings that could be equal always meet.

1. Stretches. Every window of ``size`` bytes has a key: the least hash among
   its k-mers. Neighbouring windows mostly share their key; such a run of
   windows, with the bytes they cover, is a stretch. Equal windows have equal
   keys, so a window's partners are all in stretches of its key.
2. Questions. Each block of documents asks the hash ranges which of its
   stretches occur elsewhere as a whole, and which of its keys have other
   stretches. A block asks once for a stretch that it has many times, so a hot
   stretch comes once per block. Stretches that repeat as a whole go entirely.
3. Shards. Only stretches whose key has several different ones remain; their
   bytes go to a shard by key. The shard builds a suffix array (Larsson-
   Sadakane) and the common prefixes (Kasai): a window repeats when it shares
   ``size`` bytes with a neighbour in the array.
4. A key with very many different stretches is dealt to several shards. Each
   of those sends the hashes of its distinct windows, sorted, to hash ranges,
   where the shards' lists are merged by binary search.

Defined results for odd input: null and empty texts have no bytes; a text
shorter than ``size`` loses nothing; equal rows are different places, so they
repeat each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.llm.common import checkpointed, table
from leagueflow.llm.suffixes import repeated_starts
from leagueflow.llm.tokens import slices

#: Bytes of a string that counts as repeated, and of the k-mers that make its key (at least 8).
SIZE, KMER = 400, 96
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Stretches in a shard.
SHARD_STRETCHES = 4096

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A + b * _B
    return h ^ h >> np.uint64(32)


def kmer_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from each place on."""
    h = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)).view(np.uint64).ravel()
    size = 8
    while size < k:
        step = min(size, k - size)
        h = _mix(h[:-step], h[step:])
        size += step
    return _mix(h, h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return h


def stretches(text: bytes, size: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, key, hash of the bytes, and whether a window may equal another one inside."""
    empty = np.zeros(0, np.int64)
    if len(text) < size:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    h = kmer_hashes(np.frombuffer(text, np.uint8), kmer)
    width = size - kmer + 1
    m = window_minima(h, width)
    begin = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    end = np.append(begin[1:], len(m))
    edges = list(zip(begin.tolist(), end.tolist(), strict=True))
    body = np.fromiter((xxhash.xxh3_64_intdigest(text[a : b + size - 1]) for a, b in edges), np.uint64, len(edges))
    # equal windows of a stretch put its key at two places
    inside = np.fromiter((np.count_nonzero(h[a : b + width - 1] == m[a]) > 1 for a, b in edges), bool, len(edges))
    # minima are small numbers; spread them over all hashes, one to one
    key = m[begin] * _A
    return begin, end - begin, (key ^ key >> np.uint64(32)) * _B, body, inside


def _pack(x: np.ndarray | bytes) -> bytes:
    return zlib.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes(), 1)


def _unpack(x: bytes, kind: type | str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


#: Of a block: sizes of the texts, the texts, and of each stretch its text, first window, windows, key, hash and inner repeats.
BLOCK_PARTS = (("sizes", np.int64), ("bytes", np.uint8), ("text", np.uint32), ("start", np.int64), ("windows", np.int64), ("key", np.uint64), ("body", np.uint64), ("inside", bool))


def _blocks(size: int, kmer: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, parts, held, made = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            number = np.concatenate([np.full(len(p[0]), i, np.uint32) for i, p in enumerate(parts)])
            sizes = np.array([len(t) for t in texts], np.int64)
            values = [sizes, b"".join(texts), number, *(np.concatenate(x) for x in zip(*parts, strict=True))]
            name = TaskContext.get().partitionId() << 32 | made
            columns = [pa.array([name]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([_pack(v)], pa.binary()) for v in values)], ["block", "ids", *(n for n, _ in BLOCK_PARTS)])

        for batch in batches:
            for piece in slices(batch, 1, most):
                for i, text in enumerate(piece.column(1).cast(pa.binary()).to_pylist()):
                    ids.append(piece.column(0).slice(i, 1))
                    texts.append(text or b"")
                    parts.append(stretches(texts[-1], size, kmer))
                    held += len(texts[-1])
                    if held >= most:
                        yield block()
                        ids, texts, parts, held, made = [], [], [], 0, made + 1
        if texts:
            yield block()

    return run


def _ranges(sorted_hashes: np.ndarray, buckets: int) -> list[slice]:
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    cut = np.append(np.searchsorted(sorted_hashes, edges), len(sorted_hashes))
    return [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def distinct_stretches(body: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the first of each distinct stretch in order of its hash, how often it occurs, and each stretch's number."""
    order = np.lexsort((key, body))
    new = np.ones(len(order), bool)
    new[1:] = (body[order][1:] != body[order][:-1]) | (key[order][1:] != key[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], np.bincount(number, minlength=int(new.sum())), number


def distinct_keys(key: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over distinct stretches: the keys in order, how many stretches each has, and the hash of one of them."""
    keys, first, counts = np.unique(key, return_index=True, return_counts=True)
    return keys, counts, body[first]


ASKED = (("body", np.uint64), ("body_key", np.uint64), ("many", bool), ("key", np.uint64), ("variants", np.uint32), ("one_body", np.uint64))


def _questions(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "key", "body"]).to_pylist():
                key, body = _unpack(row["key"], np.uint64), _unpack(row["body"], np.uint64)
                first, times, _ = distinct_stretches(body, key)
                body, body_key = body[first], key[first]
                keys, variants, one = distinct_keys(body_key, body)
                values = dict(body=body, body_key=body_key, many=times > 1, key=keys, variants=variants, one_body=one)
                of = {"body": _ranges(body, buckets), "key": _ranges(keys, buckets)}
                columns = []
                for name, kind in ASKED:
                    column = values[name].astype(kind)
                    columns.append(pa.array([_pack(column[cut]) for cut in of["body" if name in ("body", "body_key", "many") else "key"]], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(buckets, row["block"])), pa.array(np.arange(buckets)), *columns], ["block", "bucket", *(n for n, _ in ASKED)])

    return run


#: Answers about a stretch: it occurs once, more than once, or more than once and this block shall speak for it.
ONCE, MANY, SPEAKER = 0, 1, 2


def _answers(bucket: pa.Table) -> pa.Table:
    """Of each stretch that a block asked for, how it occurs; of each key, how many different stretches it has at most (1: exactly one)."""
    columns = {name: [_unpack(x, kind) for x in bucket[name].to_pylist()] for name, kind in ASKED}
    joined = {name: np.concatenate(x) for name, x in columns.items()}
    first, times, number = distinct_stretches(joined["body"], joined["body_key"])
    many = (times > 1) | (np.bincount(number, joined["many"], len(times)) > 0)
    speaks = np.zeros(len(number), bool)
    speaks[first] = True
    state = np.where(many[number], np.where(speaks, SPEAKER, MANY), ONCE).astype(np.uint8)
    keys, inverse = np.unique(joined["key"], return_inverse=True)
    total = np.bincount(inverse, joined["variants"], len(keys)).astype(np.int64)
    low, high = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(keys), np.uint64)
    np.minimum.at(low, inverse, joined["one_body"])
    np.maximum.at(high, inverse, joined["one_body"])
    several = (low != high) | (np.bincount(inverse, joined["variants"] > 1, len(keys)) > 0)
    total = np.where(several, total, 1)
    cut = lambda x, name: [_pack(y) for y in np.split(x, np.cumsum([len(c) for c in columns[name]])[:-1])]
    facts = pa.array([int(total[several].sum())] + [0] * (bucket.num_rows - 1), pa.int64())
    return pa.table(
        [bucket["block"], bucket["bucket"], pa.array(cut(state, "body"), pa.binary()), pa.array(cut(total[inverse], "key"), pa.binary()), facts],
        ["block", "bucket", "state", "variants", "open"],
    )


FOUND = "block long, shard long, key long, salted boolean, stretch long, windows long, bytes binary, starts binary"


def _found(block: int, **columns: list) -> pa.Table:
    kinds = {"shard": pa.int64(), "key": pa.int64(), "salted": pa.bool_(), "stretch": pa.int64(), "windows": pa.int64(), "bytes": pa.binary(), "starts": pa.binary()}
    n = len(next(iter(columns.values())))
    arrays = [pa.array([block] * n, pa.int64())]
    arrays += [pa.array(columns.get(k, [None] * n), kind) for k, kind in kinds.items()]
    return pa.table(arrays, ["block", *kinds])


def _settle(size: int, shards: int, most: int):
    """Of a block: one row with the stretches that repeat as a whole, and a row for each stretch that a shard has to look at."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        v = {name: _unpack(row[name], kind) for name, kind in BLOCK_PARTS}
        answers = answers.sort_by("bucket")
        state = np.concatenate([_unpack(x, np.uint8) for x in answers["state"].to_pylist()])
        variants = np.concatenate([_unpack(x, np.int64) for x in answers["variants"].to_pylist()])
        first, _, number = distinct_stretches(v["body"], v["key"])
        keys = np.unique(v["key"])
        total = variants[np.searchsorted(keys, v["key"])] if len(keys) else np.zeros(0, np.int64)
        state_of = state[number] if len(state) else np.zeros(0, np.uint8)
        speaks = np.zeros(len(number), bool)
        speaks[first] = True
        whole = np.flatnonzero(state_of != ONCE)
        send = np.flatnonzero(((state_of == ONCE) & ((total > 1) | v["inside"])) | ((state_of == SPEAKER) & speaks & (total > 1)))
        offset = np.cumsum(v["sizes"]) - v["sizes"]
        text = v["bytes"].tobytes()
        out = {k: [None] for k in ("shard", "key", "salted", "windows", "bytes")} | {"stretch": [-1], "starts": [_pack(whole)]}
        for i in send.tolist():
            a = int(offset[v["text"][i]] + v["start"][i])
            parts = -(-int(total[i]) // most)
            salt = int(v["body"][i] >> np.uint64(32)) % parts
            # parts of one key go to shards of their own numbers, beyond those that many keys share
            key = int(v["key"][i])
            out["shard"].append(key % shards if parts == 1 else shards + (key % (1 << 40)) * parts + salt)
            out["key"].append(int(np.uint64(key).astype(np.int64)))
            out["salted"].append(parts > 1)
            out["stretch"].append(i if state_of[i] == ONCE else -2)
            out["windows"].append(int(v["windows"][i]))
            out["bytes"].append(_pack(text[a : a + int(v["windows"][i]) + size - 1]))
            out["starts"].append(None)
        return _found(row["block"], **out)

    return run


SEARCHED = "block long, shard long, stretch long, starts binary, prints array<struct<print:binary,start:long>>"


def _search(size: int):
    def run(shard: pa.Table) -> pa.Table:
        rows = shard.select(["block", "shard", "stretch", "windows", "salted", "bytes"]).to_pylist()
        parts = [zlib.decompress(r["bytes"]) for r in rows]
        repeated = repeated_starts(parts, size)
        out, at, seen = [], 0, set()
        for r, part in zip(rows, parts, strict=True):
            here = repeated[at : at + r["windows"]]
            at += len(part)
            prints = []
            if r["salted"]:
                # one place stands for each different window of the shard; the other places repeat it already
                for i in range(r["windows"]):
                    p = xxhash.xxh3_128_digest(part[i : i + size])
                    if p not in seen:
                        seen.add(p)
                        prints.append({"print": p, "start": i})
            if r["stretch"] >= 0 or prints:
                out.append((r["block"], r["shard"], r["stretch"], _pack(np.flatnonzero(here)), prints))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("print", pa.binary()), ("start", pa.int64())]))]
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "shard", "stretch", "starts", "prints"])

    return run


def _merge(bucket: pa.Table) -> pa.Table:
    """Windows of one hash range that several shards have: each shard's sorted list is looked up in those before it by binary search."""
    bucket = bucket.sort_by([("shard", "ascending"), ("print", "ascending")])
    shard = bucket["shard"].to_numpy()
    prints = np.array(bucket["print"].to_pylist(), "S16")
    hit = np.zeros(len(shard), bool)
    edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
    merged, places = prints[: edges[1]], np.arange(edges[1])
    for a, b in zip(edges[1:-1], edges[2:], strict=True):
        own = prints[a:b]
        at = np.searchsorted(merged, own)
        met = merged[np.minimum(at, len(merged) - 1)] == own
        hit[a:b] |= met
        hit[places[at[met]]] = True
        merged = np.insert(merged, at[~met], own[~met])
        places = np.insert(places, at[~met], np.arange(a, b)[~met])
    by: dict[tuple[int, int], list[int]] = {}
    for row in bucket.filter(pa.array(hit)).select(["block", "stretch", "start"]).to_pylist():
        if row["stretch"] >= 0:
            by.setdefault((row["block"], row["stretch"]), []).append(row["start"])
    columns = [[k[0] for k in by], [k[1] for k in by], [_pack(np.array(x, np.int64)) for x in by.values()]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "stretch", "starts"])


def _cover(size: int, with_bytes: bool):
    """Result rows of a block from the windows that repeat."""

    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        v = {name: _unpack(row[name], kind) for name, kind in BLOCK_PARTS if name in row}
        offset = np.cumsum(v["sizes"]) - v["sizes"]
        first = offset[v["text"]] + v["start"]
        begins, ends = [], []
        for stretch, starts in zip(found["stretch"].to_pylist(), found["starts"].to_pylist(), strict=True):
            at = _unpack(starts, np.int64)
            if stretch == -1:  # whole stretches
                begins.append(first[at])
                ends.append(first[at] + v["windows"][at] + size - 1)
            else:
                begins.append(first[stretch] + at)
                ends.append(first[stretch] + at + size)
        begins, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends))
        n = len(v["bytes"])
        cover = np.cumsum(np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0
        text = v["bytes"]
        removed, spans, digests, kept, runs = [], [], [], [], []
        for a, size_ in zip(offset.tolist(), v["sizes"].tolist(), strict=True):
            gone = cover[a : a + size_]
            edges = np.flatnonzero(np.diff(gone.view(np.int8), prepend=0, append=0)).tolist()  # begins and ends in turn
            removed.append(int(gone.sum()))
            spans.append(len(edges) // 2)
            runs.append(",".join(f"{x}:{y}" for x, y in zip(edges[::2], edges[1::2], strict=True)))
            stays = text[a : a + size_][~gone].tobytes()
            digests.append(hashlib.sha256(stays).hexdigest())
            if with_bytes:
                kept.append(stays)
        ids = pa.array(row["ids"], blocks.schema.field("ids").type.value_type)
        columns = {"id": ids, "n_bytes": pa.array(v["sizes"]), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests), "spans": pa.array(runs, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_bytes else {}))

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    kmer: int = KMER,
    block_bytes: int = BLOCK_BYTES,
    shard_stretches: int = SHARD_STRETCHES,
    buckets: int | None = None,
    with_bytes: bool = False,
) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (and ``kept``, the bytes that stay).

    ``spans`` has the removed runs as ``begin:end`` in bytes, comma-joined.

    ``buckets`` is the number of hash ranges (by default the session's shuffle
    partitions); the stretches of all blocks, about one per 150 bytes of text
    and 32 bytes each, divided by it come together in one task.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = checkpointed(rows.mapInArrow(_blocks(size, kmer, block_bytes), f"block long, ids array<{kind}>, " + ", ".join(f"{n} binary" for n, _ in BLOCK_PARTS)))
    asked = blocks.select("block", "key", "body").mapInArrow(_questions(buckets), "block long, bucket long, " + ", ".join(f"{n} binary" for n, _ in ASKED))
    answers = checkpointed(asked.groupBy("bucket").applyInArrow(_answers, "block long, bucket long, state binary, variants binary, open long"))
    open_ = answers.agg(F.coalesce(F.sum("open"), F.lit(0))).first()[0]
    shards = max(1, -(-open_ // shard_stretches))
    told = answers.select("block", "bucket", "state", "variants")
    settled = checkpointed(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_settle(size, shards, shard_stretches), FOUND))
    searched = checkpointed(settled.filter("stretch <> -1").groupBy("shard").applyInArrow(_search(size), SEARCHED))
    window = searched.select("block", "shard", "stretch", F.explode("prints").alias("w")).select("block", "shard", "stretch", "w.*")
    place = F.conv(F.hex(F.substring("print", 1, 4)), 16, 10).cast("long")
    merged = window.withColumn("bucket", F.floor(place * buckets / (1 << 32))).groupBy("bucket").applyInArrow(_merge, "block long, stretch long, starts binary")
    columns = ["block", "stretch", "starts"]
    found = settled.filter("stretch = -1").select(columns).unionByName(searched.filter("stretch >= 0").select(columns)).unionByName(merged)
    needed = blocks.select("block", "ids", "sizes", "bytes", "text", "start", "windows")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string" + (", kept binary" if with_bytes else "")
    return needed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_cover(size, with_bytes), schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
    return found.withColumns({"n_kept": F.col("n_bytes") - F.col("n_removed"), "has_repeats": F.col("n_removed") > 0})
