"""Packing against the tokenizer itself, a plain best-fit decreasing and an exact round trip."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leagueflow.llm import packing

ODD = ["", None, " a  b\n c", "it's   x y z ñ ó é", "a <|endoftext|> b", "\x00 \x85 a", " ", "  ", "x " * 5 + "\t\n 1 2  3", "naïve 日本 語 a 日 b", "１２ ３ 4　 5"]
ODD += ["a.b a,b. don't I'll x's.\n\n\nB \nc\n d.\nE1,2 a1b ñ.ñ,  ñ\nñ", "a\n", "\na", "long " * 3000, "…'s 's\r\n ' s", "\U0001f600 \U0001f600.\n"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_stretches_give_the_tokens_of_the_whole_text(tokenizer):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("ab1 \n\t.,'ñ語  \U0001f600<|>s") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    ids, each = packing.Encoder(packing.tokenizer_path())(pa.array(texts))
    want = [tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(each)[:-1])] == want


def test_a_slice_of_a_larger_array():
    a = pa.array(["no", None, "two words", "", "end"])
    encode = packing.Encoder(packing.tokenizer_path())
    ids, each = encode(a.slice(1, 3))
    want, sizes = encode(pa.array(["", "two words", ""]))
    assert ids.tolist() == want.tolist() and each.tolist() == sizes.tolist()


def plain(counts, window):
    """Remaining room of all windows after best-fit decreasing, piece by piece."""
    room = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(r, i) for i, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(window - length)
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(200):
        window = rnd.choice([16, 20, 64])
        counts = {rnd.randint(1, window): rnd.randint(1, 9) for _ in range(rnd.randint(0, 12))}
        runs, use = packing.plan_windows(counts, window), {}
        for r in runs:
            for k in range(r.count):
                use.setdefault(r.window + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
        for own in use.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sorted(window - sum(n for _, n in own) for own in use.values()) == plain(counts, window)


def test_the_plan_does_not_grow_with_the_counts():
    counts = {k: 5 + k % 7 for k in range(1, 1025)}
    assert len(packing.plan_windows({k: v * 10**8 for k, v in counts.items()})) < 5 * len(packing.plan_windows(counts))


def check(rows, texts, tokenizer, window=packing.WINDOW):
    """Every id of every document lies in exactly one piece, and the sequences are gapless."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    room = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        room.append(window - sum(r["length"] for r in own))
    assert min(room) >= 0
    return sorted(room)


def test_query_on_the_table(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = packing.op12_packing(spark, sf).collect()
    room = check(rows, texts, tokenizer)
    counts = {}
    for r in rows:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert room == plain(counts, packing.WINDOW)


def test_odd_input_in_any_partitions(spark, frame, tokenizer):
    rows = [(i, x) for i, x in enumerate(ODD)]
    docs = frame(rows, extra=True).repartition(5)
    got = packing.pack(docs, packing.tokenizer_path(), window=64).collect()
    check(got, dict(rows), tokenizer, 64)
    assert not packing.pack(frame([]), packing.tokenizer_path()).collect()


def test_repeated_rows_and_null_ids_are_packed_each(frame):
    got = packing.pack(frame([(1, "a b"), (1, "a b"), (None, "c"), (None, "c")]), packing.tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 2), (0, 2), (1, 3), (1, 3)]
    assert {r["sequence_id"] for r in got} == {0} and sorted(r["offset"] for r in got) == [0, 3, 6, 8]


def test_sequences_hold_the_ids(frame, tokenizer):
    texts = {i: f"document {i} " * (i * 7) for i in range(1, 30)}
    packed = packing.pack(frame(list(texts.items())), packing.tokenizer_path(), window=128, with_ids=True)
    for r in packing.sequences(packed).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 128
        for p in r["pieces"]:
            want = [*tokenizer.encode(texts[p["id"]], add_special_tokens=False).ids, 0]
            assert ids[p["offset"] : p["offset"] + p["length"]].tolist() == want[p["start"] : p["start"] + p["length"]]


def test_the_tokenizer_gets_few_stretches_at_once(monkeypatch):
    """What it answers is far larger than the ids, so a slice of new words does not go to it whole."""
    encode, seen = packing.Encoder(packing.tokenizer_path()), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **kw):
            seen.append(len(texts))
            return self.inner.encode_batch_fast(texts, **kw)

    texts = pa.array([" ".join(f"w{i}x" for i in range(3 * 4096))])
    want = encode(texts)[0].tolist()
    encode._forget()
    encode._tokenizer = Counted(encode._tokenizer)
    assert encode(texts)[0].tolist() == want
    assert len(seen) > 1 and max(seen) <= 4096


def test_each_distinct_stretch_is_looked_up_once(tokenizer):
    """Also when a later slice knows some of them already; ids stay those of the whole texts."""
    asked = []

    class Counting(dict):
        def __contains__(self, key):
            asked.append(key)
            return super().__contains__(key)

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    encode = packing.Encoder(packing.tokenizer_path())
    encode._known = Counting()
    for texts in (["one two two three"], ["two four, one", "", "five two"], ["one two"]):
        del asked[:]
        ids, each = encode(pa.array(texts, pa.large_string()))
        distinct = packing.stretches(pa.array(texts, pa.large_string()))[0].unique()
        assert len(asked) == len(distinct)
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert each.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
