import collections
import hashlib
import random

import numpy as np
import pytest

from leagueflow.llm import suffix_dedup as S
from leagueflow.llm import suffixes as X

SF = "/root/testdata/sf0.001"


def plain(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(hashlib.blake2b(t[i : i + size], digest_size=16).digest() for t in texts for i in range(len(t) - size + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - size + 1):
            if seen[hashlib.blake2b(t[i : i + size], digest_size=16).digest()] > 1:
                gone[i + 1 : i + size + 1] = True
        kept = bytes(b for b, g in zip(t, gone[1:-1]) if not g)
        begins, ends = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:])
        spans = ",".join(f"{a}:{b}" for a, b in zip(begins, ends, strict=True))
        out.append((d, len(t), int(gone.sum()), len(begins), hashlib.sha256(kept).hexdigest(), spans))
    return sorted(out, key=str)


def result(df, **kw):
    return sorted((tuple(r) for r in S.remove_repeats(df, **kw).collect()), key=str)


def test_suffix_array_and_prefixes_equal_sorting():
    rng = random.Random(1)
    for _ in range(150):
        parts = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 6))]
        s = X.Strings(parts)
        n = len(s.text)
        sa, rank = X.suffix_array(s)
        lcp = X.common_prefixes(s, sa, rank)
        suffix = [bytes(s.text[i : s.end[i]]) for i in range(n)]
        assert sorted(sa) == list(range(n)) and all(suffix[a] <= suffix[b] for a, b in zip(sa, sa[1:]))
        for r in range(1, n):
            a, b = suffix[sa[r - 1]], suffix[sa[r]]
            assert lcp[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_long_runs_and_long_copies():
    rng = random.Random(6)
    copy = bytes(rng.choice(b"abc") for _ in range(30000))
    got = X.repeated_starts([b"z" * 200000, copy + b"!", b"?" + copy[5000:], b"z" * 399], 400)
    want = [True] * (200000 - 400) + [False] * 400  # the last window of a run starts one earlier, too
    want[200000 - 400] = True
    assert got[:200000].tolist() == want
    at = 200000
    assert not got[at : at + 5000].any() and got[at + 5000 : at + 30000 - 399].all() and not got[at + 30000 - 399 : at + 30001].any()


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = S.op7_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_kept", "has_repeats"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r[:6] for r in got] == plain(rows, 400) and any(r[2] for r in got)
    assert all(r[6:] == (r[1] - r[2], r[2] > 0) for r in got)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(20) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a : a + rng.randrange(20, 90)], text(rng.randrange(0, 10))]
        rows.append((i, " ".join(parts)))
    rows += [(200, "ab" * 100), (201, "x" * 57), (202, "y" * 40), (203, "y" * 41), (204, rows[0][1]), (204, rows[0][1]), (205, "abc" * 13 + "d"), (206, (text(3) + "\n") * 6)]
    return rows


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 900, "buckets": 3}, {"block_bytes": 1500, "shard_stretches": 2, "buckets": 2}])
def test_short_strings_equal_brute_force(frame, kw):
    rows = corpus(3)
    assert result(frame(rows), size=40, kmer=8, **kw) == plain(rows, 40)


def test_a_passage_in_every_document_with_other_neighbours(frame):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = letters(30)  # shorter than the size: many stretches of one key, few repeats
    rows = [(i, letters(50) + passage + letters(50)) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:100] + letters(9)) for i in range(10)]
    assert result(frame(rows), size=40, kmer=8, shard_stretches=4, block_bytes=600, buckets=3) == plain(rows, 40)


def test_odd_rows(frame):
    long = "".join(random.Random(2).choice("abcdefgh ") for _ in range(150000))
    rows = [(1, None), (2, ""), (None, "z" * 399), (3, "z" * 400), (4, "q" * 401), (5, long), (6, long[1000:1500] + "!"), (7, "é" * 199 + "x"), (7, "é" * 199 + "x")]
    assert result(frame(rows, extra=True)) == plain(rows, 400)
    assert result(frame([])) == []
    kept = {r.id: bytes(r.kept) for r in S.remove_repeats(frame(rows), with_bytes=True).collect()}
    assert kept[6] == b"!" and kept[3] == b"z" * 400
