import collections
import random

import numpy as np
import pytest
import xxhash

from leagueflow.llm import simhash as S

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def plain_components(rows, max_bits=4):
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    p = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(p ^ p[i]) <= max_bits)[0]:
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def result(df):
    g = S.near_duplicate_groups(df)
    return [(r.id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in g.collect()]


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in S.op9_simhash_neardup(spark, SF).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(plain_components(rows))


def test_every_pair_within_reach_shares_a_key():
    patterns = S.golay_patterns()
    assert set((patterns >= 0).sum(axis=1)) == {1, 6}
    rng = random.Random(5)
    for bits in range(5):
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), bits):
                b ^= 1 << k
            keys, places = S.fuzzy_keys(np.array([a, b], np.uint64), patterns)
            assert set(keys[places == 0]) & set(keys[places == 1])


def test_far_fingerprints_seldom_share_a_key():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 64, 20000, dtype=np.uint64)
    keys, places = S.fuzzy_keys(prints, S.golay_patterns())
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    assert 100 < len(keys) / len(prints) < 253
    assert same.sum() / (len(prints) * (len(prints) - 1) / 2) < 4e-6


def test_hot_group_of_near_fingerprints_equals_brute_force(spark):
    rng = random.Random(1)
    prints = {0}
    while len(prints) < 600:  # a walk: neighbours differ in 3 bits, the ends in many
        last = rng.choice(list(prints))
        for k in rng.sample(range(64), 3):
            last ^= 1 << k
        prints.add(last)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    p = np.array(sorted(prints), np.uint64)
    rows = [(int(x),) for x in p.view(np.int64)]
    got = {r.fp: r.root for r in S.fingerprint_components(spark.createDataFrame(rows, "fp long")).collect()}
    parent = {int(x): int(x) for x in p.view(np.int64)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in p:
        for y in p[np.bitwise_count(p ^ x) <= 4]:
            a, b = find(int(x.view(np.int64))), find(int(y.view(np.int64)))
            parent[max(a, b)] = min(a, b)
    assert {k: find(k) for k in parent if find(k) != k} == got


def test_odd_rows(frame):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \t "), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "One"), (6, "one"), (7, long), (8, long + " tail"), (9, "é Ü ß")]
    assert sorted(result(frame(rows, extra=True)), key=str) == sorted(plain_components(rows), key=str)
    assert result(frame([]).limit(0)) == []


def test_one_of_each_group_stays(frame):
    rows = [(1, None), (2, ""), (4, "a b c d e"), (4, "a b c d e"), (3, "a b c d e"), (5, "quite another text of words"), (5, "one more text that stands alone")]
    kept = S.keep_one_of_each(frame(rows, extra=True))
    assert kept.columns == frame(rows, extra=True).columns
    by_group = collections.Counter(plain_components([(i, t) for i, (_, t) in enumerate(rows)])[i][2] for i in range(len(rows)))
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    assert len(got) == len(by_group)
    assert got == sorted([(1, ""), (3, "a b c d e"), (5, "quite another text of words"), (5, "one more text that stands alone")])


def test_distance_beyond_the_proof_is_refused(spark):
    with pytest.raises(ValueError):
        S.fingerprint_components(spark.createDataFrame([(1,)], "fp long"), 5)
