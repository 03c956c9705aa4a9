import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leagueflow.llm import lmscore as L

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(rows, priors=L.PRIORS, order=L.ORDER):
    """Scores by walking an automaton of dicts, token by token, from state to state."""
    part = lambda d: zlib.crc32(str(d).encode()) % 7
    learn = [tokens(t) for d, t in rows if d is not None and part(d) != 2]
    words = Counter(w for x in learn for w in x)
    n, v = sum(words.values()), len(words)
    once, twice = sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    seen = Counter()  # grams of two words and more; "<s>" is the first word of a text's first grams
    states = Counter({(): n})
    for x in learn:
        x = ["<s>", *x]
        for i in range(len(x)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0 and (k > 1 or i > 0):
                    seen[tuple(x[i - k + 1 : i + 1])] += 1
                if k < order and i - k + 1 >= 0 and i + 1 < len(x):
                    states[tuple(x[i - k + 1 : i + 1])] += 1

    def prob(h, w):
        if not h:
            return max(words[w] - discount, 0) / n + discount * v / (n * (v + 1)) if n else 1 / (v + 1)
        m = priors[min(len(h), len(priors)) - 1]
        return (seen[(*h, w)] + m * prob(h[1:], w)) / (states[h] + m)

    out = []
    for d, t in rows:
        x = tokens(t)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in x)
        score, state = 0.0, ("<s>",) if order > 1 and learn else ()
        for w in x:
            while state and (*state, w) not in seen:  # failure arcs
                m = priors[min(len(state), len(priors)) - 1]
                score += math.log10(m / (states[state] + m))
                state = state[1:]
            score += math.log10(prob(state, w))
            state = (*state, w)[1 - order :] if order > 1 and words[w] else ()
        out.append((d, d is not None and part(d) == 2, len(x), sum(words[w] > 0 for w in x), n, pytest.approx(base, rel=1e-9, abs=1e-9), pytest.approx(score, rel=1e-9, abs=1e-9)))
    return out


def scored(df, **kw):
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return [tuple(r) for r in L.score_texts(df, rest != 2, rest == 2, **kw).collect()]


key = lambda r: (str(r[0]), r[2], r[3])


def test_query_matches_plain_automaton(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = L.op6_lm_score(spark, SF)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(plain(rows), key=lambda r: r[0])
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_blocks_and_ranges_do_not_change_scores(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = sorted(scored(docs))
    small = sorted(scored(docs, block_bytes=20000, buckets=3))
    assert [r[:5] for r in whole] == [r[:5] for r in small]
    assert all(a[6] == pytest.approx(b[6]) and a[5] == pytest.approx(b[5]) for a, b in zip(whole, small))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders(spark, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    rows = [tuple(r) for r in docs.collect()]
    priors = (50.0, 7.0)
    assert sorted(scored(docs, order=order, priors=priors, block_bytes=30000), key=key) == sorted(plain(rows, priors, order), key=key)


def test_pieces_of_a_long_text_are_read_in_the_state_before_them(frame):
    rows = [(i, " ".join(f"w{(i * k * k) % 11}" for k in range(900 + i))) for i in range(12)]
    whole = sorted(scored(frame(rows)))
    assert whole == sorted(plain(rows))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        x = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (L.unpack_sorted(L.pack_sorted(x)) == x).all()
        y = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (L.unpack_numbers(L.pack_numbers(y)) == y).all()
    assert (L.unpack_sorted(L.pack_sorted(np.array([5, 5, 5], np.uint64))) == 5).all()


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (3, " \t "), (None, "a b"), (4, "A b é É"), (4, "A b é É"), (4, "a  B\né É"), (5, "x " * 40000), (9, "new words only")]
    got = scored(frame(rows, extra=True))
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert scored(frame([])) == []
    nothing = [(None, "a b"), (None, "a")]
    assert sorted(scored(frame(nothing)), key=key) == sorted(plain(nothing), key=key)


def test_blocks_that_are_alike(spark):
    df = spark.createDataFrame([(4, "a b a")] * 6, "doc_id long, text string").repartition(3).checkpoint()
    assert sorted(scored(df)) == plain([(4, "a b a")] * 6)


def test_weights_are_made_for_few_texts_at_a_time(monkeypatch):
    """A block's arcs and failure arcs take far more than its counts, so no block is read whole."""
    rng, seen, real = np.random.default_rng(3), [], L.traverse
    texts = [" ".join(rng.choice(list("abcdefg"), n)) for n in rng.integers(0, 90, 60)]
    rows = list(enumerate(texts))
    batch = pa.RecordBatch.from_pydict({"id": [d for d, _ in rows], "train": [zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows], "held_out": [False] * 60, "text": texts})
    asked = pa.Table.from_batches(L._questions(1 << 30, 1, 3)(iter([batch])))
    answers = L._answers(3)(asked)
    n, v, once, twice = (sum(answers[c].to_pylist()) for c in ("n", "v", "n1", "n2"))
    packed = pa.Table.from_batches(L._texts(1 << 30)(iter([batch])))
    monkeypatch.setattr(L, "SCORED", 100)
    monkeypatch.setattr(L, "traverse", lambda counts, *a: seen.append(counts.shape[1]) or real(counts, *a))
    got = L._score(L.Corpus(n, v, once / (once + 2 * twice) if once and twice else 0.5), L.PRIORS, 1, 3)(packed, answers)
    assert [(r["id"], r["score"]) for r in got.to_pylist()] == [(r[0], r[6]) for r in plain(rows)]
    assert len(seen) > 5 and max(seen) <= 200
