"""Ranked lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from leagueflow.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, k=20):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, total = len(own), sum(len(t) for _, t in own)
    tfs = [(i, len(t), Counter(t)) for i, t in own]
    df = Counter(x for _, _, c in tfs for x in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = terms(text)
        scored = []
        for i, length, tf in tfs:
            m = 100 - 25 + 25 * length * n // total
            s = sum(weight[t] * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in asked if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def got(docs, items, k=20, **kw):
    index, corpus = lexical.build_index(docs, **kw)
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical.search(index, corpus, items, k=k).collect()), key=repr)


def wanted(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, score int, item string")


ODD = ["", None, "...", "A b", "a\x00B,c_d", "ÑANDÚ ñandú Ñandú", "日本 語。日本", "x" * 5000, "É é", "the " * 4000, " a ", "A1 a1 1"]


def test_terms_are_those_of_the_contract():
    rnd = random.Random(1)
    texts = ODD + ["".join(chr(rnd.choice([*range(128), 0xE9, 0xD1, 0x65E5, 0xA0])) for _ in range(rnd.randint(0, 50))) for _ in range(500)]
    column = pa.array(texts)
    numbers, dictionary, sizes = lexical.words(lexical.folded(column))
    flat = [dictionary[i].as_py() for i in numbers.tolist()]
    ends = np.cumsum(sizes)
    assert [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)] == [terms(t) for t in texts]
    assert lexical.term_counts(column).tolist() == [len(terms(t)) for t in texts] == [*lexical.term_counts(column.slice(0, 9)), *lexical.term_counts(column.slice(9))]


def corpus(n, seed, vocabulary=300):
    rnd = random.Random(seed)
    word = lambda: f"w{min(int(rnd.paretovariate(0.7)), vocabulary)}"
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(rnd.randint(0, 25)))) for i in range(30)]
    rnd.shuffle(docs)
    return docs, items


def test_small_segments_and_many_blocks(spark, frame, monkeypatch):
    docs, items = corpus(900, 2)
    want = plain(docs, items)
    assert got(frame(docs, extra=True), wanted(spark, items), segment_bytes=4000) == want
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "ITEMS", 7)
    assert got(frame(docs).repartition(3), wanted(spark, items), segment_bytes=30000) == want
    assert got(frame(docs).coalesce(1), wanted(spark, items), k=3) == plain(docs, items, 3)


def test_odd_documents_and_items(spark, frame):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b c"), (None, "a b c"), (3, "A b"), (3, "A b"), (77, "a " * 70000), (78, "b " * 300)]
    items = [(1, "a"), (1, "a"), (2, None), (3, ""), (4, "ñandú"), (5, "a b c 日本"), (None, "the the x"), (6, "nowhere"), (7, "É é" + " a" * 999)]
    for layout in (frame(docs).coalesce(1), frame(docs).repartition(6)):
        assert got(layout, wanted(spark, items), segment_bytes=100) == plain(docs, items)


def test_copies_of_a_third_of_the_rows_tie_by_id(spark, frame):
    docs, items = corpus(300, 3, 40)
    docs = [(i, "w1 w2 w3 w9" if i % 3 == 0 else t) for i, t in docs]
    assert got(frame(docs), wanted(spark, items), segment_bytes=2000) == plain(docs, items)


def test_empty_tables(spark, frame):
    assert got(frame([]), wanted(spark, [(1, "a")])) == []
    assert got(frame([(1, "...")]), wanted(spark, [(1, "a")])) == []
    assert got(frame([(1, "a")]), wanted(spark, [])) == []


def test_candidates_are_rejected_before_decompression(spark, frame):
    """With theta known, blocks of lists that can't matter stay compressed."""
    docs = [(i, "rare " * (i % 40 == 0) + "common " * ((i % 2 == 0) * (1 if i < 3000 else 9)) + "other " * 30) for i in range(4000)]
    index, counts = lexical.build_index(frame(docs).coalesce(1))
    batch = index.toArrow().to_batches()[0]
    segment = lexical.Segment(batch, 0)
    place = {t: k for k, t in enumerate(segment.terms.to_pylist())}
    df = dict(zip(segment.terms.to_pylist(), batch.column("df")[0].as_py(), strict=True))
    lists = [(place[t], counts.term_weight(df[t])) for t in ("rare", "common")]
    first = segment.search(lists, 1)
    theta = int(np.sort(first[1])[-20])
    fresh = lexical.Segment(batch, 0)
    docs2, scores = fresh.search(lists, theta)
    assert sorted(scores) == sorted(s for s in first[1] if s >= theta)
    assert len(fresh._known) < 0.8 * len(segment._known)
