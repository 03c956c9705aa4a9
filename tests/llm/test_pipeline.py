import collections

import corpus_pipeline as P
from leagueflow.llm import mixing

from test_decontaminate import plain_pairs
from test_simhash import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "simhash_neardup", "decontaminate", "mix_sources"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    frame = docs
    for name, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, SF).checkpoint()
        assert frame.columns == columns
        if name == "exact_dedup":
            best = {}
            for r in rows:
                best[r[1] or ""] = max(best.get(r[1] or "", r), r)
            rows = list(best.values())
        elif name == "simhash_neardup":
            groups = plain_components([r[:2] for r in rows])
            rows = [r for r, g in zip(rows, groups) if r[0] == g[2]]
        elif name == "decontaminate":
            bad = {d for d, *_ in plain_pairs([r[:2] for r in rows], items)}
            rows = [r for r in rows if r[0] not in bad]
        assert sorted(tuple(r) for r in frame.collect()) == sorted(rows), name
    out = P.STAGES[-1][1](spark, frame, SF).collect()
    taken = {r.doc_id: r.taken for r in mixing.mix(frame).collect() if r.taken or r.copies}
    assert {r.doc_id: r.taken for r in out} == taken
    final = P.run(spark, SF)
    assert sorted(tuple(r) for r in final.collect()) == sorted(tuple(r) for r in out)
    words = collections.Counter()
    target = {}
    for r in out:
        words[r.source] += r.taken
        target[r.source] = r.target
    assert words
    assert all(abs(words[s] - target[s]) <= 4000 for s in words)


def test_stages_on_empty_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
