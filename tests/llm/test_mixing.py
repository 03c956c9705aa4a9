import pytest

from leagueflow.llm import mixing as M


def shares(sizes):
    """Targets by sharing the excess again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = dict(zip(names, [5, 2, 1] * len(names)))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= 2 * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def corpus():
    rows = []
    for k, (source, docs) in enumerate({"a": 40, "Z": 25, "é": 10, None: 7, "b": 60, "tiny": 1, "none": 2}.items()):
        rows += [(1000 * k + i, " ".join(["w"] * (1 + (i * 7) % 23)) if source != "none" else "  ", "en", source) for i in range(docs)]
    return rows


def test_targets_and_samples(frame):
    rows = corpus()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    got = M.mix(frame(rows, extra=True), keep=["source"]).collect()
    assert len(got) == len(rows)
    want = shares(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r.in_source == s]
        assert {r.source_size for r in mine} == {size}
        assert all(r.target == pytest.approx(want[s]) for r in mine)
        largest = max(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= largest / 2 + 1e-9
        whole = int(want[s] // size) if size else 0
        assert {r.copies for r in mine} <= {whole, whole + 1}
        assert all(r.taken <= 2 * r.size for r in mine)
    again = M.mix(frame(rows).repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_sample_follows_the_inclusion_probability(frame):
    rows = [(i, "one two three", "en", s) for i in range(3000) for s in ("a" if i % 3 else "b",)]
    taken = [r.copies for r in M.mix(frame(rows), keep=["source"]).collect() if r.in_source == "b"]
    assert len(taken) == 1000 and 0 < sum(taken) < 2000


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b c"), (3, "a b c"), (3, "a b c d"), (4, " \t\x0b x \r\n y ")]
    got = M.mix(frame(rows, extra=True)).collect()
    assert sorted(r.size for r in got) == [0, 0, 2, 2, 3, 3, 4]
    assert M.mix(frame([])).count() == 0
    out = M.mixture(frame(rows, extra=True))
    kept = out.collect()
    assert sum(r.taken for r in kept) == sum(r.taken for r in got) and all(r.copies > 0 for r in kept)
    assert set(out.columns) == {*frame(rows, extra=True).columns, "size", "source_size", "target", "copies", "taken"}
