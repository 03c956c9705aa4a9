import re

from leagueflow.llm import licenses as L

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = WORD.findall(low)
    places, labels = [], set()
    for phrase, label in L.BASE_PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        if at:
            labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base_columns(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_query_matches_brute_force(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = L.op10_license_scan(spark, SF).collect()
    assert len(rows) == len(text) and any(r.n_base for r in rows)
    for r in rows:
        assert base_columns(r) == plain(text[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def edited(text, every):
    w = text.split()
    return " ".join(x for i, x in enumerate(w) if (i + 1) % every)


def test_templates_are_found_and_clean_texts_left_alone(frame):
    filler = "the of and in to software copy notice this is any free for use terms " * 20
    rows = [(i, f"{filler} {t.text} {filler}") for i, t in enumerate(L.TEMPLATES)]
    n = len(rows)
    rows += [(n, filler), (n + 1, "licensed work under general version public gnu license " * 5), (n + 2, L.TEMPLATES[1].text.upper())]
    rows += [(n + 3, edited(L.TEMPLATES[1].text, 19)), (n + 4, " ".join(L.TEMPLATES[1].text.split()[:4])), (n + 5, f"{L.TEMPLATES[1].text} {filler} {L.TEMPLATES[3].text}")]
    got = {r.doc_id: r for r in L.scan_licenses(frame(rows, extra=True)).collect()}
    for i, t in enumerate(L.TEMPLATES):
        assert t.label in got[i].labels.split(","), t.label
        assert got[i].score == 1.0
        assert base_columns(got[i]) == plain(rows[i][1])
    assert got[n].labels == "" and got[n].score == 0 and got[n + 1].labels == ""
    assert got[n + 2].labels == "mit"
    assert got[n + 3].labels == "mit" and 0.6 <= got[n + 3].score < 1
    assert got[n + 4].labels == ""
    assert got[n + 5].labels == "apache,apache-2.0,mit"


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (3, " .,;"), (4, "mit"), (4, "mit"), (None, "MIT-LICENSE"), (5, "É mit license ßx cc by" + " cc by" * 30000), (6, "license"), (7, "mit"), (8, "license mit")]
    docs = frame(rows, extra=True)
    got = L.scan_licenses(docs)
    assert set(got.columns) == {c for c in docs.columns if c != "text"} | {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    assert sorted(((r.doc_id, *base_columns(r)) for r in got.collect()), key=str) == sorted(((d, *plain(t)) for d, t in rows), key=str)
    assert L.scan_licenses(frame([])).count() == 0
