import itertools
import math
import re
from collections import Counter

from leagueflow.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
ITEM = "Farmer Joe buys 12 apples and 3 pears at the market near Boston then Joe sells 12 apples for 5 dollars before noon"


def plain_template(text, first_is_name=False):
    out, previous_number, start = [], False, True
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        low, number, name, unit, ends = D.word_form(w)
        if low:
            if first_is_name and not out:
                start = False
            kind = D.NUM if number else D.UNIT if unit and previous_number else D.NAME if name and not start else D.PLAIN
            out.append((kind, low))
            previous_number = number
        start = ends
    return out


def plain_windows(t, n):
    """Each window in its forms: with slots for names, and with names as words (slots for numbers and units, or word for word)."""
    for p in range(len(t) - n + 1):
        w = t[p : p + n]
        kinds = [k for k, _ in w]
        if D.NAME in kinds and kinds.count(D.PLAIN) >= D.LEAST_PLAIN:
            yield p, ("template", *((k, v if k == D.PLAIN else "") for k, v in w)), tuple(v for k, v in w if k != D.PLAIN)
        if sum(k != D.NUM for k in kinds) >= (D.LEAST_PLAIN if n == D.WINDOW else 1):
            if sum(k in (D.PLAIN, D.NAME) for k in kinds) >= D.LEAST_PLAIN:
                worded = [(D.PLAIN if k == D.NAME else k, v) for k, v in w]
                yield p, ("template", *((k, v if k == D.PLAIN else "") for k, v in worded)), tuple(v for k, v in worded if k != D.PLAIN)
            else:
                yield p, ("words", *(v for _, v in w)), ()


def covered(places, n):
    return len({p + k for p in places for k in range(n)})


def item_windows(text, n):
    """The item's windows; those at its begin also as inside a sentence, where the first word could be a name."""
    inside = plain_template(text, True)
    own = set(plain_windows(plain_template(text), n))
    return own | {w for w in plain_windows(inside, n) if w[0] == 0 and inside[0][0] == D.NAME and any(k == (D.NAME, "") for k in w[1])}


def plain_pairs(docs, items):
    out = set()
    for i, it in items:
        n = min(D.WINDOW, len(plain_template(it)))
        windows = item_windows(it, n) if n else set()
        places = {w[0] for w in windows}
        words = covered(places, n)
        needed = min(words, max(D.FLOOR_WORDS, min(D.LEAST_WORDS, math.ceil(D.LEAST_SHARE * words))))
        for d, text in docs:
            alignments = {}
            for (p, key, slots), (ip, ikey, islots) in itertools.product(list(plain_windows(plain_template(text), n)) if n else [], windows):
                if key == ikey:
                    alignments.setdefault(p - ip, set()).add((ip, tuple(zip(islots, slots, strict=True))))
            found = set()
            for met in alignments.values():
                votes = Counter(pair for _, pairs in met for pair in pairs)
                best = {}
                for (own, other), n_votes in votes.items():
                    best[own] = max(best.get(own, (0, False, "")), (n_votes, own == other, other))
                found |= {ip for ip, pairs in met if all(own == other or best[own][2] == other for own, other in pairs)}
            if places and covered(found, n) >= needed:
                out.add((d, i, len(found), len(places)))
    return out


def run(frame, docs, items, spark):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(frame(docs, extra=True), bench).collect()
    return {(r.id, r.item, r.matched, r["of"]) for r in got}, {(r.id, r.item): r.verbatim for r in got}


def test_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [d for d in docs if len(d[1] or "") < 6000] + [(10**6 + i, f"before it {t} after it") for i, t in items[::7]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.id, r.item, r.matched, r["of"]) for r in D.contaminated(frame, bench).collect()}
    want = plain_pairs(docs, items)
    assert got == want and {p[:2] for p in want} >= {(10**6 + i, i) for i, _ in items[::7]}


def test_other_numbers_and_names_are_caught_if_consistent(spark, frame):
    other = ITEM.replace("12", "40").replace("Joe", "Ann").replace("Boston", "Lyon").replace("5 dollars", "9 euros")
    mixed = ITEM.replace("12 apples for", "40 apples for").replace("Joe sells", "Tom sells")
    part = " ".join(ITEM.split()[:9])
    docs = [(1, f"Intro words. {ITEM} and more"), (2, f"Some text then {other}"), (3, f"See {mixed}"), (4, part), (5, ITEM.upper()), (6, "clean words with 12 apples")]
    got, verbatim = run(frame, docs, [(7, ITEM)], spark)
    assert got == plain_pairs(docs, [(7, ITEM)])
    assert {d for d, *_ in got} >= {1, 2, 3, 5} and not {4, 6} & {d for d, *_ in got}
    assert verbatim[1, 7] and not verbatim[2, 7]


def test_passages_full_of_names_are_caught_word_for_word(spark, frame):
    names = "the Old King Henry met Queen Anne Stuart and Prince Rupert Palatine near Castle Windsor Great Park"
    docs = [(1, f"so {names} yes"), (2, f"so {names.replace('Henry', 'Louis').replace('Anne', 'Mary').replace('Rupert', 'Eugene').replace('Windsor', 'Balmoral')} yes"), (3, "1 2 3 4 5 6 7 8")]
    items = [(1, names), (2, "1 2 3 4 5 6 7 8")]
    got, _ = run(frame, docs, items, spark)
    assert got == plain_pairs(docs, items)
    assert {p[:2] for p in got} == {(1, 1)}


def test_changed_copies_as_brute_force_sees_them(spark, frame):
    """One slot changed, in turn, one word changed, in turn, and other cases."""
    words = ITEM.split()
    docs = [(k, "so " + " ".join([*words[:k], "77" if words[k].isdigit() else "Zoe" if words[k][0].isupper() else "other", *words[k + 1 :]]) + " end") for k in range(len(words))]
    docs += [(100, ITEM.title()), (101, ITEM.lower()), (102, ITEM.upper().replace("12", "13")), (103, " ".join(words[5:])), (104, " ".join(words[:11] + ["x"] + words[11:]))]
    got, _ = run(frame, docs, [(7, ITEM)], spark)
    assert got == plain_pairs(docs, [(7, ITEM)]) and {d for d, *_ in got} >= {*range(len(words)), 100, 101}


def test_short_items_are_met_word_for_word(spark, frame):
    items = [(1, "Osmosis"), (2, "Photosynthesis explained"), (3, "Capital of France?"), (4, "Who wrote Hamlet, really?"), (5, "Route 66 map of Ohio"), (6, "1 2 3")]
    docs = [(i, f"Before it {t} after it") for i, t in items] + [(10, "before osmosis after"), (11, "who WROTE hamlet really"), (12, "the capital of spain"), (13, "Route 67 map of Ohio"), (14, "1 2 3 4")]
    got, _ = run(frame, docs, items, spark)
    assert got == plain_pairs(docs, items)
    assert {p[:2] for p in got} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (10, 1), (11, 4), (13, 5)}


def test_numbers_and_units_of_four_languages(spark, frame):
    items = [(1, "wie viele kisten kann der alte wagen mit zwölf kilogramm noch bis zum abend tragen"), (2, "cuántas cajas puede llevar el viejo carro con doce kilos hasta la tarde del lunes"),
             (3, "combien de caisses la vieille voiture peut porter avec douze kilogrammes avant le soir de lundi"), (4, "how many boxes can the old cart with twelve pounds still carry until the evening comes")]
    other = [(1, "einundzwanzig"), (2, "veinte"), (3, "vingt"), (4, "thirty")]
    docs = [(i, t.replace({1: "zwölf", 2: "doce", 3: "douze", 4: "twelve"}[i], n)) for (i, t), (_, n) in zip(items, other, strict=True)]
    got, verbatim = run(frame, docs, items, spark)
    assert got == plain_pairs(docs, items) and {p[:2] for p in got} == {(i, i) for i in range(1, 5)} and not any(verbatim.values())


def test_odd_rows(spark, frame):
    docs = [(1, None), (2, ""), (3, "..."), (None, ITEM), (4, ITEM), (4, ITEM), (5, "tiny plain word item"), (6, "w " * 50000 + ITEM)]
    items = [(1, ITEM), (2, None), (3, ""), (4, "tiny plain word item"), (5, "1 2 3 4 5 6 7 8"), (6, ITEM)]
    got, _ = run(frame, docs, items, spark)
    assert {p[:2] for p in got} == {(d, i) for d in (None, 4, 6) for i in (1, 6)} | {(5, 4)}
    assert run(frame, [], items, spark)[0] == set() and run(frame, docs, [], spark)[0] == set()
    kept = D.drop_contaminated(frame(docs, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame(docs, extra=True).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
