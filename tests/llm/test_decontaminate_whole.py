"""Copies of an item that are changed in one place."""

from leagueflow.llm import decontaminate as D

from test_decontaminate import ITEM


def found(spark, frame, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.id, r.item): r for r in D.contaminated(frame(docs), bench).collect()}


def test_one_inconsistent_slot_costs_only_its_windows(spark, frame):
    mixed = ITEM.replace("12 apples for", "40 apples for").replace("Joe sells", "Tom sells")
    other = ITEM.replace("12", "40").replace("Joe", "Ann").replace("Boston", "Lyon")
    docs = [(1, f"See {mixed}"), (2, f"See {ITEM.replace('sells 12', 'sells 13')}"), (3, f"See {other.replace('sells 40', 'sells 41')}"), (4, f"See {ITEM}")]
    docs += [(5, "See " + " then ".join([" ".join(mixed.split()[12:])] * 2))]
    got = found(spark, frame, docs, [(7, ITEM)])
    assert {d for d, _ in got} == {1, 2, 3, 4}
    assert got[4, 7].matched == got[4, 7]["of"] and all(8 <= got[d, 7].matched < got[d, 7]["of"] for d in (1, 2, 3))
    assert {d: got[d, 7].verbatim for d in (1, 2, 3, 4)} == {1: False, 2: False, 3: False, 4: True}
    kept = D.drop_contaminated(frame(docs), spark.createDataFrame([(7, ITEM)], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [5]


def test_one_edit_of_a_short_item_is_caught_wherever_it_is(spark, frame):
    plain = "some people say that green birds often sing along quiet rivers while grey foxes rest under old trees".split()
    items = [(n, " ".join(plain[:n])) for n in range(13, 19)]
    docs, edits = [], {}
    for n in range(13, 19):
        for at in range(n):
            copy = plain[:n]
            copy[at] = "changed"
            edits[len(docs)] = n, at
            docs.append((len(docs), "Before it " + " ".join(copy) + " comes more"))
    docs += [(1000, "Before it " + " ".join(plain[:7]) + " comes more"), (1001, " ".join(plain[:6] + ["changed"] + plain[8:9]))]
    got = {edits.get(d): i for d, i in found(spark, frame, docs, items) if edits.get(d, (i,))[0] == i}
    # only the sixth word from an end of an item of 13 words leaves fewer words than the floor
    missed = set(edits.values()) - set(got)
    assert missed == {(13, 5), (13, 7)} and None not in got


def test_covered_words(spark):
    cases = [([], 0), ([0], 6), ([0, 1, 2], 8), ([0, 0, 9, 10], 13), ([20, 3], 12)]
    rows = spark.createDataFrame(cases, "places array<long>, want long")
    assert [r[0] for r in rows.select(D._covered(rows.places, D.F.lit(6))).collect()] == [w for _, w in cases]


def test_copies_in_another_case_are_caught(spark, frame):
    plain = "some people say that green birds often sing along quiet rivers while 12 foxes rest under old trees"
    german = "Im Garten hinter der Straße wächst ein großer Baum mit Äpfeln und die Kinder spielen dort nach der Schule bis zum Abend"
    items = [(1, ITEM), (2, plain), (3, german)]
    docs = [(10 * c + i, "before it " + case(text) + " after it") for i, text in items for c, case in enumerate((str.title, str.upper, str.lower, str.swapcase))]
    docs += [(100, plain.title().replace("12", "40")), (101, ITEM.upper().replace("12", "40")), (102, "clean words with Names In Title Case and 12 apples")]
    assert set(found(spark, frame, docs, items)) == {(10 * c + i, i) for i, _ in items for c in range(4)} | {(100, 2), (101, 1)}
