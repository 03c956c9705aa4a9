"""Benchmark decontamination by template windows.

Words lose their case and outer punctuation. Numbers, names and units become
typed placeholders, so a question keeps its template when someone puts in
other values. What is a name shows in the case of the words, so a window with
names has a second form in which they are words like others and their case is
lost; a document in title case or capitals meets the item in that form, which
needs the same names. Templates are cut into windows of words; windows of documents
and of benchmark items meet in a hash join. Along one alignment of a document
and an item a window counts if its values are the item's own, or if each other
value is the one that most windows of the alignment have for that value of the
item; windows with a conflicting value are left out, the rest of the alignment
stays. A document is contaminated by an item when the windows that count, of
all its alignments, cover enough of the item's words; so an edit costs the
words that only its windows cover.

A bit map of fixed size, made of the benchmark's window hashes, goes to the
tasks and keeps windows that no item has out of the join; it saves work and
decides nothing.

Defined results for odd input: null and empty texts have no windows; an item
of fewer words than a window is one window of its own length, met word for
word (but for case) if it has too few plain words for a template; windows of
nothing but numbers are no evidence, so an item without other words never
matches; repeated rows give their pairs once; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.llm.common import table
from leagueflow.llm.tokens import slices, words

#: Words in a window.
WINDOW = 6
#: Words of a window that must not be placeholders, so that it counts as a template.
LEAST_PLAIN = 4
#: Words of an item that its matched windows must cover; of items with few words a share, but never fewer than the floor (or the whole item, if it is shorter).
LEAST_WORDS = 13
#: With windows of 6 words, one edit of an item of 14 words leaves 8 covered in the worst place.
LEAST_SHARE = 0.55
FLOOR_WORDS = 8
#: The bit map has 2 ** MAP_BITS bits.
MAP_BITS = 22

#: Words that are a unit when they follow a number, in English, German, Spanish and French.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec min h hr hrs ms "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters gram grams "
    "kilogram kilograms ounce ounces pound pounds ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars cent cents euro euros percent degrees "
    "zoll meilen gramm kilogramm pfund tonne tonnen sekunde sekunden stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad minuten "
    "pulgada pulgadas pie pies milla millas metro metros kilómetro kilómetros centímetro centímetros gramo gramos kilo kilos kilogramo kilogramos tonelada toneladas "
    "litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares céntimo céntimos grados "
    "pouce pouces mètre mètres kilomètre kilomètres centimètre centimètres gramme grammes kilogramme kilogrammes livre livres seconde secondes heure heures "
    "jour jours semaine semaines mois an ans année années centime centimes degrés".split()
)
#: Numbers that are written out, in the same languages; articles that also count are left out.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
    "forty fifty sixty seventy eighty ninety hundred thousand million "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig "
    "fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta "
    "cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille".split()
)
#: German writes tens and ones in one word, the ones first.
_GERMAN_COMPOUND = re.compile(r"(?:ein|zwei|drei|vier|fünf|sechs|sieben|acht|neun)und(?:zwanzig|dreißig|vierzig|fünfzig|sechzig|siebzig|achtzig|neunzig)")
NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:%|st|nd|rd|th)?")
OUTER = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")

PLAIN, NUM, NAME, UNIT = range(4)
EXACT, NUMBERS, NAMES = range(3)
PLACEHOLDERS = np.array([xxhash.xxh64_intdigest(f"<{k}>") for k in ("plain", "num", "name", "unit")], np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_form(word: str) -> tuple[str, bool, bool, bool, bool]:
    """The bare word without its case; whether it is a number, might be a name, might be a unit, and ends a sentence."""
    ends = word.endswith((".", "!", "?", ":")) or word[:-1].endswith((".", "!", "?"))
    bare = OUTER.sub("", word)
    low = bare.casefold()
    number = bool(NUMBER.fullmatch(low)) or low in NUMBER_WORDS or bool(_GERMAN_COMPOUND.fullmatch(low))
    name = not number and len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
    return low, number, name, low in UNITS, ends


class Templates:
    """Typed words of a column of texts, and the hashes of their windows."""

    def __init__(self, column: pa.Array, first_is_name: bool = False):
        numbers, dictionary, sizes = words(column)
        forms = [word_form(w) for w in dictionary.to_pylist()]
        self.bare = [f[0] for f in forms]
        flags = np.array([f[1:] for f in forms], bool).reshape(-1, 4)
        literal = np.fromiter((xxhash.xxh64_intdigest(f[0].encode("utf-8", "surrogatepass")) for f in forms), np.uint64, len(forms))
        # punctuation that stands alone is no word
        solid = np.fromiter((bool(b) for b in self.bare), bool, len(forms))[numbers]
        row = np.repeat(np.arange(len(sizes)), sizes)
        number, name, unit, ends = flags[numbers].T if len(numbers) else np.zeros((4, 0), bool)
        start = np.ones(len(numbers), bool)
        start[1:] = (row[1:] != row[:-1]) | ends[:-1]
        self.numbers, self.row = numbers[solid], row[solid]
        number, name, unit, start = number[solid], name[solid], unit[solid], start[solid]
        if first_is_name:
            begin = np.ones(len(self.row), bool)
            begin[1:] = self.row[1:] != self.row[:-1]
            start = start & ~begin
        after_number = np.zeros(len(number), bool)
        after_number[1:] = number[:-1] & (self.row[1:] == self.row[:-1])
        self.kind = np.where(number, NUM, np.where(unit & after_number, UNIT, np.where(name & ~start, NAME, PLAIN)))
        self.literal = literal[self.numbers] if len(forms) else np.zeros(0, np.uint64)
        self.code = np.where(self.kind == PLAIN, self.literal, PLACEHOLDERS[self.kind])
        self.sizes = np.bincount(self.row, minlength=len(sizes))
        self.begins = np.cumsum(self.sizes) - self.sizes

    def windows(self, size: int, least_plain: int = LEAST_PLAIN, least_words: int = LEAST_PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each window that is evidence, the place of its first word, and its form (EXACT, NUMBERS or NAMES: what has slots in it).

        A window with names counts as a template with slots for them if it has
        enough plain words. Each window counts with its names as words: with
        slots for numbers and units if enough other words are left, else word
        for word if enough of its words (``least_words``) are no numbers. That
        form does not depend on the case of the words.
        """
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)

        def count(which: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(which)])
            return total[size:] - total[:n]

        def hashed(code: np.ndarray, seed: int) -> np.ndarray:
            h = np.full(n, seed, np.uint64)
            for k in range(size):
                h = h * _MULTIPLIER + code[k : k + n]
            h ^= h >> np.uint64(29)
            return h * np.uint64(0xBF58476D1CE4E5B9)

        is_name = self.kind == NAME
        one_row = self.row[:n] == self.row[size - 1 :]
        named = np.flatnonzero(one_row & (count(is_name) > 0) & (count(self.kind == PLAIN) >= least_plain))
        folded = np.flatnonzero(one_row & (count(self.kind != NUM) >= least_words))
        template = hashed(np.where(is_name, self.literal, self.code), size)
        with_slots = count((self.kind == PLAIN) | is_name) >= least_plain
        h = np.where(with_slots, template, hashed(self.literal, size + 100))
        return np.concatenate([h[folded], hashed(self.code, size)[named]]), np.concatenate([folded, named]), np.concatenate([np.where(with_slots, NUMBERS, EXACT)[folded], np.full(len(named), NAMES)])

    def slots(self, at: int, size: int, form: int) -> list[str]:
        """Values in the slots of the window at a place."""
        if form == EXACT:
            return []
        return [self.bare[self.numbers[i]] for i in range(at, at + size) if self.kind[i] != PLAIN and (form == NAMES or self.kind[i] != NAME)]


def _emit(columns: list[pa.Array], names: list[str], found: list[tuple[Templates, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of the given columns with the windows found in their texts."""
    row, pos, size, h, slots, total = [], [], [], [], [], []
    for t, n, hashes, at, form in found:
        r = t.row[at]
        row.append(r)
        pos.append(at - t.begins[r])
        size.append(np.full(len(at), n))
        h.append(hashes.view(np.int64))
        total.append(t.sizes[r])
        slots += [t.slots(a, n, f) for a, f in zip(at.tolist(), form.tolist())]
    take = pa.array(np.concatenate(row))
    arrays = [c.take(take) for c in columns]
    arrays += [pa.array(np.concatenate(x).astype(np.int64)) for x in (pos, size, total)] + [pa.array(np.concatenate(h)), pa.array(slots, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, [*names, "pos", "size", "words", "window", "slots"])


def _least_words(size: int, window: int) -> int:
    """Words that must be no numbers: of a whole short item one is enough, as all its words have to be there."""
    return LEAST_PLAIN if size == window else 1


WINDOW_COLUMNS = "pos long, size long, words long, window long, slots array<string>"


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All windows of the items: ``item``, its position, length and slots, and the ``words`` of the item.

    The first word of an item may stand inside a sentence in a document, so its
    windows come twice if that word could be a name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = []
                for first_is_name in (False, True):
                    t = Templates(part.column(1), first_is_name)
                    for n in range(1, window + 1):
                        h, at, form = t.windows(n, least_words=_least_words(n, window))
                        full = t.sizes[t.row[at]]
                        use = (n == window) | (full == n)
                        if first_is_name:
                            use &= (form == NAMES) & (at == t.begins[t.row[at]])
                            use &= t.kind[at] == NAME
                        found.append((t, n, h[use], at[use], form[use]))
                yield _emit([part.column(0)], ["item"], found)

    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, {WINDOW_COLUMNS}")


def document_windows(docs: DataFrame, sizes: list[int], bit_map: np.ndarray, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Windows of the documents whose bit is set: ``id``, ``body`` (a hash of the text), position, length and slots."""
    held = docs.sparkSession.sparkContext.broadcast(bit_map)  # 2 ** MAP_BITS bits, whatever the benchmark's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            for part in slices(batch, 2):
                t = Templates(part.column(2))
                found = []
                for n in sizes:
                    h, at, form = t.windows(n, least_words=_least_words(n, window))
                    place = h >> np.uint64(64 - MAP_BITS)
                    hit = bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
                    found.append((t, n, h[hit], at[hit], form[hit]))
                yield _emit([part.column(0), part.column(1)], ["id", "body"], found)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, body long, {WINDOW_COLUMNS}")


def _bit_map(items: DataFrame) -> np.ndarray:
    places = items.select(F.shiftrightunsigned("window", 64 - MAP_BITS).alias("p")).distinct().toPandas()["p"].to_numpy()  # at most 2 ** MAP_BITS
    out = np.zeros(1 << MAP_BITS - 3, np.uint8)
    np.bitwise_or.at(out, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
    return out


def _agreed(windows: Column) -> Column:
    """The pairs of an alignment: for each value of the item the document's value that most windows have, of equals the item's own, then the largest."""
    pairs = F.flatten(F.transform(windows, lambda w: w["pairs"]))
    distinct = F.array_distinct(pairs)

    def best(value: Column) -> Column:
        of_value = F.filter(distinct, lambda p: p["item"] == value)
        ranked = F.transform(of_value, lambda p: F.struct(F.size(F.filter(pairs, lambda q: q == p)), p["item"] == p["doc"], p.alias("pair")))
        return F.array_max(ranked)["pair"]

    values = F.array_distinct(F.transform(distinct, lambda p: p["item"]))
    return F.when(F.size(values) == F.size(distinct), distinct).otherwise(F.transform(values, best))


def _covered(places: Column, size: Column) -> Column:
    """Words that windows of a size at these places cover."""
    step = lambda acc, p: F.struct((acc["words"] + p + size - F.greatest(p, acc["end"])).alias("words"), (p + size).alias("end"))
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(F.array_distinct(places)), start, step, lambda acc: acc["words"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """Pairs of a document and an item that it contains.

    Columns: ``id``, ``body`` (hash of the document's text), ``item``,
    ``matched`` (windows of the item that count in some alignment), ``of``
    (windows of the item), ``verbatim`` (no slot of a window that was found has
    another value, whether the window counts or not).
    """
    items = item_windows(benchmark, item_col, item_text, window)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [window]  # at most ``window`` numbers
    totals = items.groupBy("item").agg(F.count_distinct("pos").alias("of"), F.collect_set("pos").alias("all"), F.max("size").alias("size"))
    found = document_windows(docs, sizes, _bit_map(items), id_col, text, window)
    known = items.select("item", F.col("pos").alias("item_pos"), "window", F.col("slots").alias("item_slots"))
    hits = found.select("id", "body", "pos", "window", "slots").join(known, "window")
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"].alias("item"), z["slots"].alias("doc")))
    # an alignment has at most a few windows for each place of the item
    aligned = (
        hits.withColumn("pairs", pairs)
        .groupBy("id", "body", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .agg(F.collect_set(F.struct("item_pos", "pairs")).alias("windows"))
        .withColumn("agreed", _agreed(F.col("windows")))
    )
    own = lambda p: p["item"] == p["doc"]
    counts = F.filter("windows", lambda w: F.forall(w["pairs"], lambda p: own(p) | F.array_contains(F.col("agreed"), p)))
    matched = (
        aligned.select("id", "body", "item", F.array_distinct(counts["item_pos"]).alias("places"), F.forall("windows", lambda w: F.forall(w["pairs"], own)).alias("verbatim"))
        .groupBy("id", "body", "item")
        .agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.bool_and("verbatim").alias("verbatim"))
    )
    # words that no window of evidence covers can't be asked for
    words = _covered(F.col("all"), F.col("size"))
    needed = F.least(F.col("words"), F.greatest(F.lit(FLOOR_WORDS), F.least(F.lit(least_words), F.ceil(F.lit(LEAST_SHARE) * F.col("words")))))
    totals = totals.select("item", "of", "size", words.alias("words")).withColumn("needed", needed)
    enough = matched.join(totals, "item").filter(_covered(F.col("places"), F.col("size")) >= F.col("needed"))
    return enough.select("id", "body", "item", F.size("places").alias("matched"), "of", "verbatim")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that contain an item."""
    bad = contaminated(docs, benchmark, id_col, text).select(F.col("id").alias("__id"), F.col("body").alias("__body")).distinct()
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (body == F.col("__body")), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return pairs.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("matched").cast("long"), F.col("of").alias("item_windows"), "verbatim").distinct()
