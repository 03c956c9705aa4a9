"""Language identification with character language models.

One interpolated Kneser-Ney model per language over lower-cased letters, with
every run of other characters as one boundary sign. The n-grams of a model lie
in sorted arrays of 64-bit hashes, an array per order. For scoring, the arrays
of all languages are aligned: one search in the union of the hashes gives the
log-probabilities under every language at once; what a language has not seen
is filled in with its own back-off when the arrays are built.

The language with the lowest cross-entropy per character wins. Two things are
calibrated on labelled documents that were left out of the counts: the
temperature that turns cross-entropies into a score between 0 and 1, and for
each language the cross-entropy beyond which a document is rejected.

The classifier is fitted on a bounded sample: about ``DOCS_PER_LANGUAGE``
documents of each language, chosen by a hash of the id. Every document is
scored, over its whole text.

Defined results for odd input: a null text, or one without a letter, is
``und`` with score 0 and counts as rejected; documents without a language or
an id are not learned from; with nothing to learn from every document is
``und``; a tie goes to the first language in code point order.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leagueflow.llm.common import table

ORDER = 4
#: Bound of the sample that the models are fitted on.
DOCS_PER_LANGUAGE = 1500
#: One in so many sampled documents calibrates instead of being counted.
CALIBRATION = 4
#: Quantile of the calibration documents' cross-entropies, and from the other end of the shuffled
#: ones', between which the rejection bound lies half-way.
EDGE = 0.99
UNKNOWN = "und"
#: Characters that are scored at a time.
BLOCK = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Alphabet:
    """Which code points are letters; made once per Python worker."""

    letters: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls.letters is None:
            cls.letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        return cls.letters


def signs(text: str | None, order: int = ORDER) -> np.ndarray:
    """Code points of the letters, 0 for each boundary, ``order - 1`` zeros in front. Empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(Alphabet.table()[points], points, np.uint32(0))
    if not out.any():
        return out[:0]
    out = np.concatenate([out, np.zeros(1, np.uint32)])
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != 0) | (out[:-1] != 0)
    first[0] = out[0] != 0
    return np.concatenate([np.zeros(order - 1, np.uint32), out[first]])


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """``hashes[n][i]``: of the ``n`` signs that end at ``i``; the first ``n - 1`` places hold nothing useful."""
    code = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(31)
    code *= np.uint64(0x94D049BB133111EB)
    out = [np.zeros(len(points), np.uint64), code]
    for n in range(2, order + 1):
        h = code.copy()
        h[1:] += out[n - 1][:-1] * _MULTIPLIER
        out.append(h)
    return out


def row_hash(grams: np.ndarray) -> np.ndarray:
    """Hash of each row of signs, the same as :func:`gram_hashes` gives."""
    if not grams.shape[1]:
        return np.zeros(len(grams), np.uint64)
    width = grams.shape[1]
    return gram_hashes(grams.ravel(), width)[width][width - 1 :: width]


@dataclass
class Level:
    """One order of one language: n-grams with log-probabilities, contexts with log back-off weights, all by hash."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> tuple[list[Level], float, list[np.ndarray]]:
    """Levels 1 to N, the log-probability of an unseen sign, and the n-grams of each level, from distinct N-grams."""
    order = grams.shape[1]
    seen = {order: (grams, counts.astype(np.float64))}
    for n in range(order - 1, 0, -1):  # lower orders count the distinct signs to the left
        seen[n] = tuple(np.unique(seen[n + 1][0][:, 1:], axis=0, return_counts=True))
    levels, rows, lower, unknown = [], [], None, 0.0
    for n in range(1, order + 1):
        g, a = seen[n]
        a = a.astype(np.float64)
        once, twice = (a == 1).sum(), (a == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, where = np.unique(row_hash(g[:, :-1]), return_inverse=True)
        total = np.bincount(where, a)
        weight = discount * np.bincount(where) / total
        if n == 1:
            unknown = float(np.log(weight[0] / (len(g) + 1)))
            below = np.full(len(g), 1.0 / (len(g) + 1))
        else:
            at, _ = find(lower.grams, row_hash(g[:, 1:]))
            below = np.exp(lower.logp[at])
        p = np.maximum(a - discount, 0) / total[where] + weight[where] * below
        key = row_hash(g)
        sort = np.argsort(key)
        lower = Level(key[sort], np.log(p)[sort], contexts, np.log(weight))
        levels.append(lower)
        rows.append(g)
    return levels, unknown, rows


@dataclass
class Models:
    """All languages. ``levels[n-1]``: n-gram hashes, their matrix by language, context hashes, their matrix."""

    langs: list[str]
    order: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    unknown: np.ndarray
    temperature: float = 1.0
    reject: np.ndarray | None = None

    def log_probabilities(self, hashes: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        """Rows by place, columns by language; ``at`` are places in the hashed signs."""
        if n == 0:
            return np.broadcast_to(self.unknown, (len(at), len(self.langs)))
        keys, matrix, contexts, backoff = self.levels[n - 1]
        where, there = find(keys, hashes[n][at])
        out = matrix[where]
        if not there.all():
            miss = np.nonzero(~there)[0]
            rest = self.log_probabilities(hashes, at[miss], n - 1).astype(np.float32)
            if n > 1:
                ctx, known = find(contexts, hashes[n - 1][at[miss] - 1])
                rest = rest + np.where(known[:, None], backoff[ctx], np.float32(0))
            out[miss] = rest
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per sign of each text under each language (0 without a letter), and the number of signs."""
        h = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts), np.int64)
        if not self.langs:
            return h, n
        held, held_size = [], 0

        def flush() -> None:
            nonlocal held, held_size
            if not held:
                return
            hashes = gram_hashes(np.concatenate([s for _, s in held]), self.order)
            ends = np.cumsum([len(s) for _, s in held])
            scored = np.ones(ends[-1], bool)
            for end, (_, s) in zip(ends, held, strict=True):
                scored[end - len(s) : end - len(s) + self.order - 1] = False
            logp = self.log_probabilities(hashes, np.nonzero(scored)[0], self.order)
            sizes = np.array([len(s) - self.order + 1 for _, s in held])
            sums = np.add.reduceat(logp, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            for (i, _), size, total in zip(held, sizes, sums, strict=True):
                n[i] += size
                h[i] -= total
            held, held_size = [], 0

        for i, text in enumerate(texts):
            s = signs(text, self.order)
            # a long text is scored in pieces; each but the first begins with the context it needs
            for start in range(0, max(0, len(s) - self.order + 1), BLOCK):
                held.append((i, s[start : start + BLOCK + self.order - 1]))
                held_size += len(held[-1][1])
                if held_size >= BLOCK:
                    flush()
        flush()
        return np.divide(h, n[:, None], out=h, where=n[:, None] > 0), n

    def decide(self, h: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return [UNKNOWN] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
        best = h.argmin(axis=1)
        lowest = h[np.arange(len(h)), best]
        score = 1.0 / np.exp((lowest[:, None] - h) * self.temperature).sum(axis=1)
        lang = [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
        return lang, np.where(n > 0, score, 0.0), (n == 0) | (lowest > self.reject[best])


def build(counts: dict[str, Counter]) -> Models:
    """Models from the N-gram counts of each language."""
    langs = sorted(counts)
    if not langs:
        return Models([], ORDER, [], np.zeros(0))
    single, unknown, rows = [], [], []
    for lang in langs:
        grams = np.array([[ord(c) for c in g] for g in counts[lang]], np.uint32)
        levels, unk, seen = kneser_ney(grams, np.array(list(counts[lang].values())))
        single.append(levels)
        unknown.append(unk)
        rows.append(seen)
    order = len(single[0])
    models = Models(langs, order, [], np.array(unknown, np.float32))
    for n in range(1, order + 1):
        every = np.unique(np.concatenate([r[n - 1] for r in rows]), axis=0)
        key = row_hash(every)
        sort = np.argsort(key)
        every, key = every[sort], key[sort]
        # a language that lacks an n-gram backs off: its context's weight, if it has that, and the level below
        if n == 1:
            matrix = np.tile(models.unknown, (len(key), 1))
        else:
            low_keys, low, _, _ = models.levels[n - 2]
            at, _ = find(low_keys, row_hash(every[:, 1:]))
            matrix = low[at].copy()
        context = row_hash(every[:, :-1])
        contexts = np.unique(context)
        backoff = np.zeros((len(contexts), len(langs)), np.float32)
        for column, levels in enumerate(single):
            level = levels[n - 1]
            at, there = find(level.contexts, contexts)
            backoff[there, column] = level.backoff[at[there]]
            if n > 1:
                matrix[:, column] += backoff[np.searchsorted(contexts, context), column]
            at, there = find(level.grams, key)
            matrix[there, column] = level.logp[at[there]]
        models.levels.append((key, matrix.astype(np.float32), contexts, backoff))
    return models


def shuffled(text: str | None) -> str:
    """The text with its characters in random order: the same letters, but no language."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.random.default_rng(0).permutation(points).tobytes().decode("utf-32-le", "surrogatepass")


def calibrate(models: Models, h: np.ndarray, noise: np.ndarray, langs: list[str]) -> None:
    """Temperature by likelihood; rejection bounds between the documents of a language and shuffled documents.

    ``h``: cross-entropies of labelled documents; ``noise``: the lowest one of each after shuffling.
    A language without a calibration document, or whose documents come out no
    better than shuffled ones, gets the bound of all languages together; only
    where those are no better either there is nothing to reject by.
    """
    models.reject = np.full(len(models.langs), np.inf)
    use = [i for i, lang in enumerate(langs) if lang in models.langs]
    if not use:
        return
    truth = np.array([models.langs.index(langs[i]) for i in use])
    own, far = h[use], np.quantile(noise[use], 1 - EDGE)
    best = None
    for t in 2.0 ** np.arange(-2, 9):
        shifted = (own.min(axis=1, keepdims=True) - own) * t
        loss = (np.log(np.exp(shifted).sum(axis=1)) - shifted[np.arange(len(use)), truth]).mean()
        if best is None or loss < best[0]:
            best = (loss, t)
    models.temperature = float(best[1])
    pooled = np.quantile(own[np.arange(len(use)), truth], EDGE)
    for k in range(len(models.langs)):
        near = np.quantile(own[truth == k, k], EDGE) if (truth == k).any() else np.inf
        near = near if far > near else pooled
        models.reject[k] = (near + far) / 2 if far > near else np.inf


def _gram_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = signs(text, order)
                line = s.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                found.setdefault(lang, Counter()).update(map("".join, zip(*(line[k:] for k in range(order)), strict=False)))
            rows = [(lang, g.encode("utf-8", "surrogatepass"), c) for lang, grams in found.items() for g, c in grams.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "gram", "n"])

    return run


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def fit(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> Models:
    """Models from the rows that ``learnable`` marks."""
    rows = docs.filter(learnable & F.col(lang).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row per language
    if not sizes:
        return Models([], order, [], np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, per_language / v)])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 30))
    sample = rows.filter(draw < share[F.col(lang)] * (1 << 30)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    counted = sample.filter(draw_part("draw") != 0).select("lang", "text").mapInArrow(_gram_counts(order), "lang string, gram binary, n long")
    counts: dict[str, Counter] = {}
    for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], Counter())[bytes(r["gram"]).decode("utf-8", "surrogatepass")] = r["n"]
    models = build(counts)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            h, n = held.value.cross_entropy(texts)
            noise = held.value.cross_entropy([shuffled(t) for t in texts])[0].min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(h), pa.list_(pa.float64())), pa.array(noise), pa.array(n)], ["lang", "h", "noise", "n"])

    left_out = sample.filter(draw_part("draw") == 0).select("lang", "text")
    if models.langs:
        seen = left_out.mapInArrow(entropies, "lang string, h array<double>, noise double, n long").filter("n > 0").collect()
        calibrate(models, np.array([r["h"] for r in seen]).reshape(len(seen), -1), np.array([r["noise"] for r in seen]), [r["lang"] for r in seen])
    return models


def draw_part(name: str) -> Column:
    return F.pmod(F.xxhash64(F.col(name)), F.lit(CALIBRATION))


def identify(docs: DataFrame, models: Models, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` (without the text if so asked) plus ``lang_pred``, ``score`` and ``rejected``, which replace columns of those names."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    held = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample that it was fitted on
    place = keep.index(text)
    out = [i for i, c in enumerate(keep) if with_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = held.value.decide(*held.value.cross_entropy(batch.column(place).to_pylist()))
            columns = [*(batch.column(i) for i in out), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, [*(keep[i] for i in out), "lang_pred", "score", "rejected"])

    schema = T.StructType([*(rows.schema.fields[i] for i in out), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(run, schema)


#: Documents whose crc32 has this remainder by 4 are held out.
HELD_OUT = 2


def learned_models(docs: DataFrame) -> Models:
    return fit(docs, remainder("doc_id", 4) != HELD_OUT)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that language ID does not reject, with the columns of ``docs``."""
    names = docs.columns
    slim = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kept = identify(slim, learned_models(docs), f"c{names.index('text')}").filter("NOT rejected")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == HELD_OUT, F.lit(False))
    # text is read, scored and dropped in one pass; the label is not part of what is scored
    found = identify(docs.select("doc_id", "text"), learned_models(docs), with_text=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
