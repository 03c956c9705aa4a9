"""Main text of HTML pages by a linear-chain conditional random field.

A page is a sequence of leaf blocks. Each block has features of its ancestor
tags (and the words of their class, id and role attributes) and of its text;
the chain has weights for the features by label and for each pair of
neighbouring labels. The weights are trained by maximum likelihood (exact
gradients by forward-backward) and pages are decoded by Viterbi.

The labelled pages are layouts from a grammar plus a bounded sample of the
table: about ``SAMPLE_PAGES`` pages, chosen by a hash of the page id, that
mark their article with semantic elements. Every page is extracted, whole.

Defined results for odd input: null and empty pages have empty text and 0
characters; markup that ends early is read as far as it goes; repeated rows
each get their row; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leagueflow.llm.common import table
from leagueflow.llm.dom import Block, blocks
from leagueflow.llm.labelled_pages import layouts, weak_labels

#: Bounds of the training set: pages of the table, their characters, and pages of the grammar.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 100_000
LAYOUT_PAGES = 600
#: Words that the grammar's texts are made of when the sample has none.
FALLBACK_WORDS = "the of and to in that with for was from this which have more about they".split()
STEPS, RATE, RIDGE = 200, 0.1, 1e-4


#: Tags that say little about what they hold.
NEUTRAL = frozenset("html body div p span ul ol li dl dt dd table tbody thead tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption center".split())


@lru_cache(maxsize=1 << 16)
def path_features(path: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    """Of the ancestors: every tag and attribute word above the block; once more those of the innermost element and of the innermost one that says what it holds."""
    found = {f"in:{e[0]}" for e in path} | {f"name:{w}" for e in path for w in e[1:]}
    for e in reversed(path[:-1]):
        if len(e) > 1 or e[0] not in NEUTRAL:
            found |= {f"near:{w}" for w in e}
            break
    if path:
        found |= {f"leaf:{path[-1][0]}", *(f"leafname:{w}" for w in path[-1][1:])}
    if len(path) > 1:
        found.add(f"step:{path[-2][0]}>{path[-1][0]}")
    return tuple(sorted(found))


def text_features(block: Block) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    link = block.link_chars / max(1, len(text) - words + 1)
    out = [f"words:{min(words.bit_length(), 8)}", f"links:{int(min(link, 1.0) * 4)}", f"end:{text[-1] if text[-1] in '.!?:;,' else 'x'}"]
    if "©" in text:
        out.append("copyright")
    if "," in text:
        out.append("comma")
    if " | " in text:
        out.append("bars")
    if words > 1 and text.isupper():
        out.append("upper")
    return out


@dataclass
class ChainModel:
    """Weights by feature and label (0 other, 1 main), of a page's first label, and of neighbouring labels."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        paths: dict = {}
        out = []
        for b in page:
            if b.path not in paths:
                paths[b.path] = self._sum(path_features(b.path))
            p, t = paths[b.path], self._sum(text_features(b))
            out.append((p[0] + t[0], p[1] + t[1]))
        return out

    def _sum(self, names) -> tuple[float, float]:
        a = b = 0.0
        for name in names:
            if w := self.weights.get(name):
                a += w[0]
                b += w[1]
        return a, b

    def viterbi(self, page: list[Block]) -> list[int]:
        """The most probable labels."""
        if not page:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        scores = self.scores(page)
        a, b = self.first[0] + scores[0][0], self.first[1] + scores[0][1]
        back = []
        for x, y in scores[1:]:
            to0, to1 = (a + s00, b + s10), (a + s01, b + s11)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0) + x, max(to1) + y
        label = int(b > a)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train(examples: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> ChainModel:
    """Maximum likelihood with a ridge, by full-batch Adam; all pages go through forward-backward together."""
    examples = [e for e in examples if e[0]]
    names: dict[str, int] = {}
    feature, block, place = [], [], []
    n = 0
    for page, (found, _) in enumerate(examples):
        for k, b in enumerate(found):
            for name in (*path_features(b.path), *text_features(b)):
                feature.append(names.setdefault(name, len(names)))
                block.append(n)
            place.append((page, k))
            n += 1
    if not n:
        return ChainModel()
    feature, block = np.array(feature), np.array(block)
    page, k = np.array(place).T
    truth = np.concatenate([np.array(y) for _, y in examples])
    size = np.bincount(page)
    width = int(size.max())
    real = np.arange(width)[None, :] < size[:, None]
    inner = real[:, 1:]
    gold = np.zeros((len(examples), width), np.int64)
    gold[page, k] = truth
    # parameters: feature weights, first label, neighbouring labels
    theta = np.zeros(2 * len(names) + 2 + 4)
    want_feature = np.zeros((len(names), 2))
    np.add.at(want_feature, feature, np.eye(2)[truth[block]])
    want_first = np.bincount(gold[:, 0], minlength=2)
    want_step = np.zeros((2, 2))
    np.add.at(want_step, (gold[:, :-1][inner], gold[:, 1:][inner]), 1)
    want = np.concatenate([want_feature.ravel(), want_first, want_step.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    log_sum = np.logaddexp.reduce
    for t in range(1, steps + 1):
        w, first, step = theta[: 2 * len(names)].reshape(-1, 2), theta[-6:-4], theta[-4:].reshape(2, 2)
        e = np.zeros((n, 2))
        for y in (0, 1):
            e[:, y] = np.bincount(block, w[feature, y], n)
        score = np.zeros((len(examples), width, 2))
        score[page, k] = e
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = first + score[:, 0]
        for j in range(1, width):
            new = log_sum(ahead[:, j - 1, :, None] + step, axis=1) + score[:, j]
            ahead[:, j] = np.where(real[:, j, None], new, ahead[:, j - 1])
        total = log_sum(ahead[:, -1], axis=1)
        for j in range(width - 2, -1, -1):
            new = log_sum(step + (score[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(real[:, j + 1, None], new, behind[:, j])
        single = np.exp(ahead + behind - total[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + step + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
        expect_feature = np.stack([np.bincount(feature, single[page, k, y][block], len(names)) for y in (0, 1)], axis=1)
        expect = np.concatenate([expect_feature.ravel(), single[:, 0].sum(axis=0), pair[inner].sum(axis=0).ravel()])
        gradient = (want - expect) / n - ridge * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w = theta[: 2 * len(names)].reshape(-1, 2)
    return ChainModel({name: tuple(w[i].tolist()) for name, i in names.items()}, theta[-6:-4].copy(), theta[-4:].reshape(2, 2).copy())


def main_text(page: str | None, model: ChainModel) -> str:
    """The main blocks, joined by line feeds."""
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, model.viterbi(found), strict=True) if label)


def fit(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> ChainModel:
    """The model from the grammar's pages and a bounded sample of ``pages``.

    The sample is drawn by a share of the hashes of the page ids, about
    ``SAMPLE_PAGES`` of all pages; no more than that reaches the driver.
    """
    share = min(1.0, SAMPLE_PAGES / max(1, pages.count()))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("pages")), F.lit(1 << 30))
    small = (F.length(html) > 0) & (F.length(html) <= SAMPLE_CHARS)
    sample = pages.filter((draw < int(share * (1 << 30))) & small).select(F.col(html).alias("html")).collect()
    sample.sort(key=lambda r: r["html"])  # the same order in every run
    parsed = [blocks(r["html"]) for r in sample]
    words = sorted({w for page in parsed for b in page for w in b.text.split()[:20]})[:5000] or FALLBACK_WORDS
    weak = [(page, labels) for page in parsed if (labels := weak_labels(page))]
    return train([*weak, *layouts(LAYOUT_PAGES, words)])


def extract(pages: DataFrame, model: ChainModel, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(html).alias("html"))
    held = pages.sparkSession.sparkContext.broadcast(model)  # a weight for each feature of the bounded training set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, held.value) for h in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[: len(keep)], "text", "n_chars"])

    kinds = ", ".join([*(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))), "text string", "n_chars long"])
    return rows.mapInArrow(run, kinds).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages))
