"""Quality scores by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so have a few pairs of
features over coarser bins. Training boosts in cycles: feature by feature, a shallow tree
(four leaves) is fitted to the loss's gradient over that feature's bins alone and a small
step of it is added to the table; the pairs follow, each with one cut on either axis. A
score is the sum of the entries that a text's bins select, turned into a probability.

The model is trained on the driver from a bounded sample of labelled rows (TRAIN_ROWS at
most, those whose ids hash lowest); every row is scored.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrilith.llm.common import id_and_text, slices, utf8

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Bins of a feature, and of a feature in a pair; cycles; step; pairs.
BINS, PAIR_BINS, CYCLES, PAIR_CYCLES, STEP, PAIRS = 48, 12, 80, 30, 0.15, 8

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "exclamations", "bars", "stops", "commas", "beyond_ascii", "distinct_words", "commonest_word", "same_as_before", "symbol_ends", "log_lines", "line_words", "distinct_lines")

_CLASS = np.zeros((256, 8), np.float64)
for _k, _own in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#$%&*+/<=>@[\\]^_`{|}~", b"!", b"|", b".", b",")):
    _CLASS[list(_own), _k] = 1
_LETTER_END = frozenset(range(48, 58)) | frozenset(range(65, 91)) | frozenset(range(97, 123)) | frozenset(range(128, 256)) | frozenset(b".,;:!?'\")")


def features(text: bytes) -> list[float]:
    """The features of a UTF-8 text; an empty text has zeros throughout."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, symbols, excl, bars, stops, commas = byte @ _CLASS
    common = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    odd = sum(c for w, c in common.items() if w[-1] not in _LETTER_END or w[-2:] == b"!!")
    return [
        np.log1p(size), np.log1p(n), size / n, upper / max(1.0, upper + lower), digits / size, symbols / size, excl / n, bars / n, stops / n, commas / n, byte[128:].sum() / size,
        len(common) / n, max(common.values()) / n, sum(map(operator.eq, words, words[1:])) / n, odd / n, np.log1p(len(lines)), n / len(lines), len(set(lines)) / len(lines),
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, least: float = 1.0) -> np.ndarray:
    """A regression tree's value for each bin, from the bins' sums of gradient and hessian."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int):
        cut = np.arange(a + 1, b)
        if not len(cut):
            return (0.0, 0, a, b)
        left, right = (cg[cut] - cg[a]) ** 2 / (ch[cut] - ch[a] + least), (cg[b] - cg[cut]) ** 2 / (ch[b] - ch[cut] + least)
        gain = left + right - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + least)
        k = int(np.argmax(gain))
        return (float(gain[k]), int(cut[k]), a, b)

    parts = [best(0, len(g))]
    while len(parts) < leaves and (top := max(parts))[0] > 1e-9:
        parts.remove(top)
        parts += [best(top[2], top[1]), best(top[1], top[3])]
    out = np.empty(len(g))
    for _, _, a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + least)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
    """The best tree with one cut on either axis over a table of bins: gain and values."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    m, k = g.shape
    i, j = np.arange(1, m)[:, None], np.arange(1, k)[None, :]
    if m < 2 or k < 2:
        return 0.0, np.zeros_like(g)

    def quads(c):
        a, b, d, t = c[i, j], c[i, k] - c[i, j], c[m, j] - c[i, j], c[m, k]
        return a, b, d, t - a - b - d

    qg, qh = quads(cg), quads(ch)
    gain = sum(x**2 / (y + least) for x, y in zip(qg, qh, strict=True))
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    ci, cj = at[0] + 1, at[1] + 1
    for part, x, y in zip((np.s_[:ci, :cj], np.s_[:ci, cj:], np.s_[ci:, :cj], np.s_[ci:, cj:]), qg, qh, strict=True):
        out[part] = x[at] / (y[at] + least)
    return float(gain[at]), out


@dataclass
class AdditiveModel:
    """Intercept, and tables over the bins of features and of pairs of features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def _bins(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        f = np.full(len(x), self.intercept)
        if self.tables and len(x):
            own = self._bins(self.edges, x)
            for k, t in enumerate(self.tables):
                f += t[own[:, k]]
            own = self._bins(self.pair_edges, x)
            for a, b, t in self.pairs:
                f += t[own[:, a], own[:, b]]
        return 1 / (1 + np.exp(-f))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Boost in cycles. Without rows of both labels only the intercept is set."""
        n = len(y)
        mean = (y.sum() + 0.5) / (n + 1)
        model = cls(float(np.log(mean / (1 - mean))))
        if not n or y.min() == y.max():
            return model
        cuts = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) for c in x.T]
        model.edges, model.pair_edges = cuts(BINS), cuts(PAIR_BINS)
        own = model._bins(model.edges, x)
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        f = np.full(n, model.intercept)
        for _ in range(CYCLES):
            for k, t in enumerate(model.tables):
                p = 1 / (1 + np.exp(-f))
                step = STEP * _tree(np.bincount(own[:, k], y - p, len(t)), np.bincount(own[:, k], p * (1 - p), len(t)))
                t += step
                f += step[own[:, k]]
        own = model._bins(model.pair_edges, x)
        width = [len(e) + 1 for e in model.pair_edges]

        def sums(a: int, b: int):
            p = 1 / (1 + np.exp(-f))
            at = own[:, a] * width[b] + own[:, b]
            return _quadrants(*(np.bincount(at, v, width[a] * width[b]).reshape(width[a], width[b]) for v in (y - p, p * (1 - p))))

        ranked = sorted(((-sums(a, b)[0], a, b) for a in range(len(width)) for b in range(a)), key=lambda r: r)
        model.pairs = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in ranked[:PAIRS]]
        for _ in range(PAIR_CYCLES):
            for a, b, t in model.pairs:
                step = STEP * sums(a, b)[1]
                t += step
                f += step[own[:, a], own[:, b]]
        return model


def _with_features(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            x = [features(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, "doc_id bigint, x array<double>")


def held_out(doc_id) -> F.Column:
    """Whether a document's label is kept from training. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most `rows` labelled documents that aren't held out.

    `labels` has doc_id and quality; null labels, and ids whose labels differ, are left
    out. Documents that share an id count once. Without labels the model is a constant.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("y")).filter("low = y").select("doc_id", "y")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids
    found = _with_features(id_and_text(docs).join(F.broadcast(chosen.select("doc_id")), "doc_id"))
    sample = found.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow()
    y = sample.column("y").to_numpy().astype(np.float64)
    x = np.asarray(sample.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    return AdditiveModel.fit(x, y)


def score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with one more column, the probability that its text has label 1. All rows and columns stay; a null text is scored as an empty one."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for batch in slices(batches, text_col):
            texts = utf8(batch.column(text_col))
            x = np.asarray([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
