"""Quality by a generalised additive model with pairwise interactions.

Each text is described by a few shares and counts; every feature is cut into bins at quantiles. Boosting goes round the
features: a shallow tree on the bins' gradients adds a small step to the feature's lookup table. Then the pairs of
features with the largest gain on what is left get two-dimensional tables in the same way. Scoring adds the table
entries of a text's bins, for all texts of a batch at once.

Fitting takes at most max_fit labelled rows, those with the lowest hash of their id; their features, not their texts,
reach the driver. Defined results: null and empty texts have all features 0 and get a score like any other; ids with
labels that disagree, and null labels, are not learned from; of rows that repeat a labelled id the least text is learned; repeated rows get equal scores; without a label to learn
from every score is 0.5. Whole texts are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from evidra.llm._shared import map_batches, steps, strings, with_columns
from evidra.llm.toxicity import sample_of

FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "symbol", "non_ascii", "line_words", "repeated_lines", "distinct_words", "top_word", "longest_word",
    "sentence_words", "distinct_tail", "no_letter_words", "no_letter_lines", "symbol_run", "longest_symbol_run", "symbol_entropy",
]
#: Bins of a feature, and of either feature of a pair.
BINS, PAIR_BINS = 32, 8
#: ASCII symbols, and each byte's class: letter (with all that isn't ASCII), digit, symbol, or white space as it is.
_SYMBOLS = [i for i in range(33, 127) if not chr(i).isalnum()]
_FLAT = bytes(ord("a") if i >= 128 or chr(i).isalpha() else ord("0") if chr(i).isdigit() else ord(".") if i in _SYMBOLS else i if chr(i).isspace() else ord("a") for i in range(256))
_RUN = re.compile(rb"\.+")


def describe(texts: list[str]) -> np.ndarray:
    """(texts, features): sizes, shares of character classes, repetition of words and lines, words and lines without a letter,
    and how symbols cluster (mean and longest run) and vary (entropy)."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        if not words:
            continue
        n, w, flat = len(raw), len(words), raw.translate(_FLAT)
        each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        symbols = each[_SYMBOLS]
        total = int(symbols.sum())
        share = symbols[symbols > 0] / max(total, 1)
        runs = list(map(len, _RUN.findall(flat)))
        lines, plain = raw.split(b"\n"), [x for x in flat.split(b"\n") if x.strip()]
        lengths = np.fromiter(map(len, words), np.int64, w)
        seen = Counter(words)
        tail = words[w // 2 :]
        out[i] = [
            np.log1p(n), np.log1p(w), lengths.mean(), each[65:91].sum() / n, each[48:58].sum() / n, (n - lengths.sum()) / n, total / n, each[128:].sum() / n, w / len(lines), 1 - len(set(lines)) / len(lines),
            len(seen) / w, max(seen.values()) / w, lengths.max(), w / (1 + each[46]), len(set(tail)) / len(tail), sum(b"a" not in x for x in flat.split()) / w, sum(b"a" not in x for x in plain) / max(len(plain), 1),
            total / max(len(runs), 1), max(runs, default=0), -(share * np.log(share)).sum() if total else 0.0,
        ]
    return out


@dataclass(frozen=True)
class QualityModel:
    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, cuts_a, cuts_b, table in self.pairs:
            total += table[np.searchsorted(cuts_a, x[:, a], side="right"), np.searchsorted(cuts_b, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _step(g: np.ndarray, h: np.ndarray, depth: int = 2, l2: float = 1.0, least: float = 2.0) -> np.ndarray:
    """The values of a shallow tree over ordered bins with gradient and hessian sums."""
    out = np.full(len(g), -g.sum() / (h.sum() + l2))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2), -1)
        k = int(gain.argmax())
        if gain[k] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
            out[: k + 1], out[k + 1 :] = _step(g[: k + 1], h[: k + 1], depth - 1, l2, least), _step(g[k + 1 :], h[k + 1 :], depth - 1, l2, least)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """The best cut of each axis together: four quadrants and their values; and the gain."""
    gs, hs = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    gs[1:, 1:], hs[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda s: (s[1:-1, 1:-1], s[1:-1, -1:] - s[1:-1, 1:-1], s[-1:, 1:-1] - s[1:-1, 1:-1], s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + s[1:-1, 1:-1])
    parts = list(zip(quarter(gs), quarter(hs), strict=True))
    gain = sum(a**2 / (b + l2) for a, b in parts)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    for (a, b), where in zip(parts, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), strict=True):
        out[where] = -a[i, j] / (b[i, j] + l2)
    return out, float(gain[i, j])


def boost(x: np.ndarray, y: np.ndarray, cycles: int = 60, rate: float = 0.3, n_pairs: int = 6, pair_cycles: int = 30) -> QualityModel:
    """Cyclic boosting of shallow trees into lookup tables, then of pairs."""
    quantiles = lambda v, bins: np.unique(np.quantile(v, np.arange(1, bins) / bins))
    cuts = [quantiles(v, BINS) for v in x.T]
    bins = [np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)]
    mean = np.clip(y.mean(), 0.001, 0.999)
    bias = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), bias)
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(cycles):
        for b, table in zip(bins, tables, strict=True):
            g, h = slopes()
            step = rate * _step(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            total += step[b]
    coarse = [quantiles(v, PAIR_BINS) for v in x.T]
    cells = [np.searchsorted(c, v, side="right") for c, v in zip(coarse, x.T, strict=True)]

    def sums(a, b):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        g, h = slopes()
        return [np.bincount(cells[a] * shape[1] + cells[b], v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    able = [j for j in range(x.shape[1]) if len(coarse[j])]
    ranked = sorted(combinations(able, 2), key=lambda p: -_pair_step(*sums(*p))[1])[:n_pairs]
    grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in ranked]
    for _ in range(pair_cycles):
        for (a, b), grid in zip(ranked, grids, strict=True):
            step = rate * _pair_step(*sums(a, b))[0]
            grid += step
            total += step[cells[a], cells[b]]
    return QualityModel(bias, cuts, tables, [(a, b, coarse[a], coarse[b], t) for (a, b), t in zip(ranked, grids, strict=True)])


def _described(batches):
    for whole in batches:
        for batch in steps(whole):
            x = describe(strings(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["place", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, column: str = "quality", max_fit: int = 20_000) -> QualityModel:
    """A model from the labelled rows for which learn (of doc_id) holds."""
    rows = sample_of(docs, labels, column, learn, max_fit)
    found = map_batches(rows, _described, "place long, label int, x array<double>").toArrow()
    if not found.num_rows:
        return QualityModel(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    x, y = np.array(found.column("x").to_pylist()), found.column("label").to_numpy().astype(float)
    by = np.lexsort([*x.T, found.column("place").to_numpy()])
    return boost(x[by], y[by])


def _scorer(model: QualityModel):
    def at(text: int, keep: int):
        def run(batches):
            for whole in batches:
                for batch in steps(whole, text):
                    score = model.score(describe(strings(batch.column(text))))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(score, pa.float64())], [*batch.schema.names[:keep], "score"])

        return run

    return at


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all unless told) with the score (0 to 1) of each text; a column score is replaced."""
    return with_columns(docs, {"score": "double"}, _scorer(model), keep)
