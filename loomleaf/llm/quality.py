"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is put into bins. Cyclic boosting goes round the features again and again; each step fits a
shallow tree on one feature's bins and adds it to that feature's table. Then the pairs that best explain what is left
get tables of two features' bins in the same way. A score is the logistic function of a sum of table entries.

The model is fitted on SAMPLE labelled documents at most, chosen by a hash of their id; everything else covers all rows.
Defined results: a null text counts as empty; without labels, or with labels of one kind only, the score is constant
(0.5, or the smoothed share); repeated rows stay; columns named held_out, score or predicted are replaced.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, whole_text

SAMPLE, ROUNDS, RATE, BINS, PAIRS, COARSE = 20_000, 150, 0.1, 32, 8, 8
FEATURES = ("bytes", "words", "word_bytes", "distinct", "top_word", "letters", "upper", "digits", "spaces", "marks", "symbols", "beyond_ascii", "bars", "lines", "line_words", "repeated_lines", "short_lines", "marked_words", "long_words")


def _kinds() -> np.ndarray:
    """For each byte the feature that counts it."""
    kind = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        kind[b] = 7 if b > 127 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:!?'\"()-" else 8 if c == "|" else 6
    return kind


KIND = _kinds()


def features(text: str) -> list[float]:
    data = text.encode()
    n = max(1, len(data))
    of = np.bincount(KIND, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 9) / n
    words = data.split()
    count = max(1, len(words))
    seen = Counter(words)
    lines = data.split(b"\n")
    again = Counter(lines)
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / count, len(seen) / count, max(seen.values(), default=0) / count,
        of[1] + of[2], of[2], of[3], of[4], of[5], of[6], of[7], of[8],
        np.log1p(len(lines)), len(words) / len(lines), 1 - len(again) / len(lines), sum(len(x) < 20 for x in lines) / len(lines),
        sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:!?") for w in words) / count, sum(len(w) > 20 for w in words) / count,
    ]


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float = 5.0) -> np.ndarray:
    """A tree over the bins of one feature: the value of each bin's leaf, from sums of gradients and hessians."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    value = cg[-1] / (ch[-1] + 1)
    if depth and len(g) > 1:
        left = cg[:-1] ** 2 / (ch[:-1] + 1)
        right = (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
        gain = np.where((ch[:-1] >= least / 4) & (ch[-1] - ch[:-1] >= least / 4), left + right, -1.0)
        at = int(np.argmax(gain))
        if gain[at] > cg[-1] * value + 1e-9:
            return np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1, least), _tree(g[at + 1 :], h[at + 1 :], depth - 1, least)])
    return np.full(len(g), value)


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two features' bins: one cut of the first, then a cut of the second on each side."""
    best, gain = np.full(g.shape, g.sum() / (h.sum() + 1)), -1.0
    for cut in range(1, g.shape[0]):
        parts = [_tree(x.sum(0), y.sum(0), 1) for x, y in ((g[:cut], h[:cut]), (g[cut:], h[cut:]))]
        fit = np.concatenate([np.tile(parts[0], (cut, 1)), np.tile(parts[1], (g.shape[0] - cut, 1))])
        won = float((2 * fit * g - fit**2 * (h + 1e-9)).sum())
        if won > gain:
            best, gain = fit, won
    return best, gain


class Additive:
    """Tables of single features and of pairs, added up."""

    def __init__(self, edges, coarse, base, tables, pairs):
        self.edges, self.coarse, self.base, self.tables, self.pairs = edges, coarse, base, tables, pairs

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Additive:
        if not len(y):
            return cls([], [], 0.0, [], [])
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        coarse = [np.unique(np.quantile(c, np.linspace(0, 1, COARSE + 1)[1:-1])) for c in x.T]
        share = (y.sum() + 1) / (len(y) + 2)
        model = cls(edges, coarse, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], [])
        if len(np.unique(y)) < 2:
            return model
        bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
        raw = np.full(len(y), model.base)

        def sums(at, size):
            p = 1 / (1 + np.exp(-raw))
            return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

        for _ in range(rounds):
            for b, table in zip(bins, model.tables):
                step = RATE * _tree(*sums(b, len(table)), 2)
                table += step
                raw += step[b]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T)]
        found = []
        for i, j in combinations(range(x.shape[1]), 2):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            g, h = sums(rough[i] * shape[1] + rough[j], shape[0] * shape[1])
            found.append((-_grid_tree(g.reshape(shape), h.reshape(shape))[1], i, j, shape))
        chosen = [(i, j, np.zeros(s)) for _, i, j, s in sorted(found)[:PAIRS]]
        for _ in range(rounds // 3):
            for i, j, table in chosen:
                at = rough[i] * table.shape[1] + rough[j]
                g, h = sums(at, table.size)
                step = RATE * _grid_tree(g.reshape(table.shape), h.reshape(table.shape))[0]
                table += step
                raw += step.ravel()[at]
        model.pairs = chosen
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for c, e, table in zip(x.T, self.edges, self.tables):
            raw += table[np.searchsorted(e, c, "right")]
        for i, j, table in self.pairs:
            raw += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-raw))


def held_out(folds: int, fold: int, column: str = "doc_id"):
    """Whether a row's labels are kept from training; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds == fold


def sampled_labels(labels: DataFrame, label: str, folds: int, fold: int, sample: int = SAMPLE) -> DataFrame:
    """Of the labels outside the held-out fold at most `sample`, by a hash of the id: bounded, so that it may be broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(folds, fold)).groupBy("doc_id").agg(F.max(label).alias("_y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> Additive:
    chosen = F.broadcast(sampled_labels(labels, "quality", folds, fold, sample))
    rows = docs.select("doc_id", whole_text().alias("_t")).join(chosen, "doc_id").select(F.col("doc_id").cast("string").alias("id"), F.col("_y").cast("int").alias("y"), "_t")
    found = map_arrow(rows, _measure, "id string, y int, x array<double>").groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.x", "r.y").toArrow().sort_by("id")
    y = found.column("y").to_numpy().astype(float)
    x = np.array(found.column("x").to_pylist(), float)
    return Additive.fit(x, y)


def score(df: DataFrame, model: Additive, folds: int = 3, fold: int = 1) -> DataFrame:
    """df with held_out, score and predicted."""
    made = ("held_out", "score", "predicted")
    rest = [c for c in df.columns if c not in made]
    held = df.select(*[F.col(f"`{c}`") for c in rest], held_out(folds, fold).alias("held_out"), whole_text().alias(fresh(df.columns, "_t")[0]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(np.array([features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rest, *made])

    return map_arrow(held, run, f"{kinds}, score double, predicted int")
