"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector (by a hash of the lower-cased word) beside the mean vector of its character trigrams.
Two gated recurrent passes run over windows of WIDTH words, STEP apart, so that each word is seen by all the windows
that overlap there; attention weighs the states of a window, and a logistic unit scores it. A text's score is that of
its highest window. Training takes labels of whole texts: in each round the network picks the highest window of each
text (and others at random), and learns from these.

The network is fitted on SAMPLE labelled documents at most, chosen by a hash of their id, with all their windows.
Where the halves of the sample part best is set on a part of it that the network
hasn't learned from. Scores read whole texts of any length. Defined results: a null or empty text is one window of padding; without labels,
or with labels of one kind, the score is constant; repeated rows stay; columns named held_out, score or predicted are
replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import fresh, map_arrow, whole_text
from .quality import held_out, sampled_labels

WIDTH, STEP, HIDDEN = 16, 8, 8
WORDS, GRAMS, WORD_SIZE, GRAM_SIZE = 1 << 14, 1 << 12, 10, 10
SAMPLE, ROUNDS, STEPS = 5_000, 16, 200
MEMORY = 150_000
#: A text flagged in vain counts as much as so many missed ones; the threshold is the mean of those that are best by each.
VAIN = (2, 5)
EDGES = ".,;:!?\"'()[]{}<>*&%$#|-"


def _hash(x: str, seed: int) -> int:
    return xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed)


@lru_cache(1 << 17)
def _gram(x: str) -> int:
    return _hash(x, 2) % GRAMS


def word_inputs(word: str) -> tuple[int, list[int]]:
    """The row of a word's own vector and the rows of its trigrams' vectors; 0 is padding."""
    bare = word.strip(EDGES) or word
    framed = f"^{bare}$"
    return 1 + _hash(bare, 1) % (WORDS - 1), [_gram(framed[i : i + 3]) for i in range(max(1, len(framed) - 2))]


def starts(n: int) -> np.ndarray:
    """Where windows begin: every STEP words, the last so that the text's end is covered."""
    return np.arange(0, max(1, n - WIDTH + STEP), STEP)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_SIZE + GRAM_SIZE, HIDDEN

        def draw(*shape, scale=0.3):
            return rng.standard_normal(shape).astype(np.float32) * np.float32(scale)

        self.p = {"word": draw(WORDS, WORD_SIZE, scale=0.1), "gram": draw(GRAMS, GRAM_SIZE), "v": draw(2 * h), "w": draw(2 * h), "b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": draw(d, 3 * h), f"h{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.constant: float | None = None

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """What words add to the gates of both directions: this is all of a word that windows need."""
        return np.concatenate([vectors @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in "fb"], 1)

    def vectors(self, words: list[tuple[int, list[int]]]) -> np.ndarray:
        n = np.array([len(g) for _, g in words])
        grams = np.add.reduceat(self.p["gram"][np.concatenate([g for _, g in words])], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
        return np.concatenate([self.p["word"][[w for w, _ in words]], grams], 1).astype(np.float32)

    def forward(self, rows: np.ndarray, table: np.ndarray, keep: bool = False):
        """rows: windows x WIDTH positions in table (projected words; row 0 is padding). Logits, and with keep what backward needs."""
        n, h = len(rows), HIDDEN
        states, trace = [], []
        for k, side in enumerate("fb"):
            u, s, out = self.p[f"h{side}"], np.zeros((n, h), np.float32), [None] * WIDTH
            for t in range(WIDTH) if side == "f" else range(WIDTH - 1, -1, -1):
                x = table[rows[:, t], 3 * h * k : 3 * h * (k + 1)]
                gates = _sigmoid(x[:, : 2 * h] + s @ u[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                a = s @ u[:, 2 * h :]
                c = np.tanh(x[:, 2 * h :] + r * a)
                new = s + z * (c - s)
                if keep:
                    trace.append((k, t, s, z, r, a, c))
                out[t] = s = new
            states.append(np.stack(out, 1))
        both = np.concatenate(states, 2)
        e = both @ self.p["v"]
        e = np.where(rows > 0, e, np.float32(-20))
        e = np.exp(e - e.max(1, keepdims=True))
        weight = e / e.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, both)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, both, weight, pooled, trace) if keep else logit

    def backward(self, rows, kept, error):
        """Gradients of the weights after the projection, and of each window's projected words."""
        _, both, weight, pooled, trace = kept
        h = HIDDEN
        g = {"w": pooled.T @ error, "b": error.sum(keepdims=True)}
        d_pool = error[:, None] * self.p["w"]
        d_weight = np.einsum("nh,nth->nt", d_pool, both)
        d_e = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_e = np.where(rows > 0, d_e, 0)
        g["v"] = np.einsum("nt,nth->h", d_e, both)
        d_both = weight[:, :, None] * d_pool[:, None, :] + d_e[:, :, None] * self.p["v"]
        d_x = np.zeros((*rows.shape, 6 * h), np.float32)
        g |= {f"h{s}": np.zeros_like(self.p[f"h{s}"]) for s in "fb"}
        back, last = None, None
        for k, t, s, z, r, a, c in reversed(trace):
            if k != last:
                back, last = np.zeros_like(s), k
            side = "fb"[k]
            u = self.p[f"h{side}"]
            d = d_both[:, t, h * k : h * (k + 1)] + back
            d_c = d * z * (1 - c * c)
            d_gate = np.concatenate([d * (c - s) * z * (1 - z), d_c * a * r * (1 - r)], 1)
            d_a = d_c * r
            d_x[:, t, 3 * h * k : 3 * h * (k + 1)] = np.concatenate([d_gate, d_c], 1)
            g[f"h{side}"] += s.T @ np.concatenate([d_gate, d_a], 1)
            back = d * (1 - z) + d_gate @ u[:, : 2 * h].T + d_a @ u[:, 2 * h :].T
        return g, d_x

    def fit(self, texts: list[list[str]], y: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Network:
        if not len(y) or len(np.unique(y)) < 2:
            self.constant = float((np.sum(y) + 1) / (len(y) + 2))
            return self
        rng = np.random.default_rng(seed)
        names = sorted({w for t in texts for w in t})
        place = {w: i + 1 for i, w in enumerate(names)}
        inputs = [(0, [0]), *map(word_inputs, names)]
        windows, owner = [], []
        for i, t in enumerate(texts):
            at = np.array([place[w] for w in t] + [0] * WIDTH, np.int64)
            for s in starts(len(t)):
                windows.append(at[s : s + WIDTH])
                owner.append(i)
        windows, owner = np.array(windows, np.int32), np.array(owner)
        # One in five sets the threshold: the windows of the others are learned from.
        aside = rng.random(len(y)) < 0.2
        aside &= len(np.unique(y[~aside])) == 2
        learned = np.nonzero(~aside[owner])[0]
        all_windows, all_owner, windows, owner = windows, owner, windows[learned], owner[learned]
        rounds = max(rounds, STEPS * 64 // max(1, int((~aside).sum())))
        moment = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in self.p.items()}
        share = y[~aside].mean()
        importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        step = 0
        for turn in range(rounds):
            table = self.project(self.vectors(inputs))
            logit = np.concatenate([self.forward(windows[i : i + 8192], table) for i in range(0, len(windows), 8192)])
            # The order by owner, then by logit (in the first rounds by chance): the last of each owner is its highest.
            order = np.lexsort((rng.random(len(logit)) if turn < 2 else logit, owner))
            last = np.r_[np.nonzero(np.diff(owner[order]))[0], len(order) - 1]
            top = order[last]
            some = rng.choice(len(windows), min(len(windows), len(top)), replace=False)
            some = some[y[owner[some]] == 0] if turn >= 2 else some
            chosen = rng.permutation(np.concatenate([top, some]))
            for i in range(0, len(chosen), 128):
                rows, who = windows[chosen[i : i + 128]], owner[chosen[i : i + 128]]
                used, inverse = np.unique(rows, return_inverse=True)
                used, local = (used, inverse.reshape(rows.shape)) if used[0] == 0 else (np.r_[0, used], inverse.reshape(rows.shape) + 1)
                words = [inputs[j] for j in used]
                x = self.vectors(words)
                kept = self.forward(local, self.project(x), True)
                error = ((_sigmoid(kept[0]) - y[who]) * importance[who] / len(who)).astype(np.float32)
                g, d_rows = self.backward(local, kept, error)
                d_table = np.zeros((len(used), d_rows.shape[2]), np.float32)
                np.add.at(d_table, local.ravel(), d_rows.reshape(-1, d_rows.shape[2]))
                d_in = np.zeros_like(x)
                for k, side in enumerate("fb"):
                    part = d_table[:, 3 * HIDDEN * k : 3 * HIDDEN * (k + 1)]
                    g[f"x{side}"], g[f"c{side}"] = x.T @ part, part.sum(0)
                    d_in += part @ self.p[f"x{side}"].T
                g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
                np.add.at(g["word"], [w for w, _ in words], d_in[:, :WORD_SIZE])
                n = np.array([len(q) for _, q in words])
                np.add.at(g["gram"], np.concatenate([q for _, q in words]), np.repeat(d_in[:, WORD_SIZE:] / n[:, None], n, axis=0))
                step += 1
                for name, grad in g.items():
                    m, s = moment[name]
                    m += 0.1 * (grad - m)
                    s += 0.002 * (grad * grad - s)
                    self.p[name] = (self.p[name] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.998**step)) + 1e-6)).astype(np.float32)
        # Whole texts are scored by their highest window: where the halves of the sample part best is 0.
        table = self.project(self.vectors(inputs))
        if aside.any() and len(np.unique(y[aside])) == 2:
            chosen = np.nonzero(aside[all_owner])[0]
            windows, owner = all_windows[chosen], all_owner[chosen]
        logit = np.concatenate([self.forward(windows[i : i + 8192], table) for i in range(0, len(windows), 8192)])
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, logit)
        best, y = best[np.isfinite(best)], y[np.isfinite(best)]
        order = np.argsort(best, kind="stable")
        edges, at = np.r_[best[order][0] - 2, best[order], best[order][-1] + 2], []
        for vain in VAIN:
            good = vain * np.r_[0, np.cumsum(y[order] == 0)] + (y == 1).sum() - np.r_[0, np.cumsum(y[order] == 1)]
            cut = np.nonzero(good == good.max())[0]
            cut = int(cut[len(cut) // 2])
            at.append((edges[cut] + edges[cut + 1]) / 2)
        self.p["b"] = self.p["b"] - np.float32(np.mean(at))
        return self


class Scorer:
    """Scores whole texts; remembers projected words."""

    def __init__(self, network: Network):
        self.network, self.known = network, {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.network.constant is not None:
            return np.full(len(texts), self.network.constant)
        split = [t.lower().split() for t in texts]
        if len(self.known) > MEMORY or not self.known:
            self.known, self.table = {"": 0}, self.network.project(self.network.vectors([(0, [0])]))
        new = list(dict.fromkeys(w for t in split for w in t if w not in self.known))
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.network.project(self.network.vectors([word_inputs(w) for w in new]))])
        begin, owner, flat, base = [], [], [], 0
        for i, t in enumerate(split):
            s = starts(len(t))
            begin.append(s + base)
            owner.append(np.full(len(s), i))
            flat.append(np.array([self.known[w] for w in t] + [0] * WIDTH, np.int64))
            base += len(t) + WIDTH
        flat, begin, owner = np.concatenate(flat), np.concatenate(begin), np.concatenate(owner)
        best = np.full(len(texts), -np.inf)
        for k in range(0, len(begin), 4096):
            logit = self.network.forward(flat[begin[k : k + 4096][:, None] + np.arange(WIDTH)], self.table)
            np.maximum.at(best, owner[k : k + 4096], logit)
        return _sigmoid(best.astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> Network:
    chosen = F.broadcast(sampled_labels(labels, "toxic", folds, fold, sample))
    rows = docs.select(F.col("doc_id"), whole_text().alias("t")).join(chosen, "doc_id").select(F.col("doc_id").cast("string").alias("id"), "t", "_y")
    found = rows.groupBy("id").agg(F.min(F.struct("t", "_y")).alias("r")).select("id", F.lower("r.t").alias("t"), "r._y").toArrow().sort_by("id")
    return Network().fit([t.split() for t in found.column("t").to_pylist()], found.column("_y").to_numpy().astype(np.float32))


def score(df: DataFrame, network: Network, folds: int = 5, fold: int = 0) -> DataFrame:
    """df with held_out, score and predicted."""
    made = ("held_out", "score", "predicted")
    rest = [c for c in df.columns if c not in made]
    held = df.select(*[F.col(f"`{c}`") for c in rest], held_out(folds, fold).alias("held_out"), whole_text().alias(fresh(df.columns, "_t")[0]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    scorer = Scorer(network)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scorer.score(batch.column(batch.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rest, *made])

    return map_arrow(held, run, f"{kinds}, score double, predicted int")
