"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves; a codebook for each half (k-means on SAMPLE vectors at most) makes a product grid.
Every vector is listed in its own cell. A vector visits cells in the order of the sum of its squared distances to the
borders of the two half-cells (a multi-sequence over the two sorted lists) up to a bound; for a pair at the threshold,
no cell beyond the bound `reach` x the largest distance of a pair can hold a partner. reach = 1 is exact; a smaller
one is chosen on the sample so that the cells visited hold at least `recall` of the sampled close pairs. Visited cells
are verified in double precision. Equal vectors are one point each; a cell with many points is met in blocks.

Each pair is examined from one side alone (the side of the larger cell, or once within a cell), so counts are exact
sums of what blocks find, and only a forest of each block's links is written, never all pairs.

Defined results: rows with null label, null, zero or non-finite vectors link with nothing, are kept, and form
components of their own; vectors of different length don't link; repeated ids count as rows of their own, and share a
component; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .graph import components

SAMPLE, CELL, BLOCK, ROUNDS = 4096, 512, 1024, 12


def codebook(x: np.ndarray, k: int, seed: int = 6) -> np.ndarray:
    """k-means by Lloyd's steps, from distinct sampled rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _squares(x, centres).argmin(1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = x[own == j].mean(0)
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def borders(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its squared distances to the half-spaces of the others (0 for its own)."""
    d = _squares(x, centres)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(_squares(centres, centres), 1e-30))[own]
    return own, (np.maximum(d - d[np.arange(len(x)), own][:, None], 0) / (2 * apart)) ** 2


def visits(x: np.ndarray, books: list[np.ndarray], bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row; row and cell of each visit (its own cell included) within the squared bound."""
    half = x.shape[1] // 2
    (own1, far1), (own2, far2) = borders(x[:, :half], books[0]), borders(x[:, half:], books[1])
    order1, order2 = far1.argsort(1, kind="stable"), far2.argsort(1, kind="stable")
    s1, s2 = np.take_along_axis(far1, order1, 1), np.take_along_axis(far2, order2, 1)
    rows, cells, k = [], [], len(books[1])
    # Along the first list; of the second list always a prefix lies within the bound.
    for i in range(s1.shape[1]):
        left = bound - s1[:, i]
        alive = np.nonzero(left >= 0)[0]
        if not len(alive):
            break
        at, j = np.nonzero(s2[alive] <= left[alive][:, None])
        at = alive[at]
        rows.append(at)
        cells.append(order1[at, i] * k + order2[at, j])
    return own1 * k + own2, np.concatenate(rows), np.concatenate(cells)


def reach_for(x: np.ndarray, books: list[np.ndarray], cosine: float, recall: float, seed: int = 6) -> float:
    """The least of some bounds at which made-up partners of sampled vectors, at the threshold itself, are found."""
    rng = np.random.default_rng(seed)
    most = 2 - 2 * cosine
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    partner = x * cosine + side * np.sqrt(1 - cosine**2)
    homes, back = visits(x, books, 0.0)[0], visits(partner, books, 0.0)[0]
    for share in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7):
        bound = most * share**2
        found = homes == back
        for y, home, there in ((x, homes, back), (partner, back, homes)):
            _, rows, cells = visits(y, books, bound)
            ok = (cells == there[rows]) & (home[rows] > cells)
            found[rows[ok]] = True
        if found.mean() >= recall:
            return bound
    return most


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        ri, rj = root(i), root(j)
        if ri != rj:
            up[ri] = rj
            out.append((i, j))
    return out


def near_duplicates(df: DataFrame, cosine: float = 0.98, recall: float = 0.995, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """df: vec_id, embedding, label. Returns vec_id, n_links, component_id, kept."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", F.when(fine, norm).alias("norm"))
    usable = F.col("norm").isNotNull() & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    rows = stored(rows.withColumn("key", F.when(usable, F.unhex(F.sha2(F.concat_ws("|", "label", F.col("embedding").cast("string")), 256)))), "vectors")
    # Equal vectors are one point.
    points = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.first("norm").alias("norm"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    points = stored(points.withColumn("point", F.monotonically_increasing_id()).withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda e: e / F.col("norm"))), "points")
    total = points.count()
    lone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return lone
    drawn = points.orderBy(F.xxhash64("key"), "key").limit(sample).select("embedding", F.size("embedding").alias("d"))
    drawn = drawn.toArrow().to_pydict()
    size = max(set(drawn["d"]), key=drawn["d"].count)
    known = np.array([e for e in drawn["embedding"] if len(e) == size])
    k = max(1, round((total / cell) ** 0.5))
    books = [codebook(known[:, : size // 2], min(k, len(known))), codebook(known[:, size // 2 :], min(k, len(known)))] if size > 1 else [np.zeros((1, 0)), np.zeros((1, 1))]
    bound = reach_for(known, books, cosine, recall) if size > 1 else 4.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In slices: each row has a distance to each centre.
        for batch in (piece for whole in batches for piece in slices(whole, 1 << 19)):
            lists = batch.column("embedding").to_pylist()
            same = np.array([len(e) == size for e in lists], bool)
            # Vectors of other lengths share one cell for each length.
            home = np.array([-len(e) for e in lists], np.int64)
            at, cells = np.nonzero(~same)[0], home[~same]
            index = np.nonzero(same)[0]
            if len(index):
                own, r, c = visits(np.array([lists[i] for i in index]), books, bound)
                home[index] = own
                use = c <= own[r]
                at, cells = np.concatenate([at, index[r[use]]]), np.concatenate([cells, c[use]])
            yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(at)), batch.column("point").take(pa.array(at)), pa.array(cells), pa.array(home[at] == cells)], ["label", "point", "cell", "home"])

    listed = stored(points.select("label", "point", "embedding").mapInArrow(place, "label string, point long, cell long, home boolean"), "cells")
    # Members of a cell in blocks; each block of members meets each block of members and visitors.
    counts = listed.groupBy("label", "cell").agg(F.sum(F.col("home").cast("long")).alias("members"), F.count(F.lit(1)).alias("rows")).where("members > 0 AND rows > 1")
    blocks = counts.select("label", "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("m"), F.ceil(F.col("rows") / BLOCK).cast("int").alias("r"))
    dealt = listed.join(blocks, ["label", "cell"])
    as_member = dealt.where("home").select("label", "cell", "point", F.lit(0).alias("role"), F.expr("cast(pmod(xxhash64(point), m) as int)").alias("mb"), F.explode(F.expr("sequence(0, r - 1)")).alias("rb"))
    as_asker = dealt.select("label", "cell", "point", F.when(F.col("home"), 1).otherwise(2).alias("role"), F.explode(F.expr("sequence(0, m - 1)")).alias("mb"), F.expr("cast(pmod(xxhash64(point, 7), r) as int)").alias("rb"))
    meeting = as_member.unionByName(as_asker).join(points.select("point", "embedding", "n"), "point")

    def meet(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        point, n = table.column("point").to_numpy(), table.column("n").to_numpy()
        lists = table.column("embedding").to_pylist()
        out = {"p": [], "links": [], "a": [], "b": []}
        x, y = np.nonzero(role == 0)[0], np.nonzero(role > 0)[0]
        if len(x) and len(y):
            left, right = np.array([lists[i] for i in x]), np.array([lists[i] for i in y])
            close = left @ right.T >= cosine
            # Within a cell a pair is met twice, and counts from its smaller point.
            close &= (role[y] == 2)[None, :] | (point[x][:, None] < point[y][None, :])
            i, j = np.nonzero(close)
            got = {}
            for p, weight in ((point[x[i]], n[y[j]]), (point[y[j]], n[x[i]])):
                ids, inverse = np.unique(p, return_inverse=True)
                for q, s in zip(ids.tolist(), np.bincount(inverse, weight, len(ids)).astype(np.int64).tolist()):
                    got[q] = got.get(q, 0) + s
            out["p"], out["links"] = list(got), list(got.values())
            ids, inverse = np.unique(np.concatenate([point[x[i]], point[y[j]]]), return_inverse=True)
            tree = _forest(len(ids), inverse[: len(i)], inverse[len(i) :])
            out["p"] += [None] * len(tree)
            out["links"] += [None] * len(tree)
            out["a"] = [None] * len(got) + [int(ids[s]) for s, _ in tree]
            out["b"] = [None] * len(got) + [int(ids[t]) for _, t in tree]
        return pa.table({c: pa.array(out[c], pa.int64()) for c in ("p", "links", "a", "b")})

    found = stored(meeting.groupBy("label", "cell", "mb", "rb").applyInArrow(meet, "p long, links long, a long, b long"), "found")
    sums = found.where("p IS NOT NULL").groupBy("p").agg(F.sum("links").alias("links"))
    joined = components(found.where("a IS NOT NULL").select("a", "b"))
    each = points.select("key", "point", "n", "least").join(sums, points["point"] == sums["p"], "left").join(joined, points["point"] == joined["node"], "left")
    each = each.select("key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "point").alias("component"))
    lowest = each.groupBy("component").agg(F.min("least").alias("component_id"))
    result = each.join(lowest, "component").select("key", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"))
    linked = rows.where("key IS NOT NULL").join(result, "key").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(lone)
