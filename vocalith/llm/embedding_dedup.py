"""Near-duplicate vectors through an inverted multi-index over the vectors' halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm.common import components, cut, table
from vocalith.llm.vectors import FITTED, MOST_CENTROIDS, PER_CENTROID, cosines, dealt, is_valid, k_means, lists_of, matrix, packed, sample, unit, valid

#: Vectors a cell on average: a codebook has as many centroids as the square root of the cells.
PER_CELL = 400
#: Share of neighbours at exactly the least similarity of which one is to reach the other's cell.
RECALL = 0.9995
LEAST = 0.95


class MultiIndex:
    """Two codebooks, one for each half of unit vectors; a pair of centroids is a cell. A vector visits cells in the order
    of its halves' summed squared distances, until ``slack`` beyond its own cell's sum. The slack is calibrated: so far
    that for RECALL of random neighbours at similarity ``least`` of the fitted vectors, one of the two visits the other's own cell."""

    def __init__(self, fitted: np.ndarray, k: int, least: float = LEAST, recall: float = RECALL):
        x = unit(fitted)
        self.half, self.k = x.shape[1] // 2, max(1, min(k, len(x)))
        self.books = [k_means(h, self.k) for h in self.halves(x)]
        rng = np.random.default_rng(3)
        a = x[rng.choice(len(x), 20_000)]
        off = rng.standard_normal(a.shape)
        off -= (off * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(off, axis=1, keepdims=True)
        off = np.divide(off, size, out=np.zeros_like(off), where=size > 0)
        b = least * a + np.sqrt(1 - least * least) * off
        gaps = []
        for one, other in ((a, b), (b, a)):
            at = [p.argmin(1) for p in self.parts(other)]
            gaps.append(sum(p[np.arange(len(a)), i] - p.min(1) for p, i in zip(self.parts(one), at)))
        self.slack = float(np.quantile(np.minimum(*gaps), recall)) + 1e-9

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of both halves to their centroids."""
        return [np.maximum((h * h).sum(1)[:, None] + (c * c).sum(1) - 2 * h @ c.T, 0) for h, c in zip(self.halves(x), self.books)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's own cell, and (row, cell) of what it visits, by rows and in the order of the visits.

        The multi-sequence walk: both lists of centroids are sorted by distance, and a cell's place is its pair of ranks. A row's frontier
        has for each rank of the first list the next one of the second; a rank enters once the one before it was taken. All
        rows take their nearest frontier cell in one step, and a row ends at the first one beyond its bound.
        """
        n, k = len(x), self.k
        parts = self.parts(x)
        order = [p.argsort(1, kind="stable") for p in parts]
        one, two = (np.take_along_axis(p, o, 1) for p, o in zip(parts, order))
        bound = one[:, 0] + two[:, 0] + self.slack
        taken = np.zeros((n, k), np.int32)  # of the second list, for each rank of the first
        front = np.full((n, k), np.inf)
        front[:, 0] = one[:, 0] + two[:, 0]
        rows, width, got = np.arange(n), 1, []
        while len(rows):
            i = front[rows, :width].argmin(1)
            on = front[rows, i] <= bound[rows]
            rows, i = rows[on], i[on]
            j = taken[rows, i]
            got.append((rows, order[0][rows, i] * k + order[1][rows, j]))
            taken[rows, i] = j + 1
            front[rows, i] = np.where(j + 1 < k, one[rows, i] + two[rows, np.minimum(j + 1, k - 1)], np.inf)
            new = (j == 0) & (i + 1 < k)
            front[rows[new], i[new] + 1] = one[rows[new], i[new] + 1] + two[rows[new], 0]
            width = min(k, max(width, int(i.max(initial=0)) + 2))
        r, c = (np.concatenate(y) for y in zip(*got))
        by_row = np.argsort(r, kind="stable")
        return order[0][:, 0] * k + order[1][:, 0], r[by_row], c[by_row]


def _roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each position reaches over the links (i, j)."""
    low = ids.copy()
    while True:
        old = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (old == low).all():
            return low


def link(vectors: DataFrame, least: float = LEAST, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Every row's links and component: (vec_id, n_links, component_id, kept). Labels play no part.

    Equal vectors are taken together first, so copies cost one row. Each different vector stands in its own cell and
    visits others; a cell's block compares its visitors with its own vectors in double precision, and counts a pair for
    both if only one of the two visits the other's cell, so links are symmetric and counted once. Blocks give counts and
    a spanning set of links, never pairs. Vectors that can't be compared (null, zero, with null or non-finite components, or of another
    length than most) link with nothing; null ids are kept as rows of their own component (null). Rows that repeat an id are further
    vectors. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    rows, dims = valid(vectors, key, vec)
    same = cut(packed(rows).select("vec_id", "vec", *[F.xxhash64(F.lit(s), "vec").alias(f"h{s}") for s in (1, 2)]), "near-same")
    base = same.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    base = cut(base.withColumn("rep", F.monotonically_increasing_id()), "near-vectors")  # numbers vectors, as ids may be shared
    k = max(1, min(MOST_CENTROIDS, round((base.count() / PER_CELL) ** 0.5)))
    fitted = sample(base.select(F.col("id").alias("vec_id"), "vec"), max(FITTED, PER_CENTROID * k), dims)
    index = spark.sparkContext.broadcast(MultiIndex(fitted, k, least) if len(fitted) else None)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(64, min(1024, 2_000_000 // index.value.k))
            for a in range(0, len(b), step):
                part = b.slice(a, step)
                own, r, c = index.value.cells(unit(matrix(part.column(2), dims)))
                visits = lists_of(r, c, len(part))
                ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(part)))])
                known = [np.sort(c[x:z]).astype(np.int32).tobytes() for x, z in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32()), visits, pa.array(known, pa.binary())], ["rep", "n", "vec", "own", "visits", "known"])

    placed = cut(base.select("rep", "n", "vec").mapInArrow(place, "rep bigint, n bigint, vec binary, own int, visits array<int>, known binary"), "near-cells")
    stored, asking = dealt(placed.select("rep", "n", "vec", "known", F.array("own").alias("cells")), placed.select(*(F.col(c).alias(d) for c, d in (("rep", "ask"), ("n", "m"), ("vec", "q_vec"), ("own", "home"), ("visits", "cells")))), "cells", "rep", "ask")

    def meet(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        counts: list[tuple] = []
        links: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, n, v = left.column("rep").to_numpy(), left.column("n").to_numpy(), matrix(left.column("vec"), dims)
            asks, m, q, home = right.column("ask").to_numpy(), right.column("m").to_numpy(), matrix(right.column("q_vec"), dims), right.column("home").to_numpy()
            known = left.column("known").to_pylist()
            uv, got_i, got_j = unit(v), [], []
            for a in range(0, len(q), 512):
                s = unit(q[a : a + 512]) @ uv.T
                i, j = np.nonzero(s >= least - 1e-9)
                close = np.abs(s[i, j] - least) < 1e-9
                ok = asks[a + i] != ids[j]
                ok[close] &= cosines(q[a + i[close]], v[j[close]]) >= least
                got_i.append(a + i[ok])
                got_j.append(j[ok])
            i, j = np.concatenate(got_i), np.concatenate(got_j)
            if len(i):
                counts.append((asks, np.bincount(i, n[j], len(asks))))
                homes, which = np.unique(home, return_inverse=True)
                back_too = np.zeros((len(ids), len(homes)), bool)  # whether a stored vector visits an asking one's cell
                for row in np.unique(j):
                    back_too[row] = np.isin(homes, np.frombuffer(known[row], np.int32))
                one_way = ~back_too[j, which[i]]
                counts.append((ids, np.bincount(j[one_way], m[i[one_way]], len(ids))))
                every, back = np.unique(np.concatenate([asks, ids]), return_inverse=True)
                low = _roots(back[i], back[len(asks) + j], every)
                links.append((every[low != every], low[low != every]))
        a = np.concatenate([*(c[0][c[1] > 0] for c in counts), *(x[0] for x in links), np.array([], np.int64)]).astype(np.int64)
        k = np.concatenate([*(c[1][c[1] > 0] for c in counts), *(np.zeros(len(x[0])) for x in links), np.array([])]).astype(np.int64)
        b = np.concatenate([*(np.full((c[1] > 0).sum(), -1) for c in counts), *(x[1] for x in links), np.array([], np.int64)]).astype(np.int64)
        return pa.table({"a": a, "b": pa.array(b, mask=k > 0), "n": k})

    by = ["list", "v", "q"]
    found = cut(stored.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(meet, "a bigint, b bigint, n bigint"), "near-found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("_rep")).agg(F.sum("n").alias("others"))
    roots = components(found.where("n = 0").select("a", "b"), "near-cc").withColumnRenamed("node", "_node")
    least_id = roots.join(base.select("rep", "id"), F.col("_node") == F.col("rep")).groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("least_id"))
    roots = roots.join(least_id, F.col("root") == F.col("_root")).select("_node", "least_id")
    reps = base.select("h1", "h2", "rep", "id", "n").join(counts, F.col("rep") == F.col("_rep"), "left").join(roots, F.col("rep") == F.col("_node"), "left")
    reps = reps.select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least_id", "id").alias("component_id"))
    linked = same.select("vec_id", "h1", "h2").join(reps, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    every = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("vec"))
    lone = every.where(F.col("vec_id").isNull() | ~is_valid("vec", dims)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
