"""Approximate nearest neighbours in balanced posting lists with replicated boundary vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.llm.common import cut, table
from vocalith.llm.vectors import FITTED, MOST_CENTROIDS, PER_CENTROID, cosines, dealt, k_means, lists_of, matrix, packed, sample, unit, valid

#: Lists as a multiple of the square root of the rows, so that finding lists and reading them grow alike.
LISTS = 1.4
#: Lists that hold a vector at most, how much farther than its nearest centroid theirs may be, and the share of
#: true neighbours in the fitted sample that the ratio for queries is calibrated to.
REPLICAS, BOUNDARY, RECALL = 4, 1.25, 0.97
#: Links of a centroid to others, centroids from which a search starts, and how many of the nearest a vector's search follows.
LINKS, ENTRIES, BEAM = 12, 8, 16
QUERY_EVERY, NEAREST = 50, 5


class Graph:
    """Centroids with links to their nearest ones both ways, searched outward from a few entries. Only centroids that a search comes to
    are compared with its vector; ``compared`` counts them."""

    def __init__(self, centroids: np.ndarray, links: int = LINKS):
        self.c = np.ascontiguousarray(centroids, dtype=np.float32)
        self.half = (self.c.astype(np.float64) ** 2).sum(1) / 2
        self.compared, k = 0, len(centroids)
        self.next: list[set[int]] = [set() for _ in range(k)]
        for i in range(k):
            far = self.half - self.c @ self.c[i]
            for j in np.argpartition(far, min(links, k - 1))[: links + 1].tolist():
                if j != i:
                    self.next[i].add(j)
                    self.next[j].add(i)
        self.entries = list(range(0, k, max(1, k // ENTRIES)))
        seen, todo = set(), list(self.entries)
        while len(seen) < k:
            while todo:
                i = todo.pop()
                if i not in seen:
                    seen.add(i)
                    todo += self.next[i] - seen
            if len(seen) < k:  # what no link leads to becomes an entry
                todo = [next(i for i in range(k) if i not in seen)]
                self.entries += todo
        self.links = np.concatenate([np.fromiter(sorted(n), np.int64, len(n)) for n in self.next])
        self.start = np.concatenate([[0], np.cumsum([len(n) for n in self.next])])

    def _distances(self, x: np.ndarray, own: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distances of pairs, each pair by itself."""
        self.compared += len(rows)
        out = np.empty(len(rows), np.float32)
        for a in range(0, len(rows), 65_536):
            r, c = rows[a : a + 65_536], nodes[a : a + 65_536]
            out[a : a + 65_536] = np.sqrt(np.maximum(own[r] + 2 * (self.half[c] - np.einsum("ij,ij->i", x[r], self.c[c])), 0))
        return out

    def _neighbours(self, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.start[nodes + 1] - self.start[nodes]
        at = np.repeat(self.start[nodes] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.repeat(rows, counts), self.links[at]

    def closest(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of each row of ``x``, nearest first: the ``beam`` nearest found. Each step looks at the links
        of the nearest centroid not yet looked from, until that is none of these."""
        n, k = len(x), len(self.c)
        x, own, beam = x.astype(np.float32), (x.astype(np.float64) ** 2).sum(1), min(beam, k)
        seen = np.zeros((n, k), bool)
        node, best, fresh = np.zeros((n, beam), np.int64), np.full((n, beam), np.inf, np.float32), np.zeros((n, beam), bool)
        rows, nodes = np.repeat(np.arange(n), len(self.entries)), np.tile(np.array(self.entries), n)
        while True:
            new = ~seen[rows, nodes]
            rows, nodes = rows[new], nodes[new]
            seen[rows, nodes] = True
            d = self._distances(x, own, rows, nodes)
            some, first, counts = np.unique(rows, return_index=True, return_counts=True)
            if len(some):
                wide = int(counts.max())
                at = (np.repeat(np.arange(len(some)), counts), np.arange(len(rows)) - np.repeat(first, counts))
                more_d, more_n = np.full((len(some), wide), np.inf, np.float32), np.zeros((len(some), wide), np.int64)
                more_d[at], more_n[at] = d, nodes
                all_d, all_n, all_f = np.hstack([best[some], more_d]), np.hstack([node[some], more_n]), np.hstack([fresh[some], np.ones(more_d.shape, bool)])
                keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
                best[some], node[some], fresh[some] = (np.take_along_axis(y, keep, 1) for y in (all_d, all_n, all_f))
            j = np.where(fresh, best, np.inf).argmin(1)
            rows = np.flatnonzero(fresh[np.arange(n), j] & np.isfinite(best[np.arange(n), j]))
            if not len(rows):
                break
            fresh[rows, j[rows]] = False
            rows, nodes = self._neighbours(rows, node[rows, j[rows]])
        order = np.lexsort((node, best))
        return np.take_along_axis(node, order, 1), np.take_along_axis(best, order, 1)

    def within(self, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance), ordered: each row's centroids found within ``ratio`` of its nearest one's distance, and its ``least``
        nearest at any rate. A step looks at the links of all centroids within these bounds, and it ends when none is left."""
        k, n = len(self.c), len(x)
        x, own, least = x.astype(np.float32), (x.astype(np.float64) ** 2).sum(1), min(least, k)
        d, done = np.full((n, k), np.inf, np.float32), np.zeros((n, k), bool)
        rows, nodes = np.repeat(np.arange(n), len(self.entries)), np.tile(np.array(self.entries), n)
        while True:
            d[rows, nodes] = self._distances(x, own, rows, nodes)
            bound = np.maximum(d.min(1) * ratio, np.partition(d, least - 1, axis=1)[:, least - 1])
            r, c = np.nonzero((d <= bound[:, None]) & (d < np.inf))
            new = ~done[r, c]
            if not new.any():
                return r, c, d[r, c]
            done[r[new], c[new]] = True
            rows, nodes = self._neighbours(r[new], c[new])
            rows, nodes = np.divmod(np.unique(rows * k + nodes), k)
            unseen = np.isinf(d[rows, nodes])
            rows, nodes = rows[unseen], nodes[unseen]


class Index:
    """Centroids, their graph, and the distance ratio up to which a query's lists are read."""

    def __init__(self, fitted: np.ndarray, k: int, nearest: int = NEAREST):
        x = unit(fitted)
        self.graph = Graph(k_means(x, max(1, min(k, len(x) // 8))))
        self.ratio = self.calibrate(x, nearest) if len(self.graph.c) > 1 else float("inf")

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists that hold each row: that of its nearest centroid found and those nearly as near, REPLICAS at most."""
        c, d = self.graph.closest(x)
        r, j = np.nonzero(d[:, :REPLICAS] <= d[:, :1] * BOUNDARY)
        return r, c[r, j]

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, c, _ = self.graph.within(x, self.ratio, 4)
        return r, c

    def calibrate(self, x: np.ndarray, nearest: int) -> float:
        """The least ratio whose lists hold RECALL of the nearest vectors of 256 of the fitted ones: for each neighbour, the ratio
        at which the first of its lists is reached, and of these the quantile."""
        q = x[:: max(1, len(x) // 256)][:256]
        near = np.argpartition(-(q @ x.T), min(nearest, len(x) - 1), axis=1)[:, : nearest + 1]
        d = np.full((len(q), len(self.graph.c)), np.inf)
        r, c, dist = self.graph.within(q, float("inf"), 1)
        d[r, c] = dist
        wanted, which = np.unique(near, return_inverse=True)
        at, lists = self.lists(x[wanted])
        held = np.zeros((len(wanted), d.shape[1]), bool)
        held[at, lists] = True
        reach = np.where(held[which.reshape(near.shape)], d[:, None, :], np.inf).min(2) / np.maximum(d.min(1), 1e-9)[:, None]
        return float(np.quantile(reach, RECALL, method="higher"))


def _with_lists(rows: DataFrame, index, dims: int, probes: bool, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(64, min(1024, 4_000_000 // len(index.value.graph.c)))
            for a in range(0, len(b), step):
                part = b.slice(a, step)
                x = unit(matrix(part.column(1), dims))
                found = index.value.probes(x) if probes else index.value.lists(x)
                yield pa.RecordBatch.from_arrays([*part.columns, lists_of(*found, len(part))], [*part.schema.names, name])

    return rows.mapInArrow(run, f"vec_id bigint, vec binary, {name} array<int>")


def nearest(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found of each row whose id is divisible by ``every``: (query_id, rank, vec_id, score).

    Every vector is indexed, in up to REPLICAS lists. A query reads all lists within the calibrated distance ratio, and
    its block of a list is compared exactly, in double precision; lists of any length are dealt into blocks. Ties go to
    the smaller id. Vectors that can't be compared (null, zero, with null or non-finite components, or of another length than most) neither ask
    nor answer; a row is no candidate for its own id. Rows that repeat an id and vector are one, and different vectors of an id answer
    once, with the best score. An empty table gives no rows, and a single vector's query none. Other columns are left out, whatever their names.
    """
    rows, dims = valid(vectors, key, vec)
    spark = vectors.sparkSession
    rows = cut(packed(rows).dropDuplicates(["vec_id", "vec"]), "ann-vectors")
    lists = max(1, min(MOST_CENTROIDS, round(LISTS * rows.count() ** 0.5)))
    fitted = sample(rows, max(FITTED, PER_CENTROID * lists), dims)
    index = spark.sparkContext.broadcast(Index(fitted, lists, k) if len(fitted) else None)
    held = cut(_with_lists(rows, index, dims, False, "lists"), "ann-lists")
    asked = cut(_with_lists(rows.where(F.col("vec_id") % every == 0), index, dims, True, "lists"), "ann-probes")
    stored, asking = dealt(held, asked.withColumnRenamed("vec_id", "query_id"), "lists", "vec_id", "query_id")

    def meet(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in ("query_id", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            ids, v = left.column("vec_id").to_numpy(), matrix(left.column("vec"), dims)
            asks, q = right.column("query_id").to_numpy(), matrix(right.column("vec"), dims)
            by_id = np.argsort(ids, kind="stable")
            ids, uv, v = ids[by_id], unit(v[by_id]), v[by_id]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            m = min(k, len(first))
            for a in range(0, len(q), 256):
                s = unit(q[a : a + 256]) @ uv.T
                s[asks[a : a + 256, None] == ids] = -np.inf
                best = np.maximum.reduceat(s, first, axis=1)
                kth = -np.partition(-best, m - 1, axis=1)[:, m - 1]
                i, j = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -np.inf))
                exact = cosines(q[a + i], v[j])
                order = np.lexsort((-exact, ids[j], i))  # the best of each id
                i, j, exact = i[order], j[order], exact[order]
                fresh = np.ones(len(i), bool)
                fresh[1:] = (i[1:] != i[:-1]) | (ids[j[1:]] != ids[j[:-1]])
                i, j, exact = i[fresh], j[fresh], exact[fresh]
                order = np.lexsort((ids[j], -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                start = np.searchsorted(i, i, "left")
                keep = np.arange(len(i)) - start < k
                out["query_id"].append(asks[a + i[keep]])
                out["vec_id"].append(ids[j[keep]])
                out["score"].append(exact[keep])
        cat = lambda n, t: np.concatenate(out[n]).astype(t) if out[n] else np.array([], t)
        return pa.table({"query_id": cat("query_id", np.int64), "vec_id": cat("vec_id", np.int64), "score": cat("score", np.float64)})

    by = ["list", "v", "q"]
    found = stored.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_posting_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
