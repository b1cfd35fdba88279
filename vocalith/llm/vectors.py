"""What the operators on vectors share: valid vectors, exact cosines, k-means, blocks of posting lists.

Vectors travel as bytes (floats as they are, else doubles): a row is then a few fields for every shuffle and Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import small_enough

#: Rows of a list that meet in one task at most, on average: longer lists are dealt into blocks of this size.
BLOCK = 2048
#: Tables of lists up to this many rows are broadcast, larger ones joined by shuffle.
BROADCAST_LISTS = 200_000
#: Vectors that a codebook or index is fitted on: at least so many, and so many a centroid.
FITTED, PER_CENTROID = 16_384, 16
#: Centroids of an index or codebook at most, which bounds the sample that is fitted on the driver (262,144 vectors); with more rows lists grow longer and are dealt into more blocks.
MOST_CENTROIDS = 16_384


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the row of ``b`` beside it; equal pairs give equal figures wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def is_valid(vec: str, dims: int | None = None) -> Column:
    """Whether a vector can be compared: not null nor zero, without null or non-finite components, and of ``dims`` if given."""
    v = F.col(vec)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good if dims is None else good & (F.size(v) == dims), F.lit(False))


def valid(df: DataFrame, key: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vec) of the rows whose vectors can be compared, and their dimension (the commonest length, the longer at a tie).

    Out go null ids, null and zero vectors, null or non-finite components and vectors of another length, which has no cosine with the rest.
    """
    floats = df.schema[vec].dataType.simpleString() == "array<float>"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<float>" if floats else "array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & is_valid("vec"))
    first = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = first["d"] if first else 1
    return rows.where(F.size("vec") == dims), dims


def packed(rows: DataFrame) -> DataFrame:
    """(vec_id, vec) of ``valid`` with vectors as bytes; a negative zero becomes zero, so equal vectors have equal bytes."""
    kind = np.float32 if rows.schema["vec"].dataType.simpleString() == "array<float>" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column(1).flatten(), kind).reshape(len(b), -1) + kind(0) if len(b) else np.zeros((0, 1), kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id bigint, vec binary")


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of packed vectors as rows of doubles."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float32 if len(data) == 4 * dims * len(column) else np.float64).reshape(-1, dims).astype(np.float64)


def sample(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    """The ``n`` vectors of least hash, as rows: what an index is fitted on."""
    got = rows.select(F.xxhash64("vec_id").alias("h"), "vec_id", "vec").orderBy("h", "vec_id", "vec").limit(n).toArrow()
    return matrix(got.column("vec"), dims)


def _nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which of ``c`` is nearest to each row, for as many rows at a time as a bounded table of distances takes."""
    step = max(1, 8_000_000 // len(c))
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[a : a + step] @ c.T).argmin(1) for a in range(0, len(x), step)])


def k_means(x: np.ndarray, k: int, rounds: int = 10, balance: float = 2.0) -> np.ndarray:
    """Centroids of ``x``. Clusters above ``balance`` times the mean size are split, at the expense of the smallest."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for r in range(rounds):
        near = _nearest_centroid(x, c)
        sizes = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(sizes)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=0)
        c[some] = sums / sizes[some, None]
        if r < rounds - 2:
            big = np.argsort(-sizes)[: max(1, k // 16)]
            for a, b in zip(big[sizes[big] > balance * len(x) / k], np.argsort(sizes)):
                c[b] = x[rng.choice(np.flatnonzero(near == a))]
    return c


def dealt(stored: DataFrame, asking: DataFrame, lists: str, stored_id: str, asking_id: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns (list, v, q), such that a stored row and an asking row of one list meet in exactly one of its blocks.

    ``lists`` is an array column of list numbers. A list with more than ``block`` rows of a side is dealt by the ids' hash
    into as many blocks, and the other side goes to each of them. Counts are a row for each list; they are broadcast if few.
    """
    s, a = (df.withColumn("list", F.explode(lists)).drop(lists) for df in (stored, asking))
    count = lambda df, name: df.select(F.explode(lists).alias("list")).groupBy("list").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).cast("int").alias(name))
    parts = count(stored, "nv").join(count(asking, "nq"), "list")
    parts = F.broadcast(parts) if small_enough(parts, BROADCAST_LISTS) else parts
    share = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    s = s.join(parts, "list").withColumn("v", share(stored_id, "nv")).withColumn("q", each("nq")).drop("nv", "nq")
    a = a.join(parts, "list").withColumn("q", share(asking_id, "nq")).withColumn("v", each("nv")).drop("nv", "nq")
    return s, a


def lists_of(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """``values``, ordered by their ``rows`` out of ``n``, as a list for each row."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32), values.astype(np.int32))
