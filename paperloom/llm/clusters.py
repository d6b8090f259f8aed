"""Centroid clustering (Lloyd's rounds) with Drake's adaptive bounds.

Vectors are integers, floor(SCALE * x) of each component, so distances, sums and means are exact
and every engine and partitioning gives the same clusters.  Each vector keeps an upper bound of the
distance to its own centroid, the ``b`` next nearest centroids in ascending order of a lower bound
each, and one remainder bound for all others.  A round moves the bounds by how far the centroids
moved, then

1. where the upper bound is below the first lower bound, the vector stays;
2. else the upper bound is made exact; where it is below the j-th lower bound only the own centroid
   and the first j are measured again;
3. where it isn't below the remainder bound either, all centroids are.

A bound certifies only if it is strictly below, with a margin for rounding, so ties are always
measured exactly and go to the smaller number.  ``b`` adapts: as many bounds as the last round needed,
an eighth of the centroids at least (Drake and Hamerly, 2012).

Each round is one narrow pass over the vectors and their bounds, written to the shared folder, and
one aggregation that is combined before its shuffle: a cluster with a third of all vectors costs a
row per task.  Only centroids (a parameter's count of rows) reach the driver and are sent out.

Defined results: vectors that are null, have another number of components, or a null or non-finite
one are left out; of fewer vectors than centroids each is one; null ids hash like empty ones; equal
hashes are ordered by the vectors; repeated rows are vectors each; no vectors give no rows; columns
of the input named like an output are replaced.  Components are below 2**27 after scaling (distances
fit a long), larger ones end the job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import delete, fresh_dir

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = "2"
SCALE = 256
LARGEST = 1 << 27
#: The remainder bound where no centroid remains.
NO_OTHERS = 1e300
#: Vectors that are worked on at a time in a task.
SLICE = 8192
_STATE = "cluster int, upper double, near array<smallint>, lower array<double>, rest double, depth int, scanned long"


def integers(rows: DataFrame, column: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``rows`` whose vector is kept, with v, its integers."""
    x = F.col(column).cast("array<double>")
    whole = (F.size(x) == dimensions) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    held = lambda e: F.when(F.abs(e) < LARGEST / scale, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int"))
    return rows.where(F.coalesce(whole, F.lit(False))).withColumn("v", F.transform(x, held))


def first_centroids(vectors: DataFrame, id_column: str, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The k vectors with the least hashes of their ids."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to those of c (or to the row of c beside it)."""
    d = v - c
    return np.einsum("...i,...i->...", d, d)


def _low(d: np.ndarray) -> np.ndarray:
    """A lower bound of the square root, rounding included."""
    return np.sqrt(d.astype(np.float64)) * (1 - 1e-12)


def _high(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + 1e-12)


class Bounds:
    """Assignments and bounds of a slice of vectors (n, dimensions) to centroids (k, dimensions)."""

    def __init__(self, v: np.ndarray, centroids: np.ndarray, b: int):
        self.v, self.c, self.b = v, centroids, min(b, max(len(centroids) - 1, 0))
        n = len(v)
        self.cluster = np.zeros(n, dtype=np.int64)
        self.upper, self.rest = np.zeros(n), np.zeros(n)
        self.near, self.lower = np.zeros((n, self.b), dtype=np.int64), np.zeros((n, self.b))
        self.depth = np.zeros(n, dtype=np.int64)
        self.scanned = np.zeros(n, dtype=np.int64)

    def scan(self, rows: np.ndarray) -> None:
        """Measures all centroids for ``rows``."""
        k, b = len(self.c), self.b
        if not len(rows):
            return
        d = np.stack([squared(self.v[rows], c) for c in self.c], axis=1)
        order = np.argsort(d, axis=1, kind="stable")  # ties: smaller numbers first
        sorted_d = np.take_along_axis(d, order, axis=1)
        self.cluster[rows], self.upper[rows] = order[:, 0], _high(sorted_d[:, 0])
        self.near[rows], self.lower[rows] = order[:, 1 : b + 1], _low(sorted_d[:, 1 : b + 1])
        self.rest[rows] = _low(sorted_d[:, b + 1]) if b + 1 < k else NO_OTHERS
        self.scanned[rows] += k

    def restore(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, moved: np.ndarray) -> None:
        """Bounds of the round before, after the centroids ``moved``; fewer of them if b fell."""
        keep = min(self.b, near.shape[1])
        self.cluster, self.upper = cluster.copy(), (upper + moved[cluster]) * (1 + 1e-12)
        low = np.concatenate([(lower - moved[near]), (rest - moved.max(initial=0.0))[:, None]], axis=1)
        low -= np.abs(low) * 1e-12 + 1e-9
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]  # ascending; a smaller bound is one as well
        self.near[:, :keep], self.lower[:, :keep] = near[:, :keep], low[:, :keep]
        if keep < self.b:  # slots without a centroid never certify more than the remainder does
            self.near[:, keep:], self.lower[:, keep:] = -1, low[:, keep : keep + 1]
        self.rest = low[:, keep]

    def update(self) -> None:
        """Makes the assignments exact for the present centroids."""
        bounds = np.concatenate([self.lower, self.rest[:, None]], axis=1)
        doubt = np.flatnonzero(self.upper >= bounds[:, 0])
        if len(doubt):
            self.upper[doubt] = _high(squared(self.v[doubt], self.c[self.cluster[doubt]]))
            self.scanned[doubt] += 1
            depth = (self.upper[doubt, None] >= bounds[doubt]).sum(axis=1)  # bounds that don't certify
            self.depth[doubt] = depth
            usable = (self.near[doubt] >= 0).sum(axis=1)
            self.scan(doubt[depth > usable])
            for j in range(1, self.b + 1):
                self._reorder(doubt[(depth == j) & (depth <= usable)], j)

    def _reorder(self, rows: np.ndarray, j: int) -> None:
        """Measures the own centroid and the first j others of ``rows``."""
        if not len(rows):
            return
        at = np.column_stack([self.cluster[rows], self.near[rows, :j]])
        d = squared(self.v[rows, None, :], self.c[at])
        order = np.lexsort((at, d), axis=1)
        at, d = np.take_along_axis(at, order, axis=1), np.take_along_axis(d, order, axis=1)
        self.cluster[rows], self.upper[rows] = at[:, 0], _high(d[:, 0])
        self.near[rows, :j], self.lower[rows, :j] = at[:, 1:], _low(d[:, 1:])
        self.scanned[rows] += j


def _matrix(column: pa.Array | pa.ChunkedArray, n: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(n, -1) if n else np.zeros((0, 0), dtype=kind)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(a.ravel(), kind))


def assign(rows: DataFrame, own: list[str], centroids: np.ndarray, moved: np.ndarray | None, b: int) -> DataFrame:
    """``own`` columns, v and the state of each vector; ``rows`` has the state of the round before if ``moved`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                s = batch.slice(at, SLICE)
                n = s.num_rows
                state = Bounds(_matrix(s.column("v"), n, np.int64), centroids, b)
                if moved is None:
                    state.scan(np.arange(n))
                else:
                    state.restore(
                        s.column("cluster").to_numpy().astype(np.int64), s.column("upper").to_numpy(), _matrix(s.column("near"), n, np.int64).reshape(n, -1),
                        _matrix(s.column("lower"), n, np.float64).reshape(n, -1), s.column("rest").to_numpy(), moved,
                    )
                    state.update()
                yield pa.RecordBatch.from_arrays(
                    [*(s.column(c) for c in own), s.column("v"), pa.array(state.cluster, pa.int32()), pa.array(state.upper), _lists(state.near, pa.int16()), _lists(state.lower, pa.float64()), pa.array(state.rest), pa.array(state.depth, pa.int32()), pa.array(state.scanned)],
                    [*own, "v", "cluster", "upper", "near", "lower", "rest", "depth", "scanned"],
                )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own, "v").schema] + [_STATE])
    return rows.mapInArrow(run, schema)


def _means(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(the centroids' vectors' exact floored means, the most bounds that a vector needed, distances measured)."""
    dimensions = centroids.shape[1]
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dimensions)]
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum("scanned").alias("scanned"), *sums).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dimensions)]
    return out, max((r.depth for r in rows), default=0), sum(r.scanned for r in rows)


def clustered(vectors: DataFrame, id_column: str, column: str, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, log: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """(rows of ``vectors`` that are kept, with v, cluster and distance, the final centroids).

    ``log`` is given a dict per round: b, the bounds kept, and the distances measured.
    """
    spark = vectors.sparkSession
    own = [c for c in vectors.columns if c not in ("v", "cluster", "distance", "upper", "near", "lower", "rest", "depth", "scanned")]
    chosen = vectors.select(*own, *([] if column in own else [column]))
    kept = integers(chosen, column, dimensions, scale).select(*own, "v")
    centroids = first_centroids(kept, id_column, k, seed)
    if not len(centroids):
        return kept.select(*own, "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    least = -(-len(centroids) // 8)
    table, path, moved, b = kept, None, None, max(len(centroids) // 4, 1)
    for r in range(rounds + 1):
        new = fresh_dir(spark, "clusters")
        state = assign(table, own, centroids, moved, b)
        state.write.option("compression", "zstd").parquet(new)
        if path is not None:
            delete(spark, path)
        table, path = spark.read.schema(state.schema).parquet(new), new
        if r < rounds:
            means, depth, scanned = _means(table, centroids)
            if log is not None:
                log.append({"b": b, "scanned": scanned})
            moved = _high(squared(means, centroids))
            centroids = means
            if r:
                b = max(depth, least)
    at = F.lit([[int(x) for x in c] for c in centroids])
    mine = F.element_at(at, F.col("cluster") + 1)
    distance = F.aggregate(F.zip_with("v", mine, lambda x, y: (x - y).cast("long") * (x - y).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table.select(*own, "v", "cluster", distance.alias("distance")), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out, centroids = clustered(rows, "vec_id", "embedding")
    by = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = {r.cluster: r.cluster_inertia for r in by.collect()}  # a row per centroid
    short = [(i, each.get(i, 0), sum(each.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(short, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    ctes = [
        f"""e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND list_count(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), c_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM e) ORDER BY h, v LIMIT {CENTROIDS}
)"""
    ]
    near = "SELECT r, first(c ORDER BY d, c) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, {0}) GROUP BY r"
    for i in range(ROUNDS):
        ctes.append(f"a_{i} AS MATERIALIZED ({near.format(f'c_{i}')})")
        ctes.append(
            f"""c_{i + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(n.m, k.m) AS m FROM c_{i} k LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS m FROM (
      SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(e.v) AS x, generate_subscripts(e.v, 1) AS i FROM e JOIN a_{i} a USING (r)) GROUP BY c, i) GROUP BY c) n USING (c))"""
        )
    ctes.append(f"f AS MATERIALIZED ({near.format(f'c_{ROUNDS}')})")
    return f"""WITH {", ".join(ctes)}
SELECT e.vec_id, f.c::INT AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM e JOIN f USING (r) JOIN c_{ROUNDS} c ON f.c = c.c
"""


ORACLE = _sql()
