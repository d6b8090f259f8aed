"""Toxicity by a factorization machine over hashed terms.

Terms (runs of letters, digits and bytes from 0x80, A-Z lower-cased) are hashed to ``BUCKETS``
buckets, and so are the first bytes of longer terms (stems with endings); a document's features
are the buckets present in its whole text.  The machine scores
w0 + sum of w_i + sum over pairs of <v_i, v_j>, so two terms that are harmless alone can add up
to more than their weights, which a linear model can't express.

Fitting takes labelled documents with all their buckets, those whose hashed ids are smallest, at most
``TRAIN_ROWS`` of them and ``TRAIN_BUCKETS`` buckets in all; it runs in numpy on the driver, in
mini-batches, with memory bounded by these numbers.
Buckets that none of them has weigh nothing.  Scoring reads every text in full, by Arrow batches,
without a shuffle.

Defined results: a null or empty text has no feature and the score of the bias alone; a label
that is null is no label, and of several labels of one id the largest holds; of several documents
with one labelled id that with the least list of buckets is learned from; without labels of both classes the score is the smoothed share of toxic labels; a null id belongs to the held-out
part; repeated rows score alike; columns of the input named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import checkpointed, join_small
from paperloom.llm.words import LOWER, NOT_TERM, raw, slices, split, strings

BUCKETS = 1 << 18
TRAIN_ROWS = 20_000
TRAIN_BUCKETS = 8_000_000
FACTORS = 8
#: Passes over the sample, and steps at least.
EPOCHS = 5
STEPS = 300
BATCH = 256
SURE = 6.0
#: Lengths in bytes of the prefixes that longer terms are hashed by as well (stems with endings).
PREFIXES = (4, 5)
FOLDS = 5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text, each once and ascending: (owner, bucket)."""
    w = split(column, NOT_TERM)
    number, found = w.distinct(LOWER[w.data])
    terms, hashed = found.to_pylist(), xxhash.xxh3_64_intdigest
    once = np.unique(w.owner * max(len(terms), 1) + number)  # each term of a text once
    owner, number = np.divmod(once, max(len(terms), 1))
    length = np.fromiter(map(len, terms), np.int64, len(terms))
    both = []
    for k in (None, *PREFIXES):
        bucket = np.fromiter((hashed(t[:k], k or 0) for t in terms), np.uint64, len(terms)) & np.uint64(BUCKETS - 1)
        has = np.ones(len(number), dtype=bool) if k is None else length[number] > k
        both.append(owner[has] * BUCKETS + bucket.astype(np.int64)[number[has]])
    return np.divmod(np.unique(np.concatenate(both)), BUCKETS)


@dataclass
class Machine:
    """Bias, linear weights and factors by bucket, the bucket's value in a document multiplied in."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from (owner, bucket) pairs."""
        z = np.full(n, self.bias) + np.bincount(owner, self.linear[bucket], minlength=n)
        v = self.factors[bucket].astype(np.float64)
        for f in v.T:
            s = np.bincount(owner, f, minlength=n)
            z += 0.5 * (s * s - np.bincount(owner, f * f, minlength=n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score_texts(self, column: pa.Array) -> np.ndarray:
        owner, bucket = features(column)
        return self.score(owner, bucket, len(column))


def values(bucket: np.ndarray, size: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each bucket's value where it is present, in [0, 1): the surer it tells the classes apart, the nearer to 1.

    z is the bucket's distance between the classes in standard errors; the value is z^2 / (z^2 + SURE^2).
    """
    n, positive = len(labels), float(labels.sum())
    with_it = np.bincount(bucket, minlength=BUCKETS)
    toxic = np.bincount(bucket[np.repeat(labels > 0, size)], minlength=BUCKETS)
    a, b = toxic / positive, (with_it - toxic) / (n - positive)
    pooled = (with_it + 1) / (n + 2)
    z = (a - b) ** 2 / (pooled * (1 - pooled) * (1 / positive + 1 / (n - positive)))
    return z / (z + SURE**2)


def fit_machine(bucket: np.ndarray, size: np.ndarray, labels: np.ndarray, seed: int = 1, l2: float = 1e-5, rate: float = 0.05) -> Machine:
    """Fits by Adagrad over mini-batches; the same input gives the same machine.

    bucket has the buckets of all documents in a row, size how many each document has.
    """
    y = labels.astype(np.float64)
    n, positive = len(y), float(y.sum())
    prior = (positive + 1) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    known, number = np.unique(bucket, return_inverse=True)  # only buckets that occur are learned
    number = number.astype(np.int64)
    theta = np.zeros((len(known), FACTORS + 1), dtype=np.float32)  # linear weight, factors
    linear, factors = np.zeros(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, FACTORS), dtype=np.float32)
    if positive in (0, n):
        return Machine(bias, linear, factors)
    value = values(bucket, size, labels)[known].astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    theta[:, 1:] = rng.normal(0, 0.02, (BUCKETS, FACTORS))[known]
    past, past_bias = np.full(theta.shape, 1e-8, dtype=np.float32), 1e-8
    first = np.cumsum(size) - size
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // n))):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            docs = order[k : k + BATCH]
            empty, docs = docs[size[docs] == 0], docs[size[docs] > 0]  # empty texts teach the bias alone
            alone = float((1 / (1 + np.exp(-np.clip(bias, -30, 30))) - y[empty]).sum())
            count = size[docs]
            if not len(docs):
                past_bias += alone**2
                bias -= rate * alone / float(np.sqrt(past_bias))
                continue
            begin = np.cumsum(count) - count
            own = number[np.repeat(first[docs] - begin, count) + np.arange(count.sum())]
            who = np.repeat(np.arange(len(docs)), count)
            w = np.take(theta, own, axis=0) * np.take(value, own, axis=0)
            sums = np.add.reduceat(w, begin, axis=0)  # per document: the linear part, and each factor's sum
            squares = np.bincount(who, np.einsum("ij,ij->i", w[:, 1:], w[:, 1:]), minlength=len(docs))
            z = bias + sums[:, 0] + 0.5 * (np.einsum("ij,ij->i", sums[:, 1:], sums[:, 1:]) - squares)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]
            # by bucket: the sums of g, and of g times the factors' sums, over the documents that have it
            by = np.sort(own * len(docs) + who)
            own, who = np.divmod(by, len(docs))
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            rows = own[at]
            sums[:, 0] = 1
            running = np.cumsum(np.take((sums * g[:, None]).astype(np.float32), who, axis=0), axis=0, dtype=np.float64)
            grad = np.diff(running[np.append(at[1:], len(own)) - 1], axis=0, prepend=0.0).astype(np.float32)
            mine, x = np.take(theta, rows, axis=0), np.take(value, rows, axis=0)
            grad[:, 1:] -= mine[:, 1:] * x * grad[:, :1]
            grad = grad * x + np.float32(l2) * mine
            seen = np.take(past, rows, axis=0) + grad * grad
            past[rows], theta[rows] = seen, mine - np.float32(rate) * grad / np.sqrt(seen)
            past_bias += (g.sum() + alone) ** 2
            bias -= rate * float((g.sum() + alone) / np.sqrt(past_bias))
    theta *= value
    linear[known], factors[known] = theta[:, 0], theta[:, 1:]
    return Machine(bias, linear, factors)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BUCKETS) -> Machine:
    """A machine from the labelled documents that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = join_small(docs.select("doc_id", F.col("text").cast("string").alias("__text")), known, "doc_id", "inner")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__text"):
                owner, bucket = features(s.column("__text"))
                bucket = bucket.astype("<i4")
                off = np.searchsorted(owner, np.arange(s.num_rows + 1)).tolist()
                got = [bucket[a:z].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([s.column("doc_id").cast(pa.int64()), s.column("__toxic").cast(pa.int32()), pa.array(got, pa.binary())], ["doc_id", "toxic", "buckets"])

    picked = chosen.mapInArrow(pick, "doc_id long, toxic int, buckets binary")
    one = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("buckets").alias("buckets"))  # ids may repeat
    one = checkpointed(one.withColumns({"h": F.xxhash64("doc_id"), "n": F.expr("length(buckets) div 4")}))
    rows_ = sorted(map(tuple, one.select("h", "doc_id", "n").collect()))  # TRAIN_ROWS at most
    fits = int(np.searchsorted(np.cumsum([r[2] for r in rows_]), most, "right"))
    if fits < len(rows_):
        h, doc = (rows_[fits - 1] if fits else (-(1 << 63), -(1 << 63)))[:2]
        one = one.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("doc_id") <= doc)))
    got = one.select("h", "doc_id", "toxic", "buckets").toArrow()
    got = got.take(pc.sort_indices(got, [("h", "ascending"), ("doc_id", "ascending")])).combine_chunks()
    column = strings(got.column("buckets"))
    flat, off = raw(column)
    return fit_machine(flat.view("<i4"), np.diff(off) // 4, got.column("toxic").to_numpy())


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all, by default), score and predicted (1 if score >= 0.5)."""
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    rows = docs.select(*own, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__text"):
                p = machine.score_texts(s.column("__text"))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*own, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema] + ["score double", "predicted int"])
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, machine, keep=("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
