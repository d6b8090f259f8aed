"""A Merkle manifest of a table, with authentication paths by fractal traversal.

Rows are leaves: H, the lower-case hex SHA-256, of their fields.  In each group (a source) leaves
ascend by id; runs of ``ARITY`` neighbours become their H, level by level, until one node, the
group's subroot, is left.  Subroots, ordered by group, are the leaves of a tree of the same kind,
whose last node is the root.

1. Leaves are hashed where the rows lie (JVM functions); texts are never shuffled.
2. They are numbered within their groups by a range sort, so a group with a third of all rows
   spreads over tasks.
3. Every aligned block of ``ARITY**BLOCK_LEVELS`` leaves is one group of a shuffle.  Within it the
   traversal keeps one existing subtree of ``SUBTREE_LEVELS`` levels per stack level, which serves
   the present paths, and one desired subtree, which grows by one leaf for each path given out, so
   it is whole when the traversal enters it.  It holds digests of these subtrees alone: some
   ``2 * ARITY**(SUBTREE_LEVELS + 1) / 2`` a stack level.
4. Blocks' roots are the leaves of the next round, the same work on a table ``ARITY**BLOCK_LEVELS``
   times smaller; the paths that it gives are appended to those within the blocks.

A path is a list of (before, after), from the leaf upwards: what is hashed before and after the
node in its run, so a leaf folds up to the root by H(before || node || after).

Defined results: null ids come last in their group; equal ids are ordered by their leaves; repeated
rows are leaves each; null groups form one group, the first; a leaf alone in its group is its
subroot; an empty table gives an empty one; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.shared import checkpointed, join_small, saved

ARITY = 3
BLOCK_LEVELS = 7
SUBTREE_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
#: Most blocks whose paths are broadcast, of one or two KB each.
BROADCAST_BLOCKS = 5_000


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Subtree:
    """The nodes at levels [low, top) below one node at level top, grown leaf by leaf."""

    def __init__(self, low: int, top: int):
        self.low, self.top, self.root = low, top, None
        self.nodes: list[list[str]] = [[] for _ in range(low, top)]
        self._open: list[list[str]] = [[] for _ in range(top)]

    def push(self, node: str, level: int = 0) -> None:
        while level < self.top:
            if level >= self.low:
                self.nodes[level - self.low].append(node)
            run = self._open[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node, level = digest(run), level + 1
            run.clear()
        self.root = node

    def close(self) -> Subtree:
        """Ends the leaves: runs left open, also of one node, are hashed."""
        for level, run in enumerate(self._open):
            if run:
                node = digest(run)
                run.clear()
                self.push(node, level + 1)
        return self


class Traversal:
    """Authentication paths of successive leaves of a block of ``levels`` levels."""

    def __init__(self, leaves: Sequence[str], levels: int, subtree: int = SUBTREE_LEVELS):
        self.leaves = leaves
        self.stacks = [(low, min(low + subtree, levels)) for low in range(0, levels, subtree)] or [(0, 0)]
        self.existing = [self._grown(0, low, top) for low, top in self.stacks]
        self.desired = [Subtree(low, top) for low, top in self.stacks]
        self.root = self.existing[-1].root

    def _grown(self, first: int, low: int, top: int) -> Subtree:
        tree = Subtree(low, top)
        for x in range(first, min(first + ARITY**top, len(self.leaves))):
            tree.push(self.leaves[x])
        return tree.close()

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        n = len(self.leaves)
        for x in range(n):
            path = []
            for j, (low, top) in enumerate(self.stacks):
                span = ARITY**top
                if x and x % span == 0:
                    self.existing[j], self.desired[j] = self.desired[j].close(), Subtree(low, top)
                for level in range(low, top):
                    at = (x % span) // ARITY**level
                    begin = at - at % ARITY
                    nodes = self.existing[j].nodes[level - low]
                    path.append(("".join(nodes[begin:at]), "".join(nodes[at + 1 : begin + ARITY])))
                ahead = (x // span + 1) * span + x % span
                if ahead < n:
                    self.desired[j].push(self.leaves[ahead])
            yield path


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ordinal, their number from 0 in ``order``, by a range sort."""
    sort = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    loose = checkpointed(sort.withColumn("__loose", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__loose", 33))
    sizes = loose.groupBy("__part").agg(F.count("*").alias("n"))  # one row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    loose = join_small(loose, sizes.select("__part", before.alias("__before")), "__part", "inner")
    return loose.withColumn("ordinal", F.col("__before") + F.col("__loose").bitwiseAND((1 << 33) - 1)).drop("__part", "__loose", "__before")


def _block_paths(nodes: DataFrame, levels: int, subtree: int) -> DataFrame:
    """``nodes`` with path and top, within their blocks: the path to the block's root, and that root."""
    size = ARITY**levels

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["idx"]))
        leaves = table["node"].to_pylist()
        n = table["n"][0].as_py()
        walk = Traversal(leaves, height(n) if n <= size else levels, subtree)
        before, after, stops = [], [], [0]
        for path in walk:
            for b, a in path:
                before.append(b)
                after.append(a)
            stops.append(len(before))
        pairs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
        table = table.drop_columns(["block"])
        table = table.append_column("path", pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pairs))
        return table.append_column("top", pa.array([walk.root] * len(leaves), pa.string()))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema] + [f"path {PATH}", "top string"])
    return nodes.withColumn("block", F.floor(F.col("idx") / size).cast("long")).groupBy("key", "block").applyInArrow(run, schema)


def paths(nodes: DataFrame, levels: int = BLOCK_LEVELS, subtree: int = SUBTREE_LEVELS) -> DataFrame:
    """Columns of ``nodes`` (key, idx, n, node and others), path to the key's root, and top, that root.

    key is never null; idx numbers a key's n nodes from 0.
    """
    size = ARITY**levels
    low = saved(_block_paths(nodes, levels, subtree), "paths")
    if low.where(F.col("n") > size).isEmpty():
        return low
    above = low.where(F.col("idx") % size == 0).select("key", F.floor(F.col("idx") / size).cast("long").alias("idx"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("node"))
    upper = paths(above, levels, subtree).select(F.col("key").alias("__key"), F.col("idx").alias("__block"), F.col("path").alias("__path"), F.col("top").alias("__top"))
    on = (F.col("key") == F.col("__key")) & (F.floor(F.col("idx") / size) == F.col("__block"))
    joined = join_small(low, upper, on, "inner", BROADCAST_BLOCKS)
    return joined.withColumns({"path": F.concat("path", "__path"), "top": F.col("__top")}).drop("__key", "__block", "__path", "__top")


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that ``node`` and the siblings of ``path`` give."""
    return F.aggregate(path, node, lambda acc, step: F.sha2(F.concat(step["before"], acc, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings from the leaf upwards."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest(rows: DataFrame, group: str, order: str, node: str = "leaf", levels: int = BLOCK_LEVELS, subtree: int = SUBTREE_LEVELS) -> DataFrame:
    """``rows`` (short ones: no texts) with subroot, root, and path, that of ``node`` to the root."""
    own = [c for c in rows.columns if c not in ("path", "subroot", "root")]
    # an empty key is the null group's, which comes first; strings are ordered by their bytes
    key = F.coalesce(F.concat(F.lit("."), F.col(group).cast("string")), F.lit(""))
    flat = rows.select(key.alias("key"), F.col(order).alias("order"), F.col(node).alias("node"), F.struct(*own).alias("own"))
    flat = numbered(saved(flat, "leaves"), [F.col("key"), F.col("order").asc_nulls_last(), F.col("node")])
    of = flat.groupBy("key").agg(F.min("ordinal").alias("first"), F.count("*").alias("n"))
    leaves = join_small(flat, of, "key", "inner").select("own", "key", (F.col("ordinal") - F.col("first")).alias("idx"), "n", "node")
    low = paths(leaves, levels, subtree)
    subroots = numbered(low.where("idx = 0").select("key", F.col("top").alias("node")), [F.col("key")])
    n = F.lit(subroots.count()).cast("long")
    nodes = subroots.select(F.lit("").alias("key"), F.col("ordinal").alias("idx"), n.alias("n"), "node", F.col("key").alias("group"))
    upper = paths(nodes, levels, subtree).select(F.col("group").alias("key"), F.col("path").alias("__path"), F.col("top").alias("root"))
    out = join_small(low, upper, "key", "inner", BROADCAST_BLOCKS)
    return out.select("own.*", F.col("top").alias("subroot"), "root", F.concat("path", "__path").alias("path"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = [F.col(c) for c in FIELDS]
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = F.coalesce(crc % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    tampered = F.when(changed, leaf([*columns[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))]))
    rows = docs.select("doc_id", "source", leaf(columns).alias("leaf"), tampered.alias("tampered"))
    out = manifest(rows, "source", "doc_id").withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL spells out, for up to ARITY**LEVELS documents of a source and as many sources.
_SQL_LEVELS = 11
#: The table of the cyclic redundancy check, by its rule.
_CRC = []
for _c in range(256):
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC.append(_c)


def _sql_tree(name: str, base: str) -> str:
    """CTEs of the levels over ``base`` (k, idx, node): ``name``_l has k, idx, node, n, before, after."""
    out = []
    for level in range(_SQL_LEVELS + 1):
        source = base if level == 0 else f"(SELECT k, i AS idx, node FROM {name}_{level - 1}_up)"
        run = "PARTITION BY k, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING"
        out.append(
            f"{name}_{level} AS MATERIALIZED (SELECT *, coalesce(string_agg(node, '') OVER ({run} AND 1 PRECEDING), '') AS before, "
            f"coalesce(string_agg(node, '') OVER (PARTITION BY k, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after "
            f"FROM (SELECT k, idx, node, count(*) OVER (PARTITION BY k) AS n FROM {source}))"
        )
        # a single node stays as it is
        out.append(
            f"{name}_{level}_up AS MATERIALIZED (SELECT k, idx // 3 AS i, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END AS node FROM {name}_{level} GROUP BY k, idx // 3)"
        )
    return ", ".join(out)


def _sql_walk(name: str, start: str, proof: str, folded: str) -> tuple[str, str]:
    """CTEs that walk the rows of ``start`` (k, idx, ...) up, and the name of the last."""
    out, last = [], start
    for level in range(_SQL_LEVELS + 1):
        new = f"{name}_walk_{level}"
        out.append(
            f"{new} AS MATERIALIZED (SELECT w.* REPLACE (w.idx // 3 AS idx, w.{proof} || CASE WHEN t.n > 1 THEN t.before || t.after ELSE '' END AS {proof}, "
            f"CASE WHEN t.n > 1 THEN sha256(t.before || w.{folded} || t.after) ELSE w.{folded} END AS {folded}) FROM {last} w JOIN {name}_{level} t ON w.k = t.k AND w.idx = t.idx)"
        )
        last = new
    return ", ".join(out), last


def _sql() -> str:
    f = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    inner, end = _sql_walk("g", "rows_in", "proof", "folded")
    outer, last = _sql_walk("r", "rows_out", "proof", "folded")
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(([{', '.join(map(str, _CRC))}])[xor(c & 255, b) + 1]::BIGINT, c >> 8)), 4294967295::BIGINT)"
    return f"""
WITH d AS (
  SELECT *, coalesce(CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END, text) AS other, coalesce('.' || source, '') AS k FROM documents
), h AS MATERIALIZED (
  SELECT k, doc_id, sha256({" || ".join(f(c) for c in FIELDS)}) AS node, sha256({" || ".join(f(c) for c in (*FIELDS[:-1], "other"))}) AS tampered FROM d
), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, node) - 1 AS idx FROM h
), {_sql_tree("g", "(SELECT k, idx, node FROM o)")}, subroots AS MATERIALIZED (
  SELECT k AS source, '' AS k, row_number() OVER (ORDER BY encode(k)) - 1 AS idx, node FROM g_{_SQL_LEVELS}_up
), {_sql_tree("r", "(SELECT k, idx, node FROM subroots)")}, rows_in AS (SELECT k, idx, doc_id, node AS leaf, '' AS proof, tampered AS folded FROM o
), {inner}, rows_out AS (
  SELECT s.k, s.idx, w.doc_id, w.leaf, w.proof, w.folded, s.node AS subroot FROM {end} w JOIN subroots s ON w.k = s.source
), {outer}
SELECT w.doc_id, w.leaf, w.subroot, u.node AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = u.node AS verified FROM {last} w, r_{_SQL_LEVELS}_up u
"""


ORACLE = _sql()
