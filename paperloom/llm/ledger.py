"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the measurements and one long whose
bit i says that rule i failed.  A policy is a versioned set of rules, that is, a mask: applying
it is one bitwise and, and ``ablations`` tells by bitwise aggregation what each rule alone
rejects, without reading a text again.

Defined results: a null text is an empty one, which fails ``few_words`` and no other rule; words
are runs of bytes other than \\x20 and \\x09-\\x0D; repeated rows are judged each; an empty table
gives an empty ledger; columns of the input named like a measurement are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import saved
from paperloom.llm.words import SPACE, distinct, slices, split

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclaims")

#: Rules in bit order: what fails a document.  Integers only, so every engine agrees.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "capitals": "10 * n_capitals > 3 * word_chars",
    "exclaims": "10 * n_exclaims > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Policies by version.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    w = split(column)
    n, owner, off = len(w.text) - 1, w.owner, w.text

    def per_text(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[off[1:]] - c[off[:-1]]

    inside = ~SPACE[w.data]
    lines = split(column, _NEWLINE)
    filled = np.concatenate([[0], np.cumsum(inside)])
    real = filled[lines.end] > filled[lines.start]
    of = lines.owner[real]
    line, values = distinct(w.data, lines.start[real], lines.end[real])
    first = np.unique(of * len(values) + line, return_index=True)[1]
    n_lines = np.bincount(of, minlength=n)

    word, values = w.distinct()
    covered = np.zeros(len(word), dtype=bool)
    if len(word) > 2:
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        two = np.unique(word[:-1] * len(values) + word[1:], return_inverse=True)[1]  # numbers of pairs, then of windows, then by text
        three = np.unique(two[whole] * len(values) + word[whole + 2], return_inverse=True)[1]
        _, back, count = np.unique(three * n + owner[whole], return_inverse=True, return_counts=True)
        twice = whole[count[back] >= 2]
        for k in range(3):
            covered[twice + k] = True
    return {
        "n_words": w.per_text,
        "word_chars": per_text(inside & ((w.data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[w.data]),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(of[first], minlength=n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n),
        "n_capitals": per_text((w.data >= 0x41) & (w.data <= 0x5A)),
        "n_exclaims": per_text(w.data == 0x21),
    }


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (all but the text, by default), the measurements, and failed, the rules' bits."""
    own = [c for c in (docs.columns if keep is None else keep) if c not in (*MEASURES, "failed", *([text] if keep is None else []))]
    rows = docs.select(*own, F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "__text"):
                got = measure(s.column("__text"))
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in own), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], [*own, *MEASURES])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema] + [f"{m} long" for m in MEASURES])
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return rows.mapInArrow(run, schema).withColumn("failed", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...], column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("failed").bitwiseAND(mask(policy)) == 0)


def ablations(rows: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """One row per rule of the policy: documents it fails, and those that only it rejects."""
    whole = mask(policy)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    hit = F.col("failed").bitwiseAND(whole)
    counts = rows.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    sums = counts.agg(
        *[F.coalesce(F.sum(F.when(F.col("hit").bitwiseAND(BIT[r]) != 0, F.col("n"))), F.lit(0)).alias(f"a_{r}") for r in names],
        *[F.coalesce(F.sum(F.when(F.col("hit") == BIT[r], F.col("n"))), F.lit(0)).alias(f"b_{r}") for r in names],
    )
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"a_{r}").alias("failed"), F.col(f"b_{r}").alias("only")) for r in names])
    return sums.select(F.inline(each))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = apply_policy(apply_policy(ledger(docs, keep=("doc_id",)), "v1"), "base", "base_kept")
    return rows.select("doc_id", *MEASURES, "failed", (~F.col("base_kept")).alias("base_failed"), "kept")


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy fails, and what only it rejects, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = saved(ledger(docs, keep=("doc_id",)).select("doc_id", "failed"), "ledger")  # read once per policy
    out = [ablations(rows, p).select(F.lit(p).alias("policy"), "rule", "failed", F.col("only").alias("only_rule")) for p in POLICIES]
    return reduce(DataFrame.unionByName, out)


_MEASURED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), g AS (
  SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g WHERE c IS NOT NULL
), v AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) x(k) WHERE n >= 2 GROUP BY r
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.doc_id, len(w.words)::BIGINT AS n_words,
    length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(v.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(d.text, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(d.text, '!'))::BIGINT AS n_exclaims
  FROM d JOIN w USING (r) LEFT JOIN v USING (r) LEFT JOIN l USING (r)
), b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_dup_lines > 5 * n_lines)::INT
    + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 14 * n_words)::INT + 64 * (10 * n_capitals > 3 * word_chars)::INT + 128 * (10 * n_exclaims > n_words)::INT)::BIGINT AS failed FROM m
)"""

ORACLE = f"""{_MEASURED}
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_exclaims, failed, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM b
"""

ABLATION_ORACLE = f"""{_MEASURED}, r AS (
  SELECT * FROM (VALUES {", ".join(f"('{p}', '{r}', {BIT[r]}, {mask(p)})" for p in POLICIES for r in POLICIES[p])}) x(policy, rule, bit, mask)
)
SELECT policy, rule, (count(*) FILTER (failed & bit <> 0))::BIGINT AS failed, (count(*) FILTER (failed & mask = bit))::BIGINT AS only_rule FROM r, b GROUP BY policy, rule
"""
