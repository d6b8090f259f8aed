"""Transcript parsing: roles recovered by a hidden Markov model, then canonical rendering.

A raw transcript is lines in order.  Turns are marked now and then by a speaker's name ("User:",
"**Agent**:", "[Q]:"), in spellings that differ between transcripts, or not at all; where a message
begins is not told.  States are (role, begins a turn or goes on).  A line's observation is the name
before a colon, hashed to one of ``NAMES`` buckets, and line features: length, closing question mark,
kind of first character.  What names mean is learned, with the usual ones as pseudo-counts.  Viterbi finds
the most likely states; a line in a begin state opens a turn, and turns are rendered as <|role|>, lines,
<|end|>.  Buckets serve only the observation; a name is taken off if lines with that very name nearly
always begin turns of one role (so "Note:" stays), by an aggregation over all lines of the training part.

A marker is one word of up to 14 letters of any script, with a title before it ("Dr. Lee:") or a number
after it ("Speaker 1:") at most; longer phrases before a colon are text.

Transcripts may be of any length: rows are range-partitioned and sorted by (conversation, turn), packed
into blocks of at most ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` bytes of one conversation, and written.
For conversations of several blocks each block's best scores from every entry state to every exit
state form a small matrix.  Matrices are multiplied in a tree of ``LEVELS`` levels, and entry and exit
states handed down again, so no task holds more than a node's children; blocks are then decoded
independently.  Scores are integers (millionths of a nat), so cutting a transcript into blocks changes
no score.

Probabilities are counted over all labelled rows of the training part, by an aggregation with as many
rows as there are parameters.

Defined results: a null text is one empty line; null conversation ids form one conversation and
null turns come first; equal (conversation, turn) are ordered by text; roles other than the known
ones are not trained on; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import checkpointed, saved

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # 2 * role + (1 if the line goes on)
START = STATES  # the state before a conversation
#: Usual names by role, known without training.
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "model", "answer", "a"),
}
USUAL = 5  # lines that a usual name counts as
NAMES = 256
SURE = 0.9  # the share of a name's lines that begin turns of one role, for it to be taken off
KNOWN = 10_000  # most names that a model takes off, the most frequent; others stay in the text
LENGTHS = (40, 120, 300)
BLOCK_ROWS = 4096
BLOCK_BYTES = 2 << 20
#: A block's place is partition << 32 | number; nodes of each level of the tree share its bits from here on.
LEVELS = (0, 6, 32, 38, 63)
SCALE = 1_000_000
FOLDS = 5
NEVER = -(1 << 50)

_MARKER = re.compile(r"[ \t]*[*#>\[(<|]{0,3}[ \t]*((?:[^\W\d_]{1,3}\.[ ])?[^\W\d_]{1,14}(?:[ ]\d{1,3})?)[ \t]*[\])>|*]{0,3}[ \t]*:[*]{0,2}(?!//)[ \t]*")
FEATURES = (len(LENGTHS) + 1) * 2 * 3
SYMBOLS = FEATURES * (NAMES + 1)


def name_bucket(name: str) -> int:
    return 1 + zlib.crc32(name.lower().encode()) % NAMES


def marker(line: str) -> tuple[str, int]:
    """(the name in lower case, empty if there is none; length of the name with what belongs to it)."""
    m = _MARKER.match(line)
    return ("", 0) if m is None else (m[1].lower(), m.end())


def symbol(line: str) -> int:
    """A line's observation."""
    name, at = marker(line)
    bucket = name_bucket(name) if name else 0
    length = sum(len(line) - at > k for k in LENGTHS)
    head = line[at : at + 1]
    kind = 0 if not head else 1 if head.isupper() or head.isdigit() else 2
    return ((length * 2 + line.rstrip().endswith("?")) * 3 + kind) * (NAMES + 1) + bucket


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


_BLOCK = "conv_id long, part int, seq int, turns array<int>, roles array<string>, texts array<string>"


def blocks(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) packed by conversation in order; written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            conv, turns, roles, texts = zip(*held)
            cols = [pa.array([conv[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([seq], pa.int32())]
            cols += [pa.array([list(x)], pa.list_(t)) for x, t in ((turns, pa.int32()), (roles, pa.string()), (texts, pa.string()))]
            return pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "seq", "turns", "roles", "texts"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if held and (held[-1][0] != row[0] or len(held) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                    yield done()
                    held, size, seq = [], 0, seq + 1
                held.append(row)
                size += len(row[3] or "")
        if held:
            yield done()

    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), F.col("role").cast("string"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), tie]
    return saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, _BLOCK), "chat")


@dataclass
class Hmm:
    """Integer log-probabilities: move[from, to] with START last, emit[state, symbol]; and the names that are speakers'."""

    move: np.ndarray
    emit: np.ndarray
    speakers: frozenset[str]

    def matrices(self, rows: list[np.ndarray]) -> np.ndarray:
        """For each row of symbols, best scores from every state (and START) to every state."""
        v = np.full((len(rows), STATES + 1, STATES + 1), NEVER)
        v[:, np.arange(STATES + 1), np.arange(STATES + 1)] = 0
        for live, obs in _steps(rows):
            got = (v[live][:, :, :, None] + self.move[None, None, :, :]).max(axis=2)
            v[live] = np.maximum(got + np.append(self.emit[:, obs], np.full((1, len(obs)), NEVER), axis=0).T[:, None, :], NEVER)
        return v

    def paths(self, rows: list[np.ndarray], entry: np.ndarray, leave: np.ndarray) -> list[np.ndarray]:
        """The best states of each row, from its entry state to its exit state (-1: the best one)."""
        n = len(rows)
        v = np.full((n, STATES + 1), NEVER)
        v[np.arange(n), entry] = 0
        back = []
        for live, obs in _steps(rows):
            got = v[live][:, :, None] + self.move[None]
            came = got.argmax(axis=1).astype(np.int8)
            v[live] = np.maximum(got.max(axis=1) + np.append(self.emit[:, obs], np.full((1, len(obs)), NEVER), axis=0).T, NEVER)
            back.append((live, came))
        at = np.where(leave < 0, v[:, :STATES].argmax(axis=1), leave)
        out = [np.zeros(len(r), dtype=np.int8) for r in rows]
        for t in range(len(back) - 1, -1, -1):
            live, came = back[t]
            for k, i in enumerate(live.tolist()):
                out[i][t] = at[i]
                at[i] = came[k, at[i]]
        return out


def _steps(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place, the rows that reach it and their symbols there."""
    size = np.array([len(r) for r in rows])
    order = np.argsort(-size, kind="stable")
    flat, first = np.concatenate([rows[i] for i in order]) if len(rows) else np.zeros(0, int), np.cumsum(size[order]) - size[order]
    reach = size[order]
    for t in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-reach, -t, "left"))
        yield order[:n], flat[first[:n] + t]


def train_part(conv_id: Column) -> Column:
    """Whether a conversation's labels may be learned from."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % FOLDS, F.lit(0)) != 0


def fit(packed: DataFrame) -> Hmm:
    """Counts over all blocks of the training part, with one added to each and more to usual names."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move = np.zeros((STATES + 1, STATES), dtype=np.int64)
        seen, named = np.zeros((STATES, FEATURES), dtype=np.int64), np.zeros((STATES, NAMES + 1), dtype=np.int64)
        for b in batches:
            for roles, texts in zip(b.column("roles").to_pylist(), b.column("texts").to_pylist(), strict=True):
                last = START
                for role, text in zip(roles, texts, strict=True):
                    if role not in ROLES:
                        last = -1
                        continue
                    for k, line in enumerate(lines_of(text)):
                        state = 2 * ROLES.index(role) + (k > 0)
                        if last >= 0:
                            move[last, state] += 1
                        feature, bucket = divmod(symbol(line), NAMES + 1)
                        seen[state, feature] += 1
                        named[state, bucket] += 1
                        last = state
        for kind, table in enumerate((move, seen, named)):
            x, y = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind)), pa.array(x), pa.array(y), pa.array(table[x, y])], ["kind", "x", "y", "n"])

    counts = packed.where(train_part(F.col("conv_id"))).select("roles", "texts").mapInArrow(count, "kind long, x long, y long, n long")
    move, seen, named = np.ones((STATES + 1, STATES)), np.ones((STATES, FEATURES)), np.ones((STATES, NAMES + 1))
    for i, role in enumerate(ROLES):
        for name in SPEAKERS[role]:
            named[2 * i, name_bucket(name)] += USUAL
    for r in counts.groupBy("kind", "x", "y").agg(F.sum("n").alias("n")).collect():  # a row per parameter
        (move, seen, named)[r.kind][r.x, r.y] += r.n
    move, seen, named = (np.rint(np.log(t / t.sum(axis=1, keepdims=True)) * SCALE).astype(np.int64) for t in (move, seen, named))
    emit = (seen[:, :, None] + named[:, None, :]).reshape(STATES, SYMBOLS)
    return Hmm(np.concatenate([move, np.full((STATES + 1, 1), NEVER)], axis=1), emit, speakers(packed))


def speakers(packed: DataFrame) -> frozenset[str]:
    """Names whose lines begin turns of one role nearly always, counted over the training part and the usual names."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for roles, texts in zip(b.column("roles").to_pylist(), b.column("texts").to_pylist(), strict=True):
                for role, text in zip(roles, texts, strict=True):
                    if role in ROLES:
                        for k, line in enumerate(lines_of(text)):
                            if name := marker(line)[0]:
                                n[name, 2 * ROLES.index(role) + (k > 0)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["name", "state", "n"])

    counted = packed.where(train_part(F.col("conv_id"))).select("roles", "texts").mapInArrow(count, "name string, state int, n long")
    usual = [(name, 2 * i, USUAL) for i, role in enumerate(ROLES) for name in SPEAKERS[role]]
    counted = counted.unionByName(packed.sparkSession.createDataFrame(usual, "name string, state int, n long"))
    begins = [F.coalesce(F.sum(F.when(F.col("state") == 2 * i, F.col("n"))), F.lit(0)).alias(f"r{i}") for i in range(len(ROLES))]
    by = counted.groupBy("name").agg(F.sum("n").alias("n"), *begins)
    sure = by.where((F.greatest(*[F.col(f"r{i}") for i in range(len(ROLES))]) >= F.col("n") * SURE) & (F.col("n") >= USUAL))
    return frozenset(r.name for r in sure.orderBy(F.desc("n"), "name").limit(KNOWN).select("name").collect())


def _observed(texts: list[list[str | None]]) -> list[np.ndarray]:
    return [np.array([symbol(line) for t in block for line in lines_of(t)], dtype=np.int64) for block in texts]


def _matrices(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64).reshape(STATES + 1, STATES + 1) for x in column]


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """A node's matrix from those of its children."""
    pdf = pdf.sort_values("node")
    out = None
    for m in _matrices(pdf["m"]):
        out = m if out is None else np.maximum((out[:, :, None] + m[None]).max(axis=1), 2 * NEVER)
    return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "node": pdf["parent"].iloc[:1], "m": [out.tobytes()]})


def _hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit states of a node's children, from its own."""
    pdf = pdf.sort_values("node")
    ms = _matrices(pdf["m"])
    f = np.full(STATES + 1, NEVER)
    f[int(pdf["entry"].iloc[0])] = 0
    reach = [f]
    for m in ms:
        f = np.maximum((f[:, None] + m).max(axis=0), 2 * NEVER)
        reach.append(f)
    out = int(pdf["leave"].iloc[0])
    leave = [int(f[:STATES].argmax()) if out < 0 else out]
    for m, before in zip(ms[:0:-1], reach[-2:0:-1], strict=True):
        leave.append(int((before + m[:, leave[-1]]).argmax()))
    leave = leave[::-1]
    ends = [False] * (len(ms) - 1) + [bool(pdf["ends"].iloc[0])]
    return pd.DataFrame({"conv": pdf["conv"].to_numpy(), "node": pdf["node"].to_numpy(), "entry": [int(pdf["entry"].iloc[0]), *leave[:-1]], "leave": leave, "ends": ends})


def joints(packed: DataFrame, model: Hmm) -> DataFrame:
    """(part, seq, entry, leave, ends) of the blocks of conversations with several."""
    several = packed.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    several = checkpointed(several)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model.matrices(_observed(b.column("texts").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("node"), pa.array([x.tobytes() for x in m], pa.binary())], ["conv", "node", "m"])

    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    node = F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq")
    rows = packed.join(several, packed.conv_id.eqNullSafe(several.c), "left_semi").select(conv.alias("conv"), node.alias("node"), "texts")
    nodes = [checkpointed(rows.mapInArrow(matrix, "conv string, node long, m binary"))]
    up = [b - a for a, b in zip(LEVELS[:-1], LEVELS[1:], strict=True)]
    for bits in up:
        parents = nodes[-1].withColumn("parent", F.shiftright("node", bits))
        nodes.append(checkpointed(parents.groupBy("conv", "parent").applyInPandas(_product, "conv string, node long, m binary")))
    known = nodes[-1].select("conv", "node", F.lit(START).alias("entry"), F.lit(-1).alias("leave"), F.lit(True).alias("ends"))
    for bits, own in zip(up[::-1], nodes[-2::-1], strict=True):
        children = own.withColumn("parent", F.shiftright("node", bits)).join(known.withColumnRenamed("node", "parent"), ["conv", "parent"])
        known = checkpointed(children.groupBy("conv", "parent").applyInPandas(_hand_down, "conv string, node long, entry int, leave int, ends boolean"))
    return known.select(F.shiftright("node", 32).cast("int").alias("part"), F.col("node").bitwiseAND((1 << 32) - 1).cast("int").alias("seq"), "entry", "leave", "ends")


def parse(packed: DataFrame, model: Hmm) -> DataFrame:
    """(conv_id, turn, label, role, n_lines, n_turns, rendered) of every message.

    label is the role it came with, role that of its first line, n_turns the turns that it opens;
    rendered pieces of a conversation, in order, make up the canonical transcript.
    """
    met = packed.join(joints(packed, model), ["part", "seq"], "left")
    names = ["conv_id", "turn", "label", "role", "n_lines", "n_turns", "rendered"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            entry = np.array([START if x is None else x for x in d["entry"]])
            leave = np.array([-1 if x is None else x for x in d["leave"]])
            paths = model.paths(_observed(d["texts"]), entry, leave)
            out = []
            for i, path in enumerate(paths):
                at, last = 0, entry[i] != START
                ends = d["ends"][i] is None or d["ends"][i]
                for k, (turn, label, text) in enumerate(zip(d["turns"][i], d["roles"][i], d["texts"][i], strict=True)):
                    lines, piece, opened = lines_of(text), [], 0
                    for j, line in enumerate(lines):
                        state = int(path[at + j])
                        if state % 2 == 0 or not last:
                            piece.append(("<|end|>\n" if last else "") + f"<|{ROLES[state // 2]}|>\n")
                            name, length = marker(line)
                            line = line[length:] if name in model.speakers else line
                            opened += 1
                        last = True
                        piece.append(line + "\n")
                    if ends and k + 1 == len(d["turns"][i]):
                        piece.append("<|end|>\n")
                    out.append((d["conv_id"][i], turn, label, ROLES[int(path[at]) // 2], len(lines), opened, "".join(piece)))
                    at += len(lines)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)

    schema = "conv_id long, turn int, label string, role string, n_lines long, n_turns long, rendered string"
    return met.select("conv_id", "turns", "roles", "texts", "entry", "leave", "ends").mapInArrow(decode, schema)


#: Names that the query writes; the model knows only some of them without training.
WRITTEN = {
    "system": ("System", "Setup", "Briefing", "Context"),
    "user": ("User", "Human", "Caller", "Visitor", "Me", "Q"),
    "assistant": ("Assistant", "Agent", "Helper", "Desk", "AI", "A"),
}


def as_transcript(conversations: DataFrame) -> DataFrame:
    """Messages as raw transcripts: seven in ten with a speaker's name, one in twenty with another word and a colon, the others bare."""
    h = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(1000))
    forms = ("{}: ", "**{}**: ", "[{}]: ", "### {}: ")
    texts = F.coalesce(F.col("text"), F.lit(""))
    said = F.when((h >= 700) & (h < 750), F.concat(F.lit("Note: "), texts)).otherwise(texts)
    for role in ROLES:
        every = [f.format(n) for n in WRITTEN[role] for f in forms]
        name = F.element_at(F.array(*[F.lit(x) for x in every]), (F.pmod(F.xxhash64("turn", "conv_id"), F.lit(len(every))) + 1).cast("int"))
        said = F.when((F.col("role") == role) & (h < 700), F.concat(name, texts)).otherwise(said)
    return conversations.select("conv_id", "turn", "role", said.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = blocks(as_transcript(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    out = parse(packed, fit(packed))
    return out.select("conv_id", "turn", "role", (F.col("role").eqNullSafe(F.col("label"))).alias("recovered"), "n_lines", "n_turns", "rendered")
