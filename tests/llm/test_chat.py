"""Transcript parsing against plain Viterbi, on long and cut transcripts, and without loss of text."""

import random

import numpy as np
import pytest

from paperloom.llm import chat


def conversations(n, seed=1, turns=8):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(turns):
            role = "system" if t == 0 and c % 4 == 0 else ("user", "assistant")[t % 2]
            text = ("Short ask " + "w" * rnd.randrange(9) + "?") if role == "user" else "\n".join("A longer reply that goes on " + "word " * rnd.randrange(4, 30) for _ in range(rnd.randrange(1, 4)))
            out.append((c, t, role, text))
    return out


@pytest.fixture(scope="module")
def raw(spark):
    return chat.as_transcript(spark.createDataFrame(conversations(300), "conv_id long, turn int, role string, text string"))


@pytest.fixture(scope="module")
def model(raw):
    return chat.fit(chat.blocks(raw))


def plain_viterbi(model, symbols):
    """The best score of all state sequences, by the textbook recursion."""
    score = [int(model.move[chat.START, s] + model.emit[s, symbols[0]]) for s in range(chat.STATES)]
    for o in symbols[1:]:
        score = [max(score[r] + int(model.move[r, s]) for r in range(chat.STATES)) + int(model.emit[s, o]) for s in range(chat.STATES)]
    return max(score)


def score(model, symbols, states):
    before = [chat.START, *states[:-1]]
    return sum(int(model.move[a, b] + model.emit[b, o]) for a, b, o in zip(before, states, symbols, strict=True))


def test_paths_are_viterbis(model):
    rnd = random.Random(3)
    rows = [np.array([rnd.randrange(chat.SYMBOLS) for _ in range(rnd.randrange(1, 40))]) for _ in range(200)]
    paths = model.paths(rows, np.full(200, chat.START), np.full(200, -1))
    for symbols, path in zip(rows, paths, strict=True):
        assert score(model, symbols.tolist(), path.tolist()) == plain_viterbi(model, symbols.tolist())


@pytest.mark.parametrize("levels", [chat.LEVELS, (0, 1, 2, 3, 32, 33, 63)])
def test_tree_of_blocks_keeps_the_best_score(spark, model, monkeypatch, levels):
    monkeypatch.setattr(chat, "LEVELS", levels)
    rnd = random.Random(4)
    lines = [f"{rnd.choice(['User', 'Agent', 'Note', 'Zed'])}: " * (rnd.random() < 0.4) + "w " * rnd.randrange(1, 90) + "?" * (rnd.random() < 0.3) for _ in range(300)]
    cut = [(9, k % 3, k // 3, [0] * 7, [None] * 7, lines[i : i + 7]) for k, i in sorted(((k, 7 * (k % 3 * 14 + k // 3)) for k in range(42)), key=lambda x: x[1])]
    blocks = spark.createDataFrame(cut + [(None, 5, 1, [0], [None], ["alone"])], chat._BLOCK)
    known = {(r.part, r.seq): r for r in chat.joints(blocks, model).collect()}
    assert set(known) == {(c[1], c[2]) for c in cut} and sum(r.ends for r in known.values()) == 1
    states, symbols = [], []
    for c in sorted(cut, key=lambda c: c[1:3]):
        r, obs = known[c[1], c[2]], chat._observed([c[5]])
        states += model.paths(obs, np.array([r.entry]), np.array([r.leave]))[0].tolist()
        symbols += obs[0].tolist()
    assert score(model, symbols, states) == plain_viterbi(model, symbols)


def test_roles_of_held_out_transcripts(spark, model):
    new = chat.as_transcript(spark.createDataFrame([(c + 1000, *r) for c, *r in conversations(200, 7)], "conv_id long, turn int, role string, text string"))
    got = chat.parse(chat.blocks(new), model).collect()
    assert sum(r.role == r.label for r in got) / len(got) > 0.9
    assert sum(r.n_turns == 1 for r in got) / len(got) > 0.9


def test_words_with_colons_stay(spark, model):
    rows = [(1, 0, None, "User: see Note: this\nhttps://a.example/b: c\nNote: keep this"), (1, 1, None, "Agent: fine")]
    got = chat.parse(chat.blocks(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), model).collect()
    whole = "".join(r.rendered for r in sorted(got, key=lambda r: r.turn))
    assert "see Note: this" in whole and "https://a.example/b: c" in whole and "Note: keep this" in whole and "fine" in whole
    assert "User:" not in whole


def test_words_in_a_speakers_bucket_stay(spark, model):
    """Ordinary words whose hash is a speaker's, at the beginning of a turn."""
    taken = {chat.name_bucket(n) for n in model.speakers}
    words = [w for w in (a + b + c for a in "abcdefghij" for b in "aeiou" for c in "bdglmnrst") if chat.name_bucket(w) in taken and w not in model.speakers]
    assert len(words) > 10
    rows = [(i, t, None, f"User: {w.title()}: why?" if t == 0 else f"{w.title()}: because") for i, w in enumerate(words) for t in range(2)]
    got = chat.parse(chat.blocks(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), model).collect()
    assert all(f"{words[r.conv_id].title()}: " in r.rendered for r in got)


def test_nothing_is_lost_but_known_names(spark, model):
    """Rendered transcripts without their marks are the texts, less names that the model knows."""
    rnd = random.Random(8)
    heads = ["User: ", "**Agent**: ", "Example: ", "Dr. Lee: ", "Speaker 1: ", "José: ", "Note: ", "The reason is: ", "", "[Q]: "]
    rows = [(c, t, None, "\n".join(rnd.choice(heads) + "word " * rnd.randrange(6) + rnd.choice(["?", "."]) for _ in range(rnd.randrange(1, 4)))) for c in range(60) for t in range(4)]
    got = chat.parse(chat.blocks(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), model).collect()
    text = {(c, t): x for c, t, _, x in rows}
    for r in got:
        lines = [x for x in r.rendered.split("\n")[:-1] if not (x.startswith("<|") and x.endswith("|>"))]
        for line, was in zip(lines, text[r.conv_id, r.turn].split("\n"), strict=True):
            name, length = chat.marker(was)
            assert line == was or (name in model.speakers and line == was[length:])


def test_markers():
    assert [chat.marker(x)[0] for x in ("User: a", "**Agent**: a", "Dr. Lee: a", "Speaker 12: a", "José: a", "the reason is: a", "http://x", "a b: c")] == ["user", "agent", "dr. lee", "speaker 12", "josé", "", "", ""]


def test_very_long_texts(spark, model):
    long = "\n".join(f"line {i} of a very long reply" for i in range(60_000))
    df = spark.createDataFrame([(1, 0, "user", "User: go?"), (1, 1, "assistant", "Agent: " + long), (1, 2, "user", "User: " + "x" * 3_000_000)], "conv_id long, turn int, role string, text string")
    got = {r.turn: r for r in chat.parse(chat.blocks(df), model).collect()}
    assert got[1].n_lines == 60_000 and long.split("\n")[-1] in got[1].rendered and len(got[2].rendered) > 3_000_000
