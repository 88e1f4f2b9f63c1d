from collections import defaultdict

import pytest

from tessera.llm import chat
from tests.compare import connect, differences


def brute(rows, t=chat.DEFAULT):
    by = defaultdict(set)
    for c, n, role, text in rows:
        by[c].add((n, role, text))
    out = {}
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    for c, turns in by.items():
        state, error, at, last, prev, segs, kept = "start", None, None, 0, None, [(t.begin, False)], []
        ordered = sorted(turns, key=key)
        for k, (n, role, text) in enumerate(ordered, 1):
            at = n
            if n is None:
                error = "turn without number"
            elif n == prev:
                error = "repeated turn"
            elif role not in t.roles:
                error = "unknown role"
            elif role not in t.follows.get(state, ()):
                error = "role out of order"
            elif text is None:
                error = "turn without text"
            if error:
                break
            r = t.roles[role]
            segs += [(r.before, False), (text, r.loss), (r.after, r.loss)]
            state, prev = role, n
            if role in t.accepts:
                last, kept = k, list(segs)
        if c is None:
            error = "conversation without id"
        elif not error and not last:
            error = "unfinished"
        out[c] = (error, None if not error or c is None else at, len(ordered), None if error else len(ordered) - last, [] if error else [s for s in kept if s[0]])
    return out


ROWS = [
    (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "open"), (2, 5, "user", "u"), (2, 9, "assistant", ""), (2, 9, "assistant", ""), (3, 0, "assistant", "a"), (4, 0, "user", "u"), (4, 0, "user", "other"),
    (5, 0, "user", "u"), (5, 1, "tool", "x"), (6, 0, "user", None), (7, None, "user", "u"), (8, 0, "user", "only"), (None, 0, "user", "u"), (None, 1, "assistant", "a"), (9, 0, None, "u"), (10, 0, "user", "x" * 500_000), (10, 1, "assistant", "y"), (11, 0, "user", "q"), (11, 1, "assistant", "a"), (11, 2, "assistant", "b"),
]


def test_cases(spark):
    df = spark.createDataFrame([(*r, "k") for r in ROWS], "conv_id long, turn int, role string, text string, loss string")
    got = {r.conv_id: (r.error, r.error_turn, r.turns, r.trimmed, [(s.text, s.loss) for s in r.segments]) for r in chat.formatted(df).collect()}
    assert got == brute(ROWS)
    assert all(r.valid == (r.error is None) for r in chat.formatted(df).collect())
    assert chat.segments(df.limit(0)).count() == 0
    flat = chat.segments(df)
    assert flat.columns == ["conv_id", "valid", "error", "error_turn", "turns", "trimmed", "segment", "text", "loss"]


def test_another_template(spark):
    t = chat.Template({"q": chat.Role("[", "]"), "a": chat.Role("(", ")", True), "note": chat.Role("{", "}")}, {"start": ("q",), "q": ("a", "note"), "note": ("a",), "a": ("q",)}, ("a",))
    rows = [(1, 0, "q", "x"), (1, 1, "note", "n"), (1, 2, "a", "y"), (2, 0, "note", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: (r.error, r.error_turn, r.turns, r.trimmed, [(s.text, s.loss) for s in r.segments]) for r in chat.formatted(df, t).collect()}
    assert got == brute(rows, t)
    with pytest.raises(ValueError):
        chat.Template({"q": chat.Role("", "")}, {"start": ("z",)}, ("q",))


def test_like_sql(spark, sf):
    assert differences(chat.op10_chat(spark, sf), connect(sf), chat.ORACLES["op10_chat"]) == ""
