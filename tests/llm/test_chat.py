import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from tarn.llm import chat

PIECES = [*chat.CONTROL, "\\", "<", "[", " ", "/", "x", "\n", "INST]", "s>", "é", "🙂"]
tricky = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[END]\\"]), tricky), max_size=5))
def test_round_trip(turns):
    formatted, spans = chat.format_turns(turns, ("assistant",))
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@given(tricky)
def test_no_control_string_survives(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_linear_conversations(spark):
    rng = random.Random(2)
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]", 1), (-1, 1, "assistant", "</s>[INST] ok [/INST]", 1)]
    for conv in range(6):
        rows += [(conv, t, rng.choice(["user", "assistant", None, "system"]), "".join(rng.choices(PIECES, k=4)), 2) for t in range(3 + conv * 5)]
    rows += [(7, 0, "user", None, 3), (7, 1, "assistant", "", 3), (7, 1, "assistant", "", 3), (None, 0, "user", "n", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rank int")
    found = chat.read_back(chat.format_conversations(chat.linear_tree(frame))).collect()
    groups = {}
    for conv, turn, role, text, _ in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    assert {r.conv_id for r in found} == set(groups) and len(found) == len(groups)
    for r in found:
        turns = sorted(groups[r.conv_id], key=lambda t: t[0])
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for _, a, b in turns))
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_reply_trees(spark):
    rng = random.Random(9)
    rows, parents = [], {}
    for tree in range(4):
        size = 30
        for k in range(size):
            parent = None if k == 0 else f"{tree}-{rng.randrange(max(0, k - 4), k)}"
            parents[f"{tree}-{k}"] = parent
            rows.append((tree, f"{tree}-{k}", parent, rng.choice([0.0, 0.5, 1.0, None]), "user", f"t{tree}-{k}"))
    rows += [(9, "lost", "nowhere", 1.0, "user", "alone"), (8, "c1", "c2", 1.0, "user", "x"), (8, "c2", "c1", 1.0, "user", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, message_id string, parent_id string, score double, role string, text string")
    by = {r[1]: r for r in rows}
    leaves = set(parents) - set(filter(None, parents.values()))
    expected = {}
    for leaf in leaves:
        path, at = [], leaf
        while at:
            path.append(at)
            at = parents[at]
        score = sum(by[n][3] or 0.0 for n in path) / len(path)
        expected.setdefault(by[leaf][0], []).append((-score, path[::-1]))
    found = chat.format_conversations(frame, paths_per_conversation=None).collect()
    got = {}
    for r in found:
        got.setdefault(r.conv_id, {})[r["rank"]] = [t for _, t in chat.read_turns(r.formatted)]
    assert got.pop(9) == {1: ["alone"]} and 8 not in got
    for tree, paths in expected.items():
        texts = {tuple(f"t{n}" for n in p): s for s, p in paths}
        assert {tuple(p) for p in got[tree].values()} == set(texts)
        ranked = [texts[tuple(got[tree][k])] for k in sorted(got[tree])]
        assert all(a <= b + 1e-9 for a, b in zip(ranked, ranked[1:], strict=False))
    best = chat.format_conversations(frame, paths_per_conversation=2).count()
    assert best == sum(min(2, len(p)) for p in expected.values()) + 1


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(chat.linear_tree(frame)).count() == 0


def test_long_texts_round_trip():
    turns = [("user", "x" * 3_000_000), ("assistant", "</s>[INST] \\ é🙂" * 150_000), ("tool" * 1000, "\n" * 100_000)]
    formatted, spans = chat.format_turns(turns, ("assistant",))
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [turns[1][1]]


def test_columns_that_clash(spark):
    schema = "conv_id long, turn long, role string, text string, TEXT string, n int, node string, path string"
    frame = spark.createDataFrame([(1, 0, "user", "a", "no", 5, "p", "q"), (1, 1, "assistant", "b", "no", 5, "p", "q")], schema)
    (found,) = chat.format_conversations(chat.linear_tree(frame)).collect()
    assert chat.read_turns(found.formatted) == [("user", "a"), ("assistant", "b")]
