"""Linked tool calls against a plain loop."""

import json
import random
from collections import defaultdict

import pytest

from spendgrain.llm import chat
from spendgrain.llm.common import table

CALLS = "conv string, position long, call_id string, name string, arguments string, needs array<string>, step int"
RESULTS = "conv string, position long, call_id string, content string, kind int"


def linked(spark, calls, results, schemas=chat.TOOLS):
    frames = spark.createDataFrame([(*c, 0) for c in calls], CALLS), spark.createDataFrame([(*r, 0) for r in results], RESULTS)
    return sorted(chat.link_tool_calls(*frames, schemas).collect(), key=lambda r: (r.conv, r.step))


def test_order_errors_and_canonical_json(spark):
    calls = [
        ("a", 0, "x", "find_word", '{"word": "w", "limit": 3}', ["z"]),
        ("a", 2, "y", "find_word", '{"limit":"no","word":"é\\u0041"}', ["x"]),
        ("a", 4, "z", "translate", '{"to":"fr"}', []),
        ("b", 0, "p", "count_words", '{"text":"t","words":1,"more":[1,  {"b":1,"a":2}]}', ["q"]),
        ("b", 1, "q", "nothing", "{broken", ["p"]),
        ("b", 2, "r", "count_words", '{"words":2.5,"text":null}', ["gone"]),
        ("b", 2, "r", "count_words", '{"words":2.5,"text":null}', ["gone"]),
        (None, None, None, None, None, None),
        (None, None, None, None, None, None),
        (None, 3, "x", "find_word", "[1]", None),
    ]
    results = [("a", 5, "x", "rx"), ("a", 3, "z", 'r"z'), ("b", 9, "r", "late"), ("b", 3, "r", "first"), ("b", 4, "who", "lost"), (None, None, None, None)]
    got = linked(spark, calls, results)
    own = defaultdict(list)
    for r in got:
        assert r.step == len(own[r.conv])
        own[r.conv].append(r)
    assert [(r.kind, r.call_id) for r in own["a"]] == [("call", "z"), ("result", "z"), ("call", "x"), ("result", "x"), ("call", "y")]
    assert [r.errors for r in own["a"]] == ["missing text", "", "", "", "limit is not integer; no result"]
    assert own["a"][4].json == '{"arguments":{"limit":"no","word":"éA"},"id":"y","name":"find_word","needs":["x"],"type":"call"}'
    assert own["a"][1].json == '{"content":"r\\"z","id":"z","type":"result"}'
    assert [(r.kind, r.call_id) for r in own["b"]] == [("call", "r"), ("result", "r"), ("call", "p"), ("call", "q"), ("result", "who")]
    assert [r.errors for r in own["b"]] == [
        "missing text; words is not integer; needs an unknown call",
        "",
        "unknown more; waits for itself; no result",
        "arguments are not an object; waits for itself; no result",
        "no call",
    ]
    assert [r.repeats for r in own["b"]] == [1, 1, 0, 0, 0] and json.loads(own["b"][1].json)["content"] == "first"
    assert '"more":[1,{"a":2,"b":1}]' in own["b"][2].json
    assert len(own[""]) == 3 and {r.repeats for r in own[""]} == {0, 1}


def test_empty(spark):
    assert linked(spark, [], []) == []


def test_a_long_chain_backwards(spark):
    n = 14
    calls = [("c", i, f"k{i}", "t", "{}", [f"k{i + 1}"] if i < n - 1 else []) for i in range(n)]
    calls += [("d", i, f"k{i}", "t", "{}", [f"k{i - 1}"] if i else []) for i in range(2000)]
    got = linked(spark, calls, [], {"t": {}})
    assert [r.call_id for r in got if r.conv == "c"] == [f"k{i}" for i in reversed(range(n))]
    assert [r.call_id for r in got if r.conv == "d"] == [f"k{i}" for i in range(2000)]
    assert {r.errors for r in got} == {"no result"}


def plain_levels(calls, needs):
    """calls: {id: position}; needs: {id: set of known ids}. The level of each call, None for those that wait for themselves."""
    level = {}
    while True:
        ready = [c for c in calls if c not in level and all(n in level for n in needs[c])]
        if not ready:
            return {c: level.get(c) for c in calls}
        for c in ready:
            level[c] = max((level[n] + (calls[n] >= calls[c]) for n in needs[c]), default=0)


def test_levels_against_a_plain_loop(spark):
    rng = random.Random(7)
    rows, wanted = [], {}
    for k in range(60):
        n = rng.choice([1, 2, 3, 5, 9, 16])
        calls = {f"k{i}": rng.randrange(2 * n) for i in range(n)}
        reach = rng.choice([1, 2, n])
        names = list(calls)
        needs = {c: {names[max(0, min(n - 1, i + rng.randint(-reach, reach)))] for _ in range(rng.choice([0, 1, 1, 2, 3]))} for i, c in enumerate(names)}
        rows += [(f"v{k}", at, c, "t", "{}", sorted(needs[c])) for c, at in calls.items()]
        level = plain_levels(calls, needs)
        late = any(calls[m] >= calls[c] for c in calls for m in needs[c])
        last = max((x for x in level.values() if x is not None), default=0) + 1
        order = sorted(calls, key=lambda c: ((last if level[c] is None else level[c]) if late else 0, calls[c], "=" + c))
        wanted[f"v{k}"] = [(c, level[c] is None) for c in order]
    got = defaultdict(list)
    for r in linked(spark, rows, [], {"t": {}}):
        got[r.conv].append((r.call_id, "waits for itself" in r.errors))
    assert got == wanted
    assert sum(c for own in wanted.values() for _, c in own) > 20


@pytest.mark.parametrize("chain", [True, False])
def test_long_chains_and_circles_take_few_rounds(spark, monkeypatch, chain):
    if chain:
        n = 10_000
        calls = [("c", i, f"k{i}", "t", "{}", [f"k{i + 1}"] if i < n - 1 else []) for i in range(n)]
    else:
        n = 1000
        calls = [("c", i, f"k{i}", "t", "{}", [f"k{(i + 1) % n}"]) for i in range(n)]
        calls += [("c", n + i, f"p{i}", "t", "{}", [f"p{i + 1}"] if i % 2 == 0 else []) for i in range(2000)]
    written = []
    own = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, name: written.append(name) or own(df, name))
    got = linked(spark, calls, [], {"t": {}})
    assert len(written) <= 40
    if chain:
        assert [r.call_id for r in got] == [f"k{i}" for i in reversed(range(n))]
    else:
        assert [r.call_id for r in got[2000:]] == [f"k{i}" for i in range(n)]
        assert all(("waits for itself" in r.errors) == (r.call_id[0] == "k") for r in got)


def test_very_long_arguments_and_texts(spark):
    words = "word " * 400_000
    calls = [("a", 0, "x", "find_word", json.dumps({"word": words}), ["y"]), ("a", 1, "y", "find_word", words, None)]
    got = linked(spark, calls, [("a", 2, "x", words)])
    assert [(r.kind, r.call_id) for r in got] == [("call", "y"), ("call", "x"), ("result", "x")]
    assert json.loads(got[1].json)["arguments"]["word"] == words == json.loads(got[2].json)["content"] == json.loads(got[0].json)["text"]


def test_given_conversations(spark):
    turns = table(spark, "/root/testdata/sf0.01", "conversations")
    calls, results = chat.tool_events(turns)
    rows = chat.link_tool_calls(calls, results, chat.TOOLS).collect()
    wanted = {(c.conv, c.call_id): c for c in calls.collect()}
    answers = {(r.conv, r.call_id): r for r in results.collect()}
    assert len(rows) == len(wanted) + len(answers)
    seen = defaultdict(dict)
    for r in sorted(rows, key=lambda r: (r.conv, r.step)):
        assert r.step == len(seen[r.conv])
        seen[r.conv][r.kind, r.call_id] = r
        value = json.loads(r.json)
        assert r.json == json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        if r.kind == "call":
            call = wanted[r.conv, r.call_id]
            for need in call.needs:
                if (r.conv, need) in wanted and "waits for itself" not in r.errors:
                    assert ("call", need) in seen[r.conv]
            assert ("no result" in r.errors) == ((r.conv, r.call_id) not in answers)
            assert ("not an object" in r.errors) == call.arguments.startswith("{broken")
        else:
            assert value["content"] == answers[r.conv, r.call_id].content
    errors = {e for r in rows for e in r.errors.split("; ")}
    assert {"missing text", "arguments are not an object"} <= errors


def test_turns_without_a_number_stand_for_themselves(spark):
    rows = [("x", None, "user", "one request"), ("x", None, "user", "another request"), ("x", None, "assistant", "a result"), ("x", 0, "system", "s"), ("x", 1, None, "t"), ("x", 2, "user", "third")]
    calls, results = chat.tool_events(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    assert sorted(str(r.call_id) for r in calls.collect()) == ["None", "None", "call-2"]
    assert [r.call_id for r in results.collect()] == [None]
    assert chat.link_tool_calls(calls, results, chat.TOOLS).count() == 4
