"""Events of both kinds of agents, their fold in batch, and the same fold as a stream with state."""

import json
import random

import pytest

from scriptorium.operators import traces
from scriptorium.streaming import fold

LINES = "scenario string, seq bigint, line string, ms bigint"


def item(kind, **more):
    return json.dumps({"type": "item.completed", "item": {"type": kind, **more}})


def message(kind, *blocks, **more):
    return json.dumps({"type": kind, "message": {"content": list(blocks), **more}})


def events_of(spark, *lines):
    df = spark.createDataFrame([("s", i, x, 10 * i) for i, x in enumerate(lines)], LINES)
    return [(r.seq, r.part, r.kind, r.call_id, r.tool, r.text) for r in traces.events(df).orderBy("seq", "part").collect()]


def test_items(spark):
    got = events_of(
        spark,
        "no json",
        json.dumps({"type": "thread.started"}),
        item("agent_message", text="hello"),
        item("mcp_tool_call", id="i1", server="docs", tool="search", result={"content": [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}),
        item("mcp_tool_call", id="i2", tool="plain", result="as is"),
        item("command_execution", command="ls", aggregated_output="a b"),
        item("file_change", id="f", changes=[{"path": "x.py", "kind": "add"}, {"path": "y.py", "kind": "update"}]),
        item("web_search", query="q"),
        item("collab_tool_call", tool="ask", status="done"),
        item("todo_list", items=[{"text": "a", "completed": True}, {"text": "b", "completed": False}]),
        item("error", message="odd"),
        json.dumps({"type": "error", "message": "broken"}),
        json.dumps({"type": "turn.failed", "error": {"message": "late"}}),
        json.dumps({"type": "turn.completed", "usage": {"input_tokens": 5, "cached_input_tokens": 2, "output_tokens": 3}}),
    )
    assert got == [
        (1, 0, "init", None, None, None),
        (2, 0, "text", None, None, "hello"),
        (3, 0, "tool_call", "i1", "mcp__docs__search", None),
        (3, 1, "tool_result", "i1", None, "one\ntwo"),
        (4, 0, "tool_call", "i2", "plain", None),
        (4, 1, "tool_result", "i2", None, "as is"),
        (5, 0, "tool_call", "line-5", "Bash", None),
        (5, 1, "tool_result", "line-5", None, "a b"),
        (6, 0, "tool_call", "f#0", "Write", None),
        (6, 1, "tool_result", "f#0", None, "(add: x.py)"),
        (6, 2, "tool_call", "f#1", "Edit", None),
        (6, 3, "tool_result", "f#1", None, "(update: y.py)"),
        (7, 0, "tool_call", "line-7", "WebSearch", None),
        (7, 1, "tool_result", "line-7", None, traces.SEARCHED),
        (8, 0, "tool_call", "line-8", "CollabTool:ask", None),
        (8, 1, "tool_result", "line-8", None, "done"),
        (9, 0, "text", None, None, "[plan]\n[x] a\n[ ] b"),
        (10, 0, "error", None, None, "odd"),
        (10, 1, "text", None, None, traces.FAILED + "odd"),
        (11, 0, "error", None, None, "broken"),
        (11, 1, "text", None, None, traces.FAILED + "broken"),
        (12, 0, "error", None, None, "late"),
        (12, 1, "text", None, None, traces.FAILED + "late"),
        (13, 0, "usage", None, None, None),
    ]


RUN = [
    json.dumps({"type": "system", "subtype": "init"}),
    message("assistant", {"type": "text", "text": "let me look"}, {"type": "tool_use", "id": "t1", "name": "mcp__docs__search"}, {"type": "text", "text": "and more"}, usage={"input_tokens": 10, "output_tokens": 4, "cache_read_input_tokens": 1}),
    message("assistant", {"type": "tool_use", "id": "t2", "name": "Bash"}),
    message("user", {"type": "tool_result", "tool_use_id": "t2", "content": "plain"}),
    message("user", {"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "found it"}]}),
    message("assistant", {"type": "text", "text": ""}, {"type": "text", "text": "the answer"}, usage={"input_tokens": 20, "output_tokens": 6}),
    message("assistant", {"type": "tool_use", "id": "t3", "name": "Bash"}),
]
DONE = json.dumps({"type": "result", "subtype": "success", "result": "final", "num_turns": 7, "total_cost_usd": 0.5, "duration_api_ms": 900, "usage": {"input_tokens": 0, "output_tokens": 99}})


def folded(spark, lines):
    return traces.folded(traces.events(spark.createDataFrame([("s", i, x, 10 * i) for i, x in enumerate(lines)], LINES))).first()


def test_a_run_without_and_with_its_report(spark):
    r = folded(spark, RUN)
    assert (r.num_turns, r.final_answer, r.input_tokens, r.output_tokens, r.cached_tokens, r.cost_usd, r.errors) == (2, "the answer", 30, 10, 1, 0.0, 0)
    assert r.tools_called == {"Bash": 2, "mcp__docs__search": 1}
    assert (r.calls, r.answered, r.pending, r.result_chars, r.call_ms) == (3, 2, 1, len("plain") + len("found it"), 10 + 30)
    r = folded(spark, [*RUN, DONE])
    assert (r.num_turns, r.final_answer, r.input_tokens, r.output_tokens, r.cost_usd, r.api_ms) == (7, "final", 30, 99, 0.5, 900)  # zeros don't win
    r = folded(spark, [*RUN, json.dumps({"type": "result", "subtype": "error_max_turns", "num_turns": 9})])
    assert (r.num_turns, r.final_answer, r.errors) == (9, "the answer", 1)
    r = folded(spark, [*RUN, json.dumps({"type": "result", "subtype": "error", "errors": ["a", "b"]})])
    assert (r.num_turns, r.errors) == (2, 2)


def random_run(g, n):
    out, open_calls = [], []
    for k in range(n):
        x = g.random()
        if x < 0.25:
            out.append(message("assistant", {"type": "text", "text": f"t{k}"}, usage={"input_tokens": g.randrange(9), "output_tokens": 1}))
        elif x < 0.5:
            open_calls.append(f"c{k if g.random() < 0.9 else 0}")
            out.append(message("assistant", {"type": "tool_use", "id": open_calls[-1], "name": g.choice(["Bash", "Read"])}))
        elif x < 0.75 and open_calls:
            out.append(message("user", {"type": "tool_result", "tool_use_id": g.choice(open_calls), "content": "r" * g.randrange(20)}))
        elif x < 0.85:
            out.append(item("command_execution", aggregated_output="o" * g.randrange(5)))
        elif x < 0.9:
            out.append(g.choice(["{", "null", "[]", json.dumps({"type": "error", "message": "m"})]))
        else:
            out.append(json.dumps({"type": "result", "subtype": g.choice(["success", "error"]), "result": f"end{k}", "num_turns": g.randrange(4), "usage": {"input_tokens": g.randrange(3), "output_tokens": 0}}))
    return out


class Entries:
    """State that counts how often it is asked."""

    def __init__(self, asked):
        self.asked, self.entries = asked, {}

    def __getattr__(self, name):
        def call(*a):
            self.asked.append(name)
            if name in ("update", "updateValue"):
                self.entries[a[0] if len(a) > 1 else ()] = a[-1]
            key = a[0] if a else ()
            return {"exists": () in self.entries, "containsKey": key in self.entries, "iterator": iter(self.entries.items())}.get(name, self.entries.get(key))

        return call


def test_a_scenario_takes_few_reads_and_writes_of_the_state(spark):
    asked = []
    made = fold.Fold()
    made.value, made.seen, made.tools, made.waiting = (Entries(asked) for _ in range(4))
    lines = [message("assistant", {"type": "tool_use", "id": f"c{i // 2}", "name": "Bash"}) if i % 2 == 0 else message("user", {"type": "tool_result", "tool_use_id": f"c{i // 2}", "content": "xx"}) for i in range(40)]
    rows = traces.events(spark.createDataFrame([("s", i, x, 10 * i) for i, x in enumerate(lines)], LINES)).toPandas()
    for some in (rows, rows.iloc[:10]):
        del asked[:]
        (got,) = [r for b in made.handleInputRows(("s",), iter([some]), None) for r in b.to_dict("records")]
        assert (got["calls"], got["answered"], got["result_chars"], got["tools_called"]) == (20, 20, 40, {"Bash": 20})
        assert len(asked) < 10


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_batch_agree(spark, tmp_path, seed):
    """Lines in any order, many twice and in other batches, with a restart in between."""
    g = random.Random(seed)
    lines = [(f"s{s}", i, x, 7 * i + s) for s in range(6) for i, x in enumerate(random_run(g, 40))]
    some = lines + g.sample(lines, 60)
    g.shuffle(some)
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    size = len(some) // 6 + 1
    for step in range(6):
        spark.createDataFrame(some[step * size : (step + 1) * size], LINES).coalesce(1).write.mode("append").json(f"{inbox}/step={step}")
        if step in (1, 5):  # two runs, of two and of four batches
            stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(f"{inbox}/*")
            fold.start(stream, target, checkpoint).awaitTermination()
    want = {r.scenario: r.asDict() for r in traces.folded(traces.events(spark.createDataFrame(lines, LINES))).collect()}
    got = {r.scenario: r.asDict() for r in fold.latest(spark, target).collect()}
    for r in got.values():
        r.pop("events")
    assert got == want


def test_stream_and_batch_agree_on_more_calls_than_a_value_keeps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fold, "FEW", 3)
    test_stream_and_batch_agree(spark, tmp_path, 2)


def test_pairs_of_events(spark):
    df = spark.createDataFrame([("s", i, x, 10 * i) for i, x in enumerate(RUN)], LINES)
    got = {r.call_id: (r.tool, r.result, r.ms) for r in traces.pairs(traces.events(df)).collect()}
    assert got == {"t1": ("mcp__docs__search", "found it", 30), "t2": ("Bash", "plain", 10), "t3": ("Bash", None, None)}
    assert traces.folded(traces.events(df.where("false"))).collect() == []
