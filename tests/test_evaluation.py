import pytest
from pyspark.sql import functions as F

from scriptorium.operators import agent_eval, evaluate

CASES = "expected string, ranked array<string>, rounds int, name string, category string"


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([("a", ["a", "b", "c"], 1, "one", "x"), ("b", ["c", "b", "a"], 2, "two", None), ("x", ["a", "b", "c"], 4, "three", "x")], CASES)


def test_summary(cases):
    r = evaluate.summary(cases).first()
    assert (r.mrr_at_5, r.hit_at_5, r.avg_rounds) == (0.5, 0.666667, 2.333333)
    assert r.ndcg_at_5 == pytest.approx((1 + 0.63092975) / 3, abs=1e-6)
    none = evaluate.summary(cases.where("false")).first()
    assert list(none) == [0.0, 0.0, 0.0, 0.0]
    assert {(r.category, r.case_count) for r in evaluate.by_category(cases).collect()} == {("x", 2), ("uncategorized", 1)}


@pytest.mark.parametrize(("values", "p50", "p95"), [([5, 10, 20, 40], 10, 40), ([2, 3, 9], 3, 9), ([], 0, 0)])
def test_nearest_rank(spark, values, p50, p95):
    df = spark.createDataFrame([(float(v),) for v in values], "ms double")
    r = evaluate.latency(df, "ms").first()
    assert (r.p50, r.p95) == (p50, p95)


def test_flips_and_delta(spark, cases):
    before = spark.createDataFrame([("a", ["z"], 1, "one", None), ("x", ["x"], 1, "three", None)], CASES)
    assert {tuple(r) for r in evaluate.flips(cases, before).collect()} == {("one", "improvement", "N/F", "1"), ("three", "regression", "1", "N/F")}
    d = {r.metric: r.delta for r in evaluate.delta(evaluate.summary(cases), evaluate.summary(before)).collect()}
    assert d["mrr_at_5"] == 0.0


def test_rounds(spark):
    df = spark.createDataFrame([(1,), (5,), (6,), (16,), (None,)], "rank int")
    assert [r.rounds for r in evaluate.paged_rounds(df, 5, 3).collect()] == [1, 1, 2, 4, 4]


def test_costs(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 400_000, 100_000), ("?", 5, 5, 5)], "model string, input_tokens long, cached_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 0.5, 10.0)], "model string, input_price double, cached_price double, output_price double")
    assert {r.model: r.cost_usd for r in agent_eval.token_cost(usage, prices).collect()} == {"m": 2.4, "?": 0.0}


def test_agent_summary(spark):
    schema = "id string, name string, category string, activated boolean, passed boolean, skipped boolean, num_turns int, total_cost_usd double, duration_ms double, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, tool_calls int, tools_called map<string,int>, scores map<string,double>"
    rows = [("1", "a", "x", True, True, False, 2, 0.1, 10.0, 1, 1, None, None, 1, {"mcp__d__s": 2, "Bash": 1}, {"q": 4.0}), ("2", "b", None, False, False, True, 3, 0.3, 30.0, 3, 3, 2, None, 0, {"Bash": 1}, None)]
    r = agent_eval.summary(df := spark.createDataFrame(rows, schema)).first()
    assert (r.activation_rate, r.pass_rate, r.median_turns, r.total_cost_usd, r.avg_cache_read_tokens) == (0.5, 1.0, 2.5, 0.4, 1.0)
    assert {tuple(x) for x in agent_eval.tool_usage(df).collect()} == {("mcp__d__s", 2), ("Bash", 2)}
    assert {tuple(x) for x in agent_eval.tool_usage(df, "mcp__d__").collect()} == {("mcp__d__s", 2)}
    assert {tuple(x) for x in agent_eval.score_means(df).collect()} == {("q", 4.0)}
    assert agent_eval.summary(df.where("false")).first().pass_rate == 0.0


def test_verdicts(spark):
    df = spark.createDataFrame([([(False, True), (True, False)], []), ([(True, True)], []), ([(False, True)], ["API Error: 529"])], "a array<struct<soft:boolean,passed:boolean>>, e array<string>")
    passed, skipped = agent_eval.verdict(F.col("a"), F.col("e"))
    assert [tuple(r) for r in df.select(passed, skipped).collect()] == [(True, False), (False, False), (False, True)]


def test_events(spark):
    lines = [
        '{"type":"thread.started"}',
        "garbage",
        '{"type":"item.completed","item":{"type":"mcp_tool_call","server":"docs","tool":"search"}}',
        '{"type":"item.completed","item":{"type":"file_change","changes":[{"path":"a","kind":"add"}]}}',
        '{"type":"item.completed","item":{"type":"agent_message","text":"first"}}',
        '{"type":"item.completed","item":{"type":"agent_message","text":"last"}}',
        '{"type":"turn.completed","usage":{"input_tokens":5,"cached_input_tokens":2,"output_tokens":1}}',
        '{"type":"turn.completed","usage":{"input_tokens":6,"output_tokens":1}}',
    ]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "scenario string, seq int, line string")
    r = agent_eval.folded(agent_eval.events(df)).first()
    assert (r.num_turns, r.final_answer, r.input_tokens, r.cached_tokens, r.output_tokens) == (2, "last", 11, 2, 2)
    assert r.tools_called == {"mcp__docs__search": 1, "Write": 1}


def test_trend(spark):
    a = spark.createDataFrame([("cost", 1.0), ("rate", 0.9), ("same", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("cost", 2.0), ("rate", 0.95), ("same", 1.0005)], "metric string, value double")
    assert {r.metric: r.verdict for r in agent_eval.trend(a, b, ["cost"]).collect()} == {"cost": "better", "rate": "worse", "same": "same"}


def test_listed_tools(spark):
    lines = spark.createDataFrame([('{"id":1,"result":{}}',), ("x",), ('{"id":2,"result":{"tools":[{"name":"a"},{"name":"b"}]}}',)], "line string")
    assert {r.tool for r in agent_eval.listed_tools(lines).collect()} == {"a", "b"}
