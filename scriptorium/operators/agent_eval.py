"""Evaluation of agent runs.

Results: id, name, category, activated, passed, skipped, num_turns, total_cost_usd, duration_ms,
input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, tool_calls,
tools_called MAP<STRING,INT>, scores MAP<STRING,DOUBLE>.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .evaluate import NO_CATEGORY

#: Errors of the infrastructure, the least change that a trend shows, characters kept of a written file.
INFRASTRUCTURE = r"(?i)529|overload|API Error.*Repeated"
LEAST_CHANGE, MOST_FILE_CHARS = 0.001, 5000
TOOL_PREFIX = "mcp__"


def _mean(value: Column | str) -> Column:
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6)


def _share(part: Column, whole: Column | None = None) -> Column:
    n = F.count("*") if whole is None else F.count_if(whole)
    return F.round(F.when(n > 0, F.count_if(part if whole is None else part & whole) / n).otherwise(0.0), 6)


RATES = lambda: [_share(F.col("activated")).alias("activation_rate"), _share(F.col("passed"), ~F.coalesce("skipped", F.lit(False))).alias("pass_rate")]


def summary(results: DataFrame) -> DataFrame:
    """One row; medians lie between the middle values and are exact, in memory that doesn't grow with the results."""
    middle = ranks.quantiles(results, {"num_turns": {"median_turns": ("between", 0.5)}, "duration_ms": {"median_duration_ms": ("between", 0.5)}})
    medians = middle.select(F.coalesce("median_turns", F.lit(0.0)).alias("median_turns"), F.round(F.coalesce("median_duration_ms", F.lit(0.0)), 6).alias("median_duration_ms"))
    one = results.agg(
        F.count("*").alias("total_scenarios"),
        *RATES(),
        _mean("num_turns").alias("avg_turns"),
        _mean("total_cost_usd").alias("avg_cost_usd"),
        F.round(F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
        _mean("duration_ms").alias("avg_duration_ms"),
        *(_mean(F.coalesce(c, F.lit(0))).alias(f"avg_{c}") for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "tool_calls")),
    )
    columns = [*one.columns[:4], "median_turns", *one.columns[4:7], "median_duration_ms", *one.columns[7:]]
    return one.crossJoin(F.broadcast(medians)).select(*columns)  # one row each


def by_category(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("category", F.lit(NO_CATEGORY)).alias("category")).agg(F.count("*").alias("scenario_count"), *RATES(), _mean("num_turns").alias("avg_turns"), _mean("total_cost_usd").alias("avg_cost_usd"))


def tool_usage(results: DataFrame, prefix: str = "") -> DataFrame:
    """tool and calls; with a prefix only the tools of one server."""
    rows = results.select(F.explode("tools_called").alias("tool", "calls"))
    rows = rows.where(F.startswith("tool", F.lit(prefix))) if prefix else rows
    return rows.groupBy("tool").agg(F.sum("calls").alias("calls"))


def score_means(results: DataFrame) -> DataFrame:
    """metric and its mean over the results that have it."""
    return results.select(F.explode("scores").alias("metric", "value")).groupBy("metric").agg(_mean("value").alias("mean"))


def outcomes(with_tool: DataFrame, without: DataFrame) -> DataFrame:
    """id and outcome of the scenarios that both runs have, with the differences."""
    both = with_tool.alias("w").join(without.alias("o"), F.col("w.id") == F.col("o.id"))
    w, o = F.col("w.passed"), F.col("o.passed")
    outcome = F.when(w & ~o, "gained").when(~w & o, "lost").when(w & o, "both_pass").otherwise("both_fail")
    return both.select(F.col("w.id").alias("id"), outcome.alias("outcome"), *((F.col(f"w.{c}") - F.col(f"o.{c}")).alias(f"{c}_delta") for c in ("num_turns", "total_cost_usd", "duration_ms")))


def comparison(with_tool: DataFrame, without: DataFrame) -> DataFrame:
    """metric and difference of the two runs' summaries, and of the score means that both have."""
    metrics = ("pass_rate", "avg_turns", "avg_cost_usd", "total_cost_usd", "avg_duration_ms")
    one = summary(with_tool).select(*(F.col(m).alias(f"w_{m}") for m in metrics)).crossJoin(summary(without).select(*(F.col(m).alias(f"o_{m}") for m in metrics)))  # one row each
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"w_{m}") - F.col(f"o_{m}")).alias("delta")) for m in metrics))).alias("x")).select("x.*")
    scores = score_means(with_tool).alias("w").join(score_means(without).alias("o"), "metric").select(F.concat(F.lit("score:"), F.col("metric")).alias("metric"), (F.col("w.mean") - F.col("o.mean")).alias("delta"))
    return rows.unionByName(scores).select("metric", F.round("delta", 6).alias("delta"))


def trend(current: DataFrame, previous: DataFrame, lower_is_better: Sequence[str]) -> DataFrame:
    """metric (metric, value) of two runs, the change and whether it is for the better."""
    rows = current.alias("c").join(previous.alias("p"), "metric").select("metric", F.col("p.value").alias("previous"), F.col("c.value").alias("current"))
    change = F.col("current") - F.col("previous")
    better = F.when(F.col("metric").isin(list(lower_is_better)), change < 0).otherwise(change > 0)
    return rows.select("*", F.round(change, 6).alias("change"), F.when(F.abs(change) < LEAST_CHANGE, "same").when(better, "better").otherwise("worse").alias("verdict"))


def changed_scenarios(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Scenarios, by id or else name, that pass now and didn't, or the other way round."""
    key = lambda df: df.select(F.coalesce("id", "name").alias("key"), "passed")
    both = key(current).alias("c").join(key(previous).alias("p"), "key")
    return both.where(F.col("c.passed") != F.col("p.passed")).select("key", F.when(F.col("c.passed"), "fixed").otherwise("broken").alias("change"))


def latest_before(runs: DataFrame) -> DataFrame:
    """The latest run of each suite, by name in binary order (suite, run)."""
    return runs.withColumn("nth", F.row_number().over(Window.partitionBy("suite").orderBy(F.desc("run")))).where("nth = 1").drop("nth")


# ------------------------------------------------------------------ verdicts and traces
def verdict(assertions: Column, errors: Column) -> tuple[Column, Column]:
    """(passed, skipped) from ARRAY<STRUCT<soft, passed>> and ARRAY<STRING>: all hard assertions hold and there is one; infrastructure errors skip."""
    hard = F.filter(assertions, lambda a: ~F.coalesce(a["soft"], F.lit(False)))
    broken = F.exists(errors, lambda e: e.rlike(INFRASTRUCTURE))
    return (F.size(hard) > 0) & F.forall(hard, lambda a: a["passed"]) & ~broken, broken


def assertion(kind: str, value: str, answer: Column, flags: str = "") -> Column:
    """Whether an answer fulfils a text assertion: contains, not_contains or matches."""
    if kind in ("contains", "not_contains"):
        held = F.contains(answer, F.lit(value))
        return held if kind == "contains" else ~held
    if kind == "matches":
        inline = "".join(f for f in flags if f in "ims")
        return answer.rlike(f"(?{inline}){value}" if inline else value)
    raise ValueError(f"Unknown assertion '{kind}'")


def file_assertion(kind: str, path: str, value: str, files: Column, flags: str = "") -> Column:
    """Whether a written file (MAP<path, content>) fulfils file_contains or file_matches; a file that isn't there doesn't."""
    if kind not in ("file_contains", "file_matches"):
        raise ValueError(f"Unknown assertion '{kind}'")
    return F.coalesce(assertion("contains" if kind == "file_contains" else "matches", value, files[path], flags), F.lit(False))


def script_assertion(command: str, folder: str, when_env: str | None = None, timeout: float = 30.0) -> bool | None:
    """Whether a command in a folder ends with 0 in time; None, not run, if the variable when_env is unset."""
    if when_env and not os.environ.get(when_env):
        return None
    try:
        return subprocess.run(command, shell=True, cwd=folder, capture_output=True, timeout=timeout, check=False).returncode == 0
    except subprocess.TimeoutExpired:
        return False


def changed_assertions(a: DataFrame, b: DataFrame) -> DataFrame:
    """id and key of the assertions whose result differs between two runs (id, key, passed)."""
    return a.alias("a").join(b.alias("b"), ["id", "key"]).where(F.col("a.passed") != F.col("b.passed")).select("id", "key", F.col("a.passed").alias("passed_now"))


def tool_volume(trace: Column, tools: Sequence[str]) -> tuple[Column, Column]:
    """(calls, characters of results) of some tools in ARRAY<STRUCT<name, result>>."""
    mine = F.filter(trace, lambda t: t["name"].isin(list(tools)))
    return F.size(mine), F.aggregate(mine, F.lit(0), lambda n, t: n + F.length(F.coalesce(t["result"], F.lit(""))))


def paired(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """Tool calls (scenario, seq, call_id, name) with `result`, the first answer (scenario, seq, call_id, result) to each; null without one."""
    first = answers.groupBy("scenario", "call_id").agg(F.min_by("result", "seq").alias("result"))
    return calls.join(first, ["scenario", "call_id"], "left").select(*calls.columns, "result")


def volumes(pairs: DataFrame, prefix: str = TOOL_PREFIX) -> DataFrame:
    """scenario, calls of a server's tools and characters of their results."""
    mine = pairs.where(F.startswith("name", F.lit(prefix)))
    return mine.groupBy("scenario").agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.length("result")), F.lit(0)).alias("result_chars"))


def included(scenarios: DataFrame, wanted: str | None) -> DataFrame:
    """Scenarios whose id is in a comma-separated list; all of them without one, an error if none is left."""
    ids = [x.strip() for x in (wanted or "").split(",") if x.strip()]
    if not ids:
        return scenarios
    found = scenarios.where(F.col("id").isin(ids))
    if not found.limit(1).count():
        raise ValueError(f"No scenario matches '{wanted}'")
    return found


def usage_chart(usage: DataFrame, width: int = 40) -> list[str]:
    """Lines of a bar chart of tools by calls, most first."""
    rows = usage.orderBy(F.desc("calls"), "tool").collect()  # a row for each tool
    most = max((r["calls"] for r in rows), default=0)
    wide = max((len(r["tool"]) for r in rows), default=0)
    return [f"{r['tool']:<{wide}}  {'█' * max(1, round(width * r['calls'] / most))} {r['calls']}" for r in rows if r["calls"]]


_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")


def plain(text: str) -> str:
    """Text without terminal colours."""
    return _ANSI.sub("", text)


def padded(text: str, width: int) -> str:
    return text + " " * max(0, width - len(plain(text)))


def wrapped(text: str, width: int) -> list[str]:
    """Lines of at most `width` visible characters, broken at spaces where there are any."""
    lines, line = [], ""
    for word in text.split():
        while len(plain(word)) > width:
            if line:
                lines.append(line)
                line = ""
            lines.append(word[:width])
            word = word[width:]
        if line and len(plain(line)) + 1 + len(plain(word)) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*lines, line] if line or not lines else lines


def spoken(ms: float) -> str:
    """A duration as people write it."""
    if round(ms) < 1000:
        return f"{round(ms)}ms"
    if round(ms / 1000, 1) < 60:
        return f"{ms / 1000:.1f}s"
    minutes, seconds = divmod(round(ms / 1000), 60)  # rounded first, so that no 60 seconds are left
    return f"{minutes}m {seconds}s"


def token_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """usage (model, input_tokens, cached_tokens, output_tokens) with cost_usd; prices (by million tokens) of unknown models are 0."""
    rows = usage.join(pricing, "model", "left")
    cost = reduce(lambda a, b: a + b, ((n * F.coalesce(p, F.lit(0.0))) for n, p in ((F.col("input_tokens") - F.col("cached_tokens"), F.col("input_price")), (F.col("cached_tokens"), F.col("cached_price")), (F.col("output_tokens"), F.col("output_price"))))) / 1e6
    return rows.select(*usage.columns, F.round(cost, 6).alias("cost_usd"))


#: Item types of an event stream and the tools they stand for.
EVENT_TOOLS = {"command_execution": "Bash", "web_search": "WebSearch", "todo_list": "TodoWrite", "collab_tool_call": "Collab"}
EVENT_SCHEMA = "type string, item struct<id:string,type:string,text:string,server:string,tool:string,changes:array<struct<path:string,kind:string>>>, usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>"


def events(lines: DataFrame) -> DataFrame:
    """Normalised events of (scenario, seq, line): kind init, text, tool_call, error or done, tool and tokens. Lines that aren't JSON are left out."""
    rows = lines.select("scenario", "seq", F.from_json("line", EVENT_SCHEMA).alias("e")).where(F.col("e.type").isNotNull())
    kind, item = F.col("e.type"), F.col("e.item.type")
    edits = F.forall(F.coalesce(F.col("e.item.changes"), F.array()), lambda c: c["kind"] == "add")
    tool = F.when(item == "mcp_tool_call", F.concat(F.lit(TOOL_PREFIX), F.col("e.item.server"), F.lit("__"), F.col("e.item.tool"))).when(item == "file_change", F.when(edits, "Write").otherwise("Edit"))
    for k, v in EVENT_TOOLS.items():
        tool = tool.when(item == k, v)
    done = kind == "item.completed"
    name = F.when(kind == "thread.started", "init").when(done & (item == "agent_message"), "text").when(done & tool.isNotNull(), "tool_call").when((kind == "error") | (done & (item == "error")), "error").when(kind == "turn.completed", "done")
    u = F.col("e.usage")
    return rows.select("scenario", "seq", name.alias("kind"), F.when(done, tool).alias("tool"), F.when(done & (item == "agent_message"), F.col("e.item.text")).alias("text"), u["input_tokens"].alias("input_tokens"), u["cached_input_tokens"].alias("cached_tokens"), u["output_tokens"].alias("output_tokens")).where("kind is not null")


def folded(normalised: DataFrame) -> DataFrame:
    """A row for each scenario: turns, last answer, tool calls and token sums of its events."""
    ordered = F.max_by("text", F.when(F.col("kind") == "text", F.col("seq")))
    rows = normalised.groupBy("scenario").agg(F.count_if(F.col("kind") == "text").alias("num_turns"), ordered.alias("final_answer"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")), F.count_if(F.col("kind") == "error").alias("errors"))
    calls = normalised.where("tool is not null").groupBy("scenario", "tool").count().groupBy("scenario").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "count")))).alias("tools_called"))
    return rows.join(calls, "scenario", "left")


def written_files(trace: Column, workspace: str) -> Column:
    """Distinct paths in the workspace that Write or Edit calls of ARRAY<STRUCT<name, path>> name."""
    mine = F.filter(trace, lambda t: t["name"].isin("Write", "Edit") & F.startswith(t["path"], F.lit(workspace.rstrip("/") + "/")))
    return F.array_distinct(F.transform(mine, lambda t: t["path"]))


#: Languages by the ending of a file's name.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "cs": "csharp", "kt": "kotlin", "swift": "swift", "sh": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "sql": "sql"}


def file_contents(workspace: str, paths: Sequence[str], most: int = MOST_FILE_CHARS) -> list[dict]:
    """path, content (its first `most` characters), language and whether it was cut, of files of a workspace that are there."""
    out = []
    root = os.path.realpath(workspace)
    for p in paths:
        full = os.path.realpath(os.path.join(root, p))
        if not full.startswith(root + os.sep) or not os.path.isfile(full):
            continue
        with open(full, encoding="utf-8", errors="replace") as f:
            text = f.read(most + 1)
        ending = os.path.splitext(full)[1][1:].lower()
        out.append({"path": os.path.relpath(full, root), "content": text[:most], "language": LANGUAGES.get(ending, ending), "cut": len(text) > most})
    return out


def scores_of(raw: Column, metrics: Sequence[str]) -> Column:
    """MAP of the numeric feedback values of MAP<STRING,STRING>, null if there is none."""
    found = F.map_filter(F.transform_values(raw, lambda k, v: v.try_cast("double")), lambda k, v: k.isin(list(metrics)) & v.isNotNull())
    return F.when(F.size(found) > 0, found)


def report_rows(summary_row: Mapping[str, object]) -> list[str]:
    """A markdown table of a summary."""
    return ["| Metric | Value |", "| --- | ---: |", *(f"| {k} | {v} |" for k, v in summary_row.items())]


def listed_tools(lines: DataFrame, request_id: int = 2) -> DataFrame:
    """Names of the tools in a server's answer to a request, from lines (line) of JSON-RPC; other lines are left out."""
    answer = F.from_json("line", "id int, result struct<tools:array<struct<name:string>>>")
    return lines.select(answer.alias("a")).where(F.col("a.id") == request_id).select(F.explode("a.result.tools.name").alias("tool")).distinct()
