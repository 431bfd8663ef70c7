"""Agent runs as streams of events: normalisation of recorded lines, and the fold of a run's events into one row.

Lines are those that two kinds of agents print: one reports items once they are completed, the
other messages with blocks, where a call and its result are lines of their own. Both become the
same events, in the order of (seq, part): init, text, tool_call, tool_result, usage, error, done.

The fold doesn't depend on the order in which events arrive: of equal lines (scenario, seq) the
first counts, of several calls or results under one id those with the smallest place, of texts and
final reports those with the greatest. Totals of the final report win over added-up ones where they
aren't zero, and its answer wins if the run succeeded. `streaming.fold` keeps the same fold as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of tools, results and texts that stand for items without their own.
SEARCHED, PLAN, FAILED = "(web search result)", "[plan]\n", "[codex error] "
_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cached_input_tokens:bigint,cache_read_input_tokens:bigint>"
LINE = (
    "type string, subtype string, result string, message string, num_turns bigint, total_cost_usd double, duration_api_ms bigint, error struct<message:string>, errors array<string>, tool_use_result string, parent_tool_use_id string, "
    f"usage {_USAGE}, item struct<id:string,type:string,text:string,server:string,tool:string,command:string,aggregated_output:string,output:string,status:string,message:string,result:string,changes:array<struct<path:string,kind:string>>,items:array<struct<text:string,completed:boolean>>>"
)
MESSAGE = f"content string, usage {_USAGE}"
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,content:string>>"
FIELDS = {"kind": "string", "call_id": "string", "tool": "string", "text": "string", "turns": "bigint", "input_tokens": "bigint", "output_tokens": "bigint", "cached_tokens": "bigint", "cost_usd": "double", "api_ms": "bigint", "ok": "boolean"}
EVENT = f"struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>"


def _event(kind: str, **values: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *(values.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items() if k != "kind"))


def said(raw: Column) -> Column:
    """The text of a tool's result: the text blocks of its content, or what it is."""
    whole = F.from_json(raw, "struct<content:string>")["content"]
    blocks = lambda x: F.from_json(x, "array<struct<type:string,text:string>>")
    joined = lambda b: F.array_join(F.transform(F.filter(b, lambda x: (x["type"] == "text") & x["text"].isNotNull()), lambda x: x["text"]), "\n")
    inner, outer = blocks(whole), blocks(raw)
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")) & inner.isNotNull(), joined(inner)).when(F.startswith(F.ltrim(raw), F.lit("[")) & outer.isNotNull(), joined(outer)).otherwise(raw)


def _items(e: Column, seq: Column) -> Column:
    """Events of a completed item."""
    item = e["item"]
    key = F.coalesce(item["id"], F.concat(F.lit("line-"), seq.cast("string")))
    pair = lambda tool, result, k=key: F.array(_event("tool_call", call_id=k, tool=tool), _event("tool_result", call_id=k, text=result))
    none = F.array().cast(f"array<{EVENT}>")
    server = F.coalesce(item["server"], F.lit(""))
    tool = F.coalesce(item["tool"], F.lit("mcp_tool"))
    text = lambda x, turns=0: F.array(_event("text", text=x, turns=F.lit(turns)))
    changes = F.flatten(F.transform(F.coalesce(item["changes"], F.array().cast("array<struct<path:string,kind:string>>")), lambda c, i: pair(F.when(c["kind"] == "add", "Write").otherwise("Edit"), F.concat(F.lit("("), F.coalesce(c["kind"], F.lit("update")), F.lit(": "), F.coalesce(c["path"], F.lit("unknown")), F.lit(")")), F.concat(key, F.lit("#"), i.cast("string")))))
    plan = F.array_join(F.transform(item["items"], lambda t: F.concat(F.when(t["completed"], "[x] ").otherwise("[ ] "), F.coalesce(t["text"], F.lit("")))), "\n")
    failed = F.coalesce(item["message"], F.to_json(item))
    kind = item["type"]
    return (
        F.when(kind == "agent_message", text(item["text"], 1))
        .when((kind == "reasoning") & item["text"].isNotNull(), text(item["text"]))
        .when(kind == "mcp_tool_call", pair(F.when(server != "", F.concat(F.lit("mcp__"), server, F.lit("__"), tool)).otherwise(tool), F.coalesce(said(item["result"]), F.lit('""'))))
        .when(kind == "command_execution", pair(F.lit("Bash"), F.coalesce(item["aggregated_output"], item["output"], F.lit('""'))))
        .when(kind == "web_search", pair(F.lit("WebSearch"), F.lit(SEARCHED)))
        .when(kind == "file_change", changes)
        .when(kind == "collab_tool_call", pair(F.concat(F.lit("CollabTool:"), F.coalesce(item["tool"], F.lit("collab"))), F.coalesce(item["status"], F.lit("completed"))))
        .when((kind == "todo_list") & item["items"].isNotNull(), text(F.concat(F.lit(PLAN), plan)))
        .when(kind == "error", F.array(_event("error", text=failed), _event("text", text=F.concat(F.lit(FAILED), failed))))
        .otherwise(none)
    )


def _messages(e: Column) -> Column:
    """Events of a message's blocks."""
    message = F.from_json(e["message"], MESSAGE)
    blocks = F.coalesce(F.from_json(message["content"], BLOCKS), F.array().cast(BLOCKS))
    used = message["usage"]
    own = F.filter(blocks, lambda b: ((b["type"] == "text") & (b["text"] != "")) | (b["type"] == "tool_use"))
    first = F.array_position(F.transform(own, lambda b: b["type"]), "text") - 1  # the usage of a message counts with its first text

    def of(b: Column, i: Column) -> Column:
        counts = lambda c: F.when(i == first, c)
        text = _event("text", text=b["text"], turns=F.when((i == first) & used.isNotNull(), 1).otherwise(0), input_tokens=counts(used["input_tokens"]), output_tokens=counts(used["output_tokens"]), cached_tokens=counts(used["cache_read_input_tokens"]))
        return F.when(b["type"] == "text", text).otherwise(_event("tool_call", call_id=b["id"], tool=b["name"]))

    theirs = F.transform(own, of)
    answers = F.transform(F.filter(blocks, lambda b: (b["type"] == "tool_result") & b["tool_use_id"].isNotNull()), lambda b: _event("tool_result", call_id=b["tool_use_id"], text=F.coalesce(said(b["content"]), F.lit(""))))
    direct = F.array(_event("tool_result", call_id=e["parent_tool_use_id"], text=said(e["tool_use_result"])))
    return F.when(e["type"] == "assistant", theirs).when(e["tool_use_result"].isNotNull() & e["parent_tool_use_id"].isNotNull(), direct).otherwise(answers)


def events(lines: DataFrame) -> DataFrame:
    """scenario, seq, part, ms and the events of lines (scenario, seq, line and, if known, ms); lines that aren't JSON objects have none."""
    ms = F.col("ms").cast("long") if "ms" in lines.columns else F.lit(None).cast("long")
    e = F.col("e")
    failure = F.coalesce(F.when(e["message"].isNotNull() & ~F.startswith(e["message"], F.lit("{")), e["message"]), e["error"]["message"], F.col("line"))
    u = e["usage"]
    errors = F.transform(F.coalesce(e["errors"], F.array().cast("array<string>")), lambda x: _event("error", text=x))
    ok = e["subtype"] == "success"
    done = _event("done", text=F.when(ok, F.coalesce(e["result"], F.lit(""))), turns=e["num_turns"], input_tokens=u["input_tokens"], output_tokens=u["output_tokens"], cached_tokens=u["cache_read_input_tokens"], cost_usd=e["total_cost_usd"], api_ms=e["duration_api_ms"], ok=F.coalesce(ok, F.lit(False)))
    unsaid = F.when(F.size(errors) > 0, errors).otherwise(F.array(_event("error", text=F.concat(F.lit("Agent stopped: "), F.replace(F.coalesce(e["subtype"], F.lit("unknown")), F.lit("_"), F.lit(" "))))))
    of = (
        F.when(e["type"] == "item.completed", _items(e, F.col("seq")))
        .when(e["type"].isin("assistant", "user"), _messages(e))
        .when(e["type"] == "turn.completed", F.array(_event("usage", input_tokens=u["input_tokens"], output_tokens=u["output_tokens"], cached_tokens=u["cached_input_tokens"])))
        .when(e["type"].isin("turn.failed", "error"), F.array(_event("error", text=failure), _event("text", text=F.concat(F.lit(FAILED), failure))))
        .when(e["type"] == "result", F.when(F.coalesce(ok, F.lit(False)), F.array(done)).otherwise(F.concat(F.array(done), unsaid)))
        .when(e["type"].isin("thread.started", "system"), F.array(_event("init")))
    )
    rows = lines.select("scenario", "seq", "line", ms.alias("ms"), F.from_json("line", LINE).alias("e")).where(F.col("e.type").isNotNull())
    return rows.select("scenario", "seq", "ms", F.posexplode(of).alias("part", "event")).select("scenario", "seq", "part", "ms", "event.*")


#: What a run comes to.
FOLD = "num_turns bigint, final_answer string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, cost_usd double, api_ms bigint, errors bigint, tools_called map<string,bigint>, calls bigint, answered bigint, pending bigint, result_chars bigint, call_ms bigint"


def first_of_each(rows: DataFrame) -> DataFrame:
    """Events without repeated lines: of a place (scenario, seq, part) one event."""
    return rows.dropDuplicates(["scenario", "seq", "part"])


def pairs(rows: DataFrame) -> DataFrame:
    """scenario, call_id, tool, result and ms of each call; result and ms are null while it waits."""
    place = F.struct("seq", "part")
    of = lambda kind, *cols: F.min(F.when(F.col("kind") == kind, F.struct(place.alias("at"), *cols)))
    both = rows.where(F.col("kind").isin("tool_call", "tool_result")).groupBy("scenario", "call_id").agg(of("tool_call", "tool", "ms").alias("c"), of("tool_result", "text", "ms").alias("r")).where("c is not null")
    after = F.col("r.at") > F.col("c.at")
    return both.select("scenario", "call_id", "c.tool", F.when(after, F.col("r.text")).alias("result"), F.when(after, F.coalesce(F.col("r.ms") - F.col("c.ms"), F.lit(0))).alias("ms"))


def folded(rows: DataFrame) -> DataFrame:
    """A row for each scenario of normalised events, as FOLD says."""
    rows = first_of_each(rows)
    place, kind = F.struct("seq", "part"), F.col("kind")
    last = lambda k, *cols: F.max(F.when(kind == k, F.struct(place.alias("at"), *cols)))
    total = lambda c: F.coalesce(F.sum(F.when(kind.isin("text", "usage"), F.col(c))), F.lit(0))
    sums = ("turns", "input_tokens", "output_tokens", "cached_tokens")
    reported = (*sums, "cost_usd", "api_ms")
    one = rows.groupBy("scenario").agg(last("text", "text").alias("said"), last("done", "ok", "text", *reported).alias("done"), *(total(c).alias(c) for c in sums), F.count_if(kind == "error").alias("errors"))
    best = lambda c, other: F.coalesce(F.nullif(F.col(f"done.{c}"), F.lit(0)), other)
    called = pairs(rows)
    tools = rows.where(kind == "tool_call").groupBy("scenario", "tool").agg(F.count("*").alias("n")).groupBy("scenario").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools_called"), F.sum("n").alias("calls"))
    volume = called.groupBy("scenario").agg(F.count("result").alias("answered"), F.count_if(F.col("result").isNull()).alias("pending"), F.coalesce(F.sum(F.length("result")), F.lit(0)).alias("result_chars"), F.coalesce(F.sum("ms"), F.lit(0)).alias("call_ms"))
    zero = F.lit(0).cast("long")
    return one.join(tools, "scenario", "left").join(volume, "scenario", "left").select(
        "scenario",
        best("turns", F.col("turns")).alias("num_turns"),
        F.when(F.col("done.ok"), F.col("done.text")).otherwise(F.col("said.text")).alias("final_answer"),
        *(best(c, F.col(c)).alias(c) for c in sums[1:]),
        best("cost_usd", F.lit(0.0)).alias("cost_usd"),
        best("api_ms", zero).alias("api_ms"),
        "errors",
        F.coalesce("tools_called", F.create_map().cast("map<string,bigint>")).alias("tools_called"),
        *(F.coalesce(c, zero).alias(c) for c in ("calls", "answered", "pending", "result_chars", "call_ms")),
    )


__all__ = ["FOLD", "events", "first_of_each", "folded", "pairs", "said"]
