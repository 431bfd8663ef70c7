"""The fold of agent runs (`operators.traces`) over a stream, with state for each scenario.

State: running totals, the latest text and final report, a bit for each line that was seen, the
calls by name, and each call with what is known of its result. Lines may come in any order, more
than once and over several batches; a call waits in the state until its result is there, and the
other way round. The first FEW calls are part of the scenario's own value, so that most scenarios
take a handful of reads and writes of the state instead of some for each call. After each batch every scenario it touched gives its row as it is then; `latest`
takes the last one of each. Over all lines that is what the batch fold gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators import traces

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Lines that share a word of bits.
BITS = 60
#: Calls that are kept in a scenario's value; further ones have entries of their own.
FEW = 64
TOTALS = ("turns", "input_tokens", "output_tokens", "cached_tokens")
VALUE = "events bigint, turns bigint, input_tokens bigint, output_tokens bigint, cached_tokens bigint, errors bigint, said_seq bigint, said_part bigint, said string, done_seq bigint, done_part bigint, ok boolean, answer string, d_turns bigint, d_input_tokens bigint, d_output_tokens bigint, d_cached_tokens bigint, d_cost_usd double, d_api_ms bigint, calls bigint, known bigint, answered bigint, result_chars bigint, call_ms bigint, few string, more boolean"
NAMES = [f.split()[0] for f in VALUE.split(", ")]
CALL = "c_seq bigint, c_part bigint, c_ms bigint, r_seq bigint, r_part bigint, r_ms bigint, chars bigint"
OUT = f"scenario string, events bigint, {traces.FOLD}"


def _none(x: object) -> bool:
    return x is None or x != x


class Fold(StatefulProcessor):
    def __init__(self, most: int = FEW) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", VALUE)
        self.seen = handle.getMapState("seen", "word bigint", "bits bigint")
        self.tools = handle.getMapState("tools", "tool string", "n bigint")
        self.waiting = handle.getMapState("calls", "call_id string", CALL)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = self.value.get()
        v = dict(zip(NAMES, known, strict=True)) if known is not None else dict.fromkeys(NAMES, None) | {k: 0 for k in ("events", *TOTALS, "errors", "calls", "known", "answered", "result_chars", "call_ms")}
        self.found: set[str] = set()  # calls with entries of their own
        self.few = json.loads(v["few"]) if v["few"] else {}
        words: dict[int, int] = {}  # bits as they were before this call
        fresh: dict[int, int] = {}
        counts: dict[str, int] = {}
        calls: dict[str, list] = {}
        parts: set[tuple[int, int]] = set()
        for b in rows:
            for r in b.to_dict("records"):
                seq, part = int(r["seq"]), int(r["part"])
                word, bit = divmod(seq, BITS)
                if word not in words:
                    words[word] = self.kept(self.seen, word) if known is not None else 0
                if words[word] >> bit & 1 or (seq, part) in parts:
                    continue
                parts.add((seq, part))
                fresh[word] = fresh.get(word, words[word]) | 1 << bit
                v["events"] += 1
                self.take(v, r, seq, part, counts, calls)
        for word, bits in fresh.items():
            self.seen.updateValue((word,), (bits,))
        for tool, n in counts.items():
            self.tools.updateValue((tool,), ((self.kept(self.tools, tool) if known is not None else 0) + n,))
        for call_id, c in calls.items():
            if call_id in self.few or len(self.few) < self.most and call_id not in self.found:
                self.few[call_id] = c
            else:
                self.waiting.updateValue((call_id,), tuple(c))
                v["more"] = True
        v["few"] = json.dumps(self.few, separators=(",", ":"))
        self.value.update(tuple(v[k] for k in NAMES))
        yield pd.DataFrame([self.row(key[0], v, counts if known is None else {k[0]: n[0] for k, n in self.tools.iterator()})])

    @staticmethod
    def kept(state: object, key: object) -> int:
        found = state.getValue((key,))
        return 0 if found is None else found[0]

    def take(self, v: dict, r: dict, seq: int, part: int, counts: dict[str, int], calls: dict[str, list]) -> None:
        kind = r["kind"]
        whole = lambda x: 0 if _none(x) else int(x)
        text = None if _none(r["text"]) else r["text"]
        if kind in ("text", "usage"):
            for k in TOTALS:
                v[k] += whole(r[k])
        if kind == "text" and (v["said_seq"] is None or (seq, part) > (v["said_seq"], v["said_part"])):
            v |= {"said_seq": seq, "said_part": part, "said": text}
        elif kind == "error":
            v["errors"] += 1
        elif kind == "done" and (v["done_seq"] is None or (seq, part) > (v["done_seq"], v["done_part"])):
            v |= {"done_seq": seq, "done_part": part, "ok": bool(r["ok"]), "answer": text, "d_cost_usd": 0.0 if _none(r["cost_usd"]) else float(r["cost_usd"]), "d_api_ms": whole(r["api_ms"])} | {f"d_{k}": whole(r[k]) for k in TOTALS}
        elif kind in ("tool_call", "tool_result"):
            self.pair(v, r, (seq, part), calls, kind == "tool_call", text)
            if kind == "tool_call":
                v["calls"] += 1
                counts[r["tool"]] = counts.get(r["tool"], 0) + 1

    def pair(self, v: dict, r: dict, at: tuple[int, int], calls: dict[str, list], is_call: bool, text: str | None) -> None:
        """Take a call or a result under its id; what the id added to the sums before goes first."""
        i = r["call_id"]
        if i not in calls:
            there = self.few.get(i)
            if there is None and v["more"] and (there := self.waiting.getValue((i,))) is not None:
                self.found.add(i)
            calls[i] = [None] * 7 if there is None else list(there)
        c = calls[i]
        self.count(v, c, -1)
        ms = None if _none(r["ms"]) else int(r["ms"])
        if is_call and (c[0] is None or at < (c[0], c[1])):
            c[0:3] = [*at, ms]
        elif not is_call and (c[3] is None or at < (c[3], c[4])):
            c[3:7] = [*at, ms, None if text is None else len(text)]
        self.count(v, c, 1)

    @staticmethod
    def count(v: dict, c: list, sign: int) -> None:
        v["known"] += sign * (c[0] is not None)
        if c[0] is not None and c[3] is not None and (c[3], c[4]) > (c[0], c[1]) and c[6] is not None:
            v["answered"] += sign
            v["result_chars"] += sign * c[6]
        if c[0] is not None and c[3] is not None and (c[3], c[4]) > (c[0], c[1]) and c[2] is not None and c[5] is not None:
            v["call_ms"] += sign * (c[5] - c[2])

    def row(self, scenario: str, v: dict, tools: dict[str, int]) -> dict:
        best = lambda k: v[f"d_{k}"] or v[k]
        return {
            "scenario": scenario, "events": v["events"], "num_turns": best("turns"), "final_answer": v["answer"] if v["ok"] else v["said"], **{k: best(k) for k in TOTALS[1:]}, "cost_usd": v["d_cost_usd"] or 0.0, "api_ms": v["d_api_ms"] or 0,
            "errors": v["errors"], "tools_called": dict(sorted(tools.items())), "calls": v["calls"], "answered": v["answered"], "pending": v["known"] - v["answered"], "result_chars": v["result_chars"], "call_ms": v["call_ms"],
        }

    def close(self) -> None:
        pass


def folded(events: DataFrame) -> DataFrame:
    """The rows, as OUT says, that scenarios have after each batch of a stream of normalised events."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.withColumn("scenario", F.col("scenario").cast("string")).groupBy("scenario").transformWithStateInPandas(Fold(FEW), OUT, "Update", "None")


def start(lines: DataFrame, target: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Fold a stream of lines (scenario, seq, line and, if known, ms) into batches of rows below target; a replayed batch is written over."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return folded(traces.events(lines)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The last row of each scenario."""
    rows = spark.read.option("basePath", target).schema(f"{OUT}, batch int").parquet(target)
    return rows.groupBy("scenario").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*").drop("batch")


__all__ = ["Fold", "folded", "latest", "start"]
