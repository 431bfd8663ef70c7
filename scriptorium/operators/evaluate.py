"""Quality of ranked results, latencies, and comparison with a baseline.

Cases: expected STRING, ranked ARRAY<STRING>, rounds INT, name STRING, category STRING.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranks

#: Results that count, the category of cases without one, and the label of a case that isn't found.
DEPTH, NO_CATEGORY, NOT_FOUND = 5, "uncategorized", "N/F"
#: Tokens of a query for its cost, and bytes of a corpus for a token.
QUERY_TOKENS, BYTES_A_TOKEN = 20, 4
METRICS = ("mrr_at_5", "ndcg_at_5", "avg_rounds", "hit_at_5")


def place(k: int = DEPTH) -> Column:
    """Position of the expected id among the first k, 0 if it isn't there."""
    return F.coalesce(F.array_position(F.slice("ranked", 1, k), F.col("expected")), F.lit(0))


def _mean(value: Column) -> Column:
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6)


def mrr(k: int = DEPTH) -> Column:
    return _mean(F.when(place(k) > 0, 1.0 / place(k)).otherwise(0.0))


def ndcg(k: int = DEPTH) -> Column:
    return _mean(F.when(place(k) > 0, 1.0 / F.log2(place(k) + 1.0)).otherwise(0.0))


def hit(k: int = DEPTH) -> Column:
    return _mean((place(k) > 0).cast("double"))


def summary(cases: DataFrame) -> DataFrame:
    return cases.agg(mrr().alias("mrr_at_5"), ndcg().alias("ndcg_at_5"), _mean(F.col("rounds").cast("double")).alias("avg_rounds"), hit().alias("hit_at_5"))


def by_category(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.coalesce("category", F.lit(NO_CATEGORY)).alias("category")).agg(F.count("*").alias("case_count"), hit().alias("hit_at_5"), mrr().alias("mrr_at_5"), ndcg().alias("ndcg_at_5"))


def latency(rows: DataFrame, value: str, by: Sequence[str] = (), shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """p50 and p95, the values at rank ceil(n p), for each value of `by`; 0 without values."""
    names = [f"p{round(p * 100)}" for p in shares]
    found = ranks.quantiles(rows, {value: {n: ("nearest", p) for n, p in zip(names, shares, strict=True)}}, by)
    return found.select(*by, *(F.round(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), 6).alias(n) for n in names))


def full_summary(cases: DataFrame, search_ms: DataFrame, get_ms: DataFrame, build_ms: float = 0.0, peak_mb: float = 0.0) -> DataFrame:
    """One row: quality, search p50 and p95, retrieval p50, build time and peak memory. search_ms, get_ms: column ms."""
    s = latency(search_ms, "ms").select(F.col("p50").alias("search_p50_ms"), F.col("p95").alias("search_p95_ms"))
    g = latency(get_ms, "ms", shares=(0.5,)).select(F.col("p50").alias("get_doc_p50_ms"))
    one = summary(cases).crossJoin(s).crossJoin(g)  # one row each
    return one.withColumn("build_ms", F.round(F.lit(float(build_ms)), 6)).withColumn("peak_mb", F.round(F.lit(float(peak_mb)), 6))


def long_form(one: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("m.*")


def delta(current: DataFrame, baseline: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """metric, baseline, current and signed difference; what isn't finite counts as 0."""
    finite = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c))
    rows = long_form(current, metrics).withColumnRenamed("value", "now").join(long_form(baseline, metrics).withColumnRenamed("value", "before"), "metric")
    return rows.select("metric", finite("before").alias("baseline"), finite("now").alias("current"), F.round(finite("now") - finite("before"), 6).alias("delta"))


def rank_label() -> Column:
    return F.coalesce(F.nullif(F.array_position("ranked", F.col("expected")), F.lit(0)).cast("string"), F.lit(NOT_FOUND))


def flips(current: DataFrame, baseline: DataFrame, order: str | None = None) -> DataFrame:
    """Cases by name whose verdict changed: regressions and improvements with their ranks. Of the baseline's cases of one name the last by `order` counts, or else the last in the order they come in."""
    judged = lambda df: df.select("name", (place() > 0).alias("passed"), rank_label().alias("rank"), *([order] if order else []))
    place_of = F.col(order) if order else F.monotonically_increasing_id()
    before = judged(baseline).withColumn("at", place_of)
    before = before.groupBy("name").agg(F.max_by(F.struct("passed", "rank"), "at").alias("b")).select("name", "b.*")
    both = judged(current).drop(*([order] if order else [])).alias("c").join(before.alias("b"), "name")
    kind = F.when(F.col("b.passed"), "regression").otherwise("improvement")
    return both.where(F.col("c.passed") != F.col("b.passed")).select("name", kind.alias("kind"), F.col("b.rank").alias("baseline_rank"), F.col("c.rank").alias("current_rank"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A saved summary (one JSON object, or one with a `summary`) as a row, for delta()."""
    found = spark.read.json(path, multiLine=True)
    return found.select("summary.*") if "summary" in found.columns else found


def save_summary(one: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"summary": one.first().asDict()}, f, indent=2)


class PeakMemory:
    """Greatest resident memory, in MB, of this process and its children while the block runs, sampled every 200 ms; None where it can't be read."""

    EVERY = 0.2

    def __enter__(self) -> PeakMemory:
        self.mb: float | None = None
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def _watch(self) -> None:
        while True:
            now = resident_mb(os.getpid())
            if now is not None:
                self.mb = max(self.mb or 0.0, now)
            if self._over.wait(self.EVERY):
                return

    def __exit__(self, *_: object) -> None:
        self._over.set()
        self._thread.join()


def resident_mb(pid: int) -> float | None:
    """Resident memory of a process and those it started."""
    parents: dict[int, list[int]] = {}
    pages: dict[int, int] = {}
    try:
        for name in os.listdir("/proc"):
            if name.isdigit():
                try:
                    with open(f"/proc/{name}/stat", encoding="utf-8", errors="replace") as f:
                        fields = f.read().rpartition(")")[2].split()
                except OSError:
                    continue
                parents.setdefault(int(fields[1]), []).append(int(name))
                pages[int(name)] = int(fields[21])
    except OSError:
        return None
    total, todo = 0, [pid]
    while todo:
        p = todo.pop()
        total += pages.get(p, 0)
        todo += parents.get(p, [])
    return total * os.sysconf("SC_PAGE_SIZE") / 2**20


def paged_rounds(ranks: DataFrame, limit: int = 5, most_rounds: int = 3) -> DataFrame:
    """Rounds of a paged search until the expected hit (rank from 1, null if there is none), all rounds and one more if it isn't in them."""
    needed = F.ceil(F.col("rank") / F.lit(limit)).cast("int")
    return ranks.withColumn("rounds", F.when(needed <= most_rounds, needed).otherwise(most_rounds + 1))


def embedding_cost(corpus_bytes: Column, price: Column) -> Column:
    """Estimated cost of embedding a corpus, price by million tokens."""
    return F.round(corpus_bytes / BYTES_A_TOKEN / 1e6 * price, 6)


def query_cost(price: Column) -> Column:
    return F.round(QUERY_TOKENS / 1e6 * price, 9)


def benchmark_report(runs: DataFrame, corpus_bytes: int, prices: Mapping[str, float]) -> DataFrame:
    """A row for each label: quality and times as measured, index size by corpus size, estimated costs. runs: label, index_bytes and metrics."""
    price = F.coalesce(F.create_map(*(F.lit(x) for kv in prices.items() for x in kv))[F.col("label")], F.lit(0.0)) if prices else F.lit(0.0)
    return runs.withColumn("index_by_corpus", F.round(F.col("index_bytes") / corpus_bytes, 6)).withColumn("embedding_cost", embedding_cost(F.lit(corpus_bytes), price)).withColumn("query_cost", query_cost(price))
