"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scriptorium.operators import index, search  # noqa: E402
from scriptorium.plans import catalogue  # noqa: E402
from scriptorium.session import session  # noqa: E402

QUERIES = ["hybrid_rrf", "bm25_match", "phrase_exact", "phrase_slop2", "lexical_topk", "vector_knn_l2", "facet_auto_include", "variant_collapse", "hint_suggestions", "get_doc_context", "chunk_conversations", "size_split_parts", "cache_partition", "eval_by_category", "latency_percentiles", "agent_summary", "comparison_deltas"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="bench-")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"{work}/shared"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> object:
        began = time.time()
        out = run()
        took[name] = round(time.time() - began, 3)
        return out

    all_queries = catalogue.queries()
    all_queries["taxonomy_build"](spark, sf_dir).collect()  # the session's own start isn't measured
    for q in QUERIES:
        timed(q, lambda q=q: all_queries[q](spark, sf_dir).write.format("noop").mode("overwrite").save())
    chunks = catalogue.chunks(spark, sf_dir, indexed=True)
    built = timed("index_build", lambda: index.build(chunks, f"{work}/index"))
    engine = search.Engine(built, ["language"])
    terms = [r["text"].split()[1] + " " + r["text"].split()[2] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(10).collect()]
    engine.search(search.Request(terms[0]))
    times = []
    for t in terms:
        began = time.time()
        engine.search(search.Request(t))
        times.append(time.time() - began)
    took["indexed_search_p50"] = round(sorted(times)[len(times) // 2], 3)
    some = [r["text"].split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(100).collect()]
    asked = spark.createDataFrame([(i, " ".join(w[1:3])) for i, w in enumerate(some)], "query_id int, query string")
    began = time.time()
    search.search_many(built, asked, 10).write.format("noop").mode("overwrite").save()
    took["batched_search_per_query"] = round((time.time() - began) / max(1, len(some)), 4)
    try:
        from scriptorium.llm import queries as llm
    except ImportError:
        llm = None
    if llm is not None:
        for name, q in llm.queries().items():
            timed(name, lambda q=q: q(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
