"""Command line: validate, build, fix, search, get, evaluate."""

from __future__ import annotations

import argparse
import json
import os
import sys

from scriptorium.operators import documents, index, search, vectors
from scriptorium.operators.metadata import collapse_keys
from scriptorium.plans import build
from scriptorium.session import session
from scriptorium.sources.corpus import MANIFEST_NAME


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "fix", "build"):
        sub.add_parser(name).add_argument("docs")
        sub.choices[name].add_argument("--manifest-name", default=MANIFEST_NAME)
    sub.choices["fix"].add_argument("--write", action="store_true", help="write the manifest")
    b = sub.choices["build"]
    b.add_argument("out")
    b.add_argument("--description", default="Documentation")
    b.add_argument("--embedding", choices=("none", "hash"), default="none")
    b.add_argument("--rebuild", action="store_true")
    b.add_argument("--json", help="also write the chunks as one JSON array to this file")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query")
    s.add_argument("--filter", action="append", default=[], metavar="KEY=VALUE")
    s.add_argument("--limit", type=int)
    s.add_argument("--cursor")
    g = sub.add_parser("get")
    g.add_argument("index")
    g.add_argument("chunk_id")
    g.add_argument("--context", type=int, default=0)
    e = sub.add_parser("evaluate")
    e.add_argument("index")
    e.add_argument("cases", help="JSON array of cases")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session(a.master)
    if a.command == "validate":
        out: object = vars(build.validate(spark, a.docs, a.manifest_name))
    elif a.command == "fix":
        out = build.fix(spark, a.docs, a.manifest_name)
        if a.write:
            with open(os.path.join(a.docs, a.manifest_name), "x", encoding="utf-8") as f:
                json.dump(out, f, indent=2)
    elif a.command == "build":
        made, report = build.build(spark, a.docs, a.out, a.description, vectors.provider(a.embedding), rebuild=a.rebuild, manifest_name=a.manifest_name)
        if a.json:
            index.export_json_array(made.table("chunks"), a.json)
        out = vars(report)
    else:
        made = index.Index.open(spark, a.index)
        document = made.metadata
        embedding = document["embedding"] or {}
        provider = vectors.HashProvider(embedding["dimensions"]) if embedding.get("provider") == "hash" else None
        engine = search.Engine(made, collapse_keys(document["taxonomy"]), provider=provider)
        if a.command == "get":
            print(documents.get_doc_of(made, a.chunk_id, a.context))
            return 0
        if a.command == "search":
            filters = dict(x.split("=", 1) for x in a.filter)
            out = vars(engine.search(search.Request(a.query, filters, a.limit, a.cursor, list(document["taxonomy"]))))
        else:
            with open(a.cases, encoding="utf-8") as f:
                out = build.evaluate_retrieval(spark, engine, json.load(f))
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
