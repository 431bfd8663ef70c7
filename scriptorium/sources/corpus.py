"""Markdown corpora and prompt templates on a file system, and JSON or YAML side files."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import manifest as M
from scriptorium.session import written

MANIFEST_NAME = ".docs-manifest.json"
TEMPLATE_ENDS = (".template.md", ".template.yaml")
#: How a result history names its files.
CONFIG_KEY = "_config"


def _walk(root: str) -> Iterator[str]:
    """Paths below root, relative and with /, without hidden names; the listing is the driver's, as Spark's own skips names with _."""
    for d, dirs, names in os.walk(root):
        dirs[:] = [x for x in dirs if not x.startswith(".")]
        for n in names:
            yield os.path.relpath(os.path.join(d, n), root).replace(os.sep, "/")


def markdown_paths(root: str) -> list[str]:
    return sorted(p for p in _walk(root) if p.endswith(".md") and not p.endswith(TEMPLATE_ENDS) and not os.path.basename(p).startswith("."))


def prompt_paths(root: str) -> list[str]:
    return sorted(p for p in _walk(root) if p.endswith(TEMPLATE_ENDS))


def prompt_name(path: str) -> str:
    return next(path[: -len(e)] for e in TEMPLATE_ENDS if path.endswith(e))


def preferred_prompts(paths: list[str]) -> tuple[list[str], list[str]]:
    """One path for each prompt, YAML before markdown, and warnings; two of one form are an error."""
    by_name: dict[str, list[str]] = {}
    for p in paths:
        by_name.setdefault(prompt_name(p), []).append(p)
    kept, warnings = [], []
    for name, same in sorted(by_name.items()):
        forms = [os.path.splitext(p)[1] for p in same]
        if len(set(forms)) < len(forms):
            raise ValueError(f"Duplicate prompt template '{name}'")
        same.sort(key=lambda p: not p.endswith(".yaml"))
        if len(same) > 1:
            warnings.append(f"Prompt '{name}' has two templates; {same[0]} is used, {same[1]} is not.")
        kept.append(same[0])
    return kept, warnings


def manifests(root: str, name: str = MANIFEST_NAME) -> dict[str, M.Manifest]:
    """Directory (relative, '' for the root) to manifest; each is parsed once."""
    out = {}
    for d, dirs, names in os.walk(root):
        dirs[:] = [x for x in dirs if not x.startswith(".")]
        if name in names:
            rel = os.path.relpath(d, root).replace(os.sep, "/")
            with open(os.path.join(d, name), encoding="utf-8") as f:
                out["" if rel == "." else rel] = M.parse_manifest(f.read())
    return out


def tree(spark: SparkSession, root: str, dirs_a_task: int = 50) -> DataFrame:
    """path of every file below root, as _walk gives them, listed by the executors a level of directories at a time; they see root."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column(0).to_pylist():
                names, kinds = [], []
                with os.scandir(os.path.join(root, d)) as entries:
                    for e in entries:
                        is_dir = e.is_dir()
                        if not (is_dir and (e.name.startswith(".") or e.is_symlink())):
                            names.append(f"{d}/{e.name}" if d else e.name)
                            kinds.append(is_dir)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.bool_())], names=["path", "is_dir"])

    level, levels, n = spark.createDataFrame([("",)], "path string"), [], 1
    while n:
        found = written(level.repartition(max(1, -(-n // dirs_a_task))).mapInArrow(look, "path string, is_dir boolean"), "level")
        levels.append(found)
        level = found.where("is_dir").select("path")
        n = level.count()
    return reduce(DataFrame.unionByName, levels).where("not is_dir").select("path")


def read_tree(spark: SparkSession, root: str, manifest_name: str = MANIFEST_NAME, files_a_task: int = 500) -> DataFrame:
    """The rows of read_corpus for corpora of any number of files and manifests: listing, manifests and their paths stay with the executors."""
    paths = written(tree(spark, root), "tree")
    name = F.element_at(F.split("path", "/"), -1)
    plain = F.endswith("path", F.lit(".md")) & ~F.startswith(name, F.lit(".")) & reduce(lambda a, b: a & b, (~F.endswith("path", F.lit(e)) for e in TEMPLATE_ENDS))
    files = written(paths.where(plain), "files")
    place = F.regexp_replace("path", "/?[^/]*$", "")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for p in b.column(1).to_pylist():
                with open(os.path.join(root, p), encoding="utf-8") as f:
                    got.append(f.read())
                M.parse_manifest(got[-1])  # a broken one is told where it is read
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["dir", "manifest"])

    known = written(paths.where(name == manifest_name).select(place.alias("dir"), "path").mapInArrow(texts, "dir string, manifest string"), "manifests")
    near = M.nearest_of(files, known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for p in b.column(0).to_pylist():
                with open(os.path.join(root, p), encoding="utf-8", newline="") as f:
                    got.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string()), b.column(1), b.column(2)], names=["path", "markdown", "manifest", "dir"])

    dealt = near.select("path", "manifest", "dir").repartition(max(1, -(-files.count() // files_a_task)), "path")
    return M.resolved(dealt.mapInArrow(read, "path string, markdown string, manifest string, dir string"))


def read_corpus(spark: SparkSession, root: str, manifest_name: str = MANIFEST_NAME, files_a_task: int = 500) -> DataFrame:
    """Files of a corpus with their settings. Paths are listed on the driver, contents read and resolved on the executors, which see root."""
    known = manifests(root, manifest_name)
    paths = markdown_paths(root)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // files_a_task)))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for p in b.column(0).to_pylist():
                with open(os.path.join(root, p), encoding="utf-8", newline="") as f:
                    text = f.read()
                near = M.nearest(p, known)
                files.append((p, text, near[1] if near else None, near[0] if near else ""))
            yield M.resolved_batch(files)

    return listed.mapInArrow(over, M.RESOLVED)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a retrieval evaluation: a JSON array."""
    schema = "query string, expectedChunkId string, filters map<string,string>, `limit` int, maxRounds int, name string, category string"
    return spark.read.schema(schema).json(path, multiLine=True)


def scenarios(path: str) -> tuple[list[dict], dict]:
    """Scenarios of an agent suite (a YAML list or mapping, merge keys allowed) and its configuration; names with _ are left out."""
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    if isinstance(data, list):
        return [{"id": s.get("id", str(k)), **s} for k, s in enumerate(data)], {}
    return [{"id": k, **v} for k, v in data.items() if not str(k).startswith("_")], data.get(CONFIG_KEY) or {}


def save_result(root: str, suite: str, stamp: str, result: dict) -> str:
    from scriptorium.functions.text import suite_name

    folder = os.path.join(root, suite_name(suite))
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{stamp.replace(':', '-')}.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(result, f, ensure_ascii=False, indent=2)
    return path


def previous_result(root: str, suite: str) -> dict | None:
    """The latest saved result: the last name in binary order."""
    from scriptorium.functions.text import suite_name

    folder = os.path.join(root, suite_name(suite))
    names = sorted(n for n in os.listdir(folder) if n.endswith(".json")) if os.path.isdir(folder) else []
    if not names:
        return None
    with open(os.path.join(folder, names[-1]), encoding="utf-8") as f:
        return json.load(f)


def directory_bytes(root: str, ending: str = "") -> int:
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names if n.endswith(ending))


def source_commit(root: str) -> str | None:
    """The commit that a corpus is at, if it is in a git repository."""
    got = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    found = got.stdout.strip()
    return found if got.returncode == 0 and len(found) == 40 else None


def corpus_label(root: str) -> str:
    """Name of the repository and the corpus's path in it, or else the folder's name."""
    root = os.path.abspath(root)
    top = subprocess.run(["git", "-C", root, "rev-parse", "--show-toplevel"], capture_output=True, text=True, check=False)
    if top.returncode:
        return os.path.basename(root)
    home = os.path.realpath(top.stdout.strip())
    inside = os.path.relpath(os.path.realpath(root), home).replace(os.sep, "/")
    return os.path.basename(home) if inside == "." else f"{os.path.basename(home)}/{inside}"
