import time

from scriptorium.operators.chunking import Strategy
from scriptorium.streaming import indexer


def test_files_are_replaced(spark, tmp_path):
    src, out, check = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    (src / "a.md").write_text("# A\n\n## One\nx")
    (src / "b.md").write_text("# B")
    indexer.start(indexer.read_files(spark, str(src)), out, check, Strategy("h2")).awaitTermination(120)
    assert {r.chunk_id for r in indexer.current(spark, out).collect()} == {"a.md#_preamble", "a.md#a/one", "b.md#_preamble"}
    time.sleep(1.1)
    (src / "c.md").write_text("# C")
    indexer.start(indexer.read_files(spark, str(src)), out, check, Strategy("h2")).awaitTermination(120)
    assert {r.filepath for r in indexer.current(spark, out).collect()} == {"a.md", "b.md", "c.md"}
