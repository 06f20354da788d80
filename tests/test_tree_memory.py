"""Writing and reading many texts takes a task's Python a bounded part of them at a time."""

from __future__ import annotations

import os

import psutil
import pytest
from pyspark.sql import functions as F

from shelflife.plans import registered
from shelflife.sources import content

MB = 1024 * 1024


def python_workers():
    return [p for p in psutil.Process().children(recursive=True) if "python" in p.name()]


def peak(process):
    with open(f"/proc/{process.pid}/status") as status:
        return next(int(line.split()[1]) * 1024 for line in status if line.startswith("VmHWM"))


def test_documents_are_written_a_few_at_a_time(spark, tmp_path):
    before = {}
    for p in python_workers():
        with open(f"/proc/{p.pid}/clear_refs", "w") as peaks:
            peaks.write("5")
        before[p.pid] = peak(p)
    text = F.repeat(F.md5(F.col("id").cast("string")), 1000)
    documents = spark.range(2400).repartition(1).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(32_000).cast("long").alias("n_chars")
    )
    roots = registered.document_tree(documents, str(tmp_path / "tree"))
    assert roots == {"en": f"{tmp_path}/tree/en"}
    files = os.listdir(tmp_path / "tree" / "en" / "a")
    assert len(files) == 2400 and {os.path.getsize(tmp_path / "tree" / "en" / "a" / f) for f in files} == {32_000}
    # 77 MB of text; a worker without any takes some 60 MB.
    assert max(peak(p) - before.get(p.pid, 0) for p in python_workers()) < 120 * MB


@pytest.mark.parametrize("char,size", [("a", 1), ("é", 2), ("😀", 4)])
def test_texts_are_handed_on_by_their_bytes(tmp_path, char, size):
    pd = pytest.importorskip("pandas")
    paths = []
    for k in range(40):
        paths.append(str(tmp_path / f"{k}"))
        (tmp_path / f"{k}").write_text(char * 100_000)
    given = pd.DataFrame({"dir_name": "r", "item": paths + [f"{tmp_path}/none"] * 5000, "raw": None, "part": 0})
    frames = list(content._read_parts(None, 8, content.BATCH_BYTES)([given]))
    texts = [t for f in frames for t in f["text"] if t is not None]
    assert texts == [char * 100_000] * 40
    assert [i for f in frames for i in f["item"]] == list(given["item"])
    assert max(sum(len(t.encode()) for t in f["text"] if t is not None) for f in frames) <= 2 * content.BATCH_BYTES + 100_000 * size
    assert max(map(len, frames)) <= 2100
