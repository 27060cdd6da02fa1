"""Folders of files: the manifest, masked documents with maps that turn back, and nothing left after a failure."""

import hashlib
import json

import pytest

from umbra import batch
from umbra.engine import Engine
from umbra.errors import TooManyFailures, ValidationError
from umbra.sources import documents as D


def converter(content: bytes) -> str:
    if content.startswith(b"%BAD"):
        raise ValueError("no text in it")
    return D.plain_text(content)


@pytest.fixture
def folder(tmp_path):
    texts = {"a.txt": b"Write to a.b@c.org.\n\nOr from 10.0.0.1 to a.b@c.org.", "b.txt": b"nothing here", "c.txt": b"%BAD", "d.txt": b" \n", "f.txt": b"", "e.md": b"x@y.org"}
    (tmp_path / "in").mkdir()
    for name, content in texts.items():
        (tmp_path / "in" / name).write_bytes(content)
    return tmp_path, texts


def test_a_folder(spark, folder):
    top, texts = folder
    out = str(top / "out")
    assert batch.run(spark, str(top / "in"), out, converter, pattern="*.txt") == {"files": 4, "masked": 1, "clean": 2, "failed": 1, "masks": 3}
    rows = {r["doc_id"].rsplit("/", 1)[1]: r for r in map(json.loads, batch.manifest_json(spark, out).splitlines())}
    assert {n: (r["bytes"], r["sha256"]) for n, r in rows.items()} == {n: (len(t), hashlib.sha256(t).hexdigest()) for n, t in texts.items() if n.endswith("txt") and t}
    assert {n: (r["status"], r["nodes"], r["masks"]) for n, r in rows.items()} == {"a.txt": ("masked", 2, 3), "b.txt": ("clean", 1, 0), "c.txt": ("failed", 0, 0), "d.txt": ("clean", 0, 0)}
    assert rows["a.txt"]["types"] == {"EMAIL_ADDRESS": 2, "IP_ADDRESS": 1} and "no text in it" in rows["c.txt"]["error"]
    assert sorted(p.name for p in (top / "out").iterdir() if not p.name.startswith(".")) == sorted(batch.TABLES)
    docs, maps = spark.read.parquet(f"{out}/documents"), spark.read.parquet(f"{out}/maps")
    text = [[x.text for x in r.texts] for r in docs.collect() if r.doc_id.endswith("a.txt")]
    assert text == [["Write to [EMAIL].", "Or from [IP] to [EMAIL]."]]
    back, _ = Engine().unmask_documents(docs, maps)
    assert [[x.text for x in r.texts] for r in back.collect() if r.doc_id.endswith("a.txt")] == [["Write to a.b@c.org.", "Or from 10.0.0.1 to a.b@c.org."]]


def test_targets_and_failures(spark, folder):
    top, _ = folder
    out = top / "out"
    with pytest.raises(TooManyFailures):
        batch.run(spark, str(top / "in"), str(out), converter, pattern="*.txt", most_failures=0.1)
    assert [p.name for p in top.iterdir()] == ["in"]
    batch.run(spark, str(top / "in"), str(out), converter, pattern="*.md")
    with pytest.raises(ValidationError):
        batch.run(spark, str(top / "in"), str(out), converter)
    assert batch.run(spark, str(top / "in"), str(out), converter, pattern="*.md", overwrite=True)["masked"] == 1
