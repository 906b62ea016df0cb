"""The names of a tree's files as a stream's input: listed by tasks, in parts of a batch, oldest first."""

import json
import os

import pytest

from leafmill.streaming import counts, ingest, names


def put(root, name, second, text="# T\n\ntext"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (second, second))


def parts(folder):
    """The rows of each part, in the order of the parts' times."""
    found = sorted((p for p in folder.iterdir() if p.name.startswith("part-")), key=lambda p: p.stat().st_mtime_ns)
    return [[json.loads(line) for line in p.read_text().splitlines()] for p in found]


def test_names_are_taken_once_in_parts_oldest_first(spark, tmp_path):
    tree, checkpoint = tmp_path / "tree", tmp_path / "checkpoint"
    for i in range(7):
        put(tree, f"r{i % 2}/docs/a b é {i}.md", 1_700_000_000 - i)
    for name in ("r0/.git/x.md", "r0/docs/_x.md", "r0/_x/y.md", ".r/docs/x.md", "r0/docs/x._COPYING_"):
        put(tree, name, 5)
    put(tree, "r0/docs/_a=b.md", 1_600_000_000)
    assert names.take_names(spark, str(tree), str(checkpoint), 3) == [str(checkpoint / "names")]
    got = parts(checkpoint / "names")
    assert [len(p) for p in got] == [3, 3, 2]
    assert [r["rel_path"] for p in got for r in p] == ["docs/_a=b.md", *(f"docs/a b é {i}.md" for i in reversed(range(7)))]
    put(tree, "r1/docs/older.md", 1_000)
    names.take_names(spark, str(tree), str(checkpoint), 3)
    assert [r["rel_path"] for p in parts(checkpoint / "names")[3:] for r in p] == ["docs/older.md"]
    assert {p.name for p in checkpoint.iterdir()} == {"names"} and not (checkpoint / "names/_staged").exists()


def test_a_source_keeps_parts_and_not_files(spark, tmp_path):
    for i in range(40):
        put(tmp_path / "tree", f"r{i % 3}/docs/{i}.md", 1_700_000_000 + i)
    put(tmp_path / "tree", "r0/docs/empty.md", 1_700_000_000, "")
    where = [str(tmp_path / n) for n in ("tree", "out", "checkpoint")]
    for query in counts.keep_counts(spark, *where, files_per_batch=20):
        query.awaitTermination()
    assert sum(r.n_files for r in counts.category_counts(spark, where[1]).collect()) == 40
    for name in ("in_time", "arrived"):
        logged = [p for p in (tmp_path / "checkpoint" / name / "sources/0").iterdir() if p.name.isdigit()]
        assert sum(len(p.read_text().splitlines()) - 1 for p in logged) == 3  # of 41 files


def test_a_job_of_many_batches_has_streams_side_by_side(spark, tmp_path):
    tree, out, checkpoint = (tmp_path / n for n in ("tree", "out", "checkpoint"))
    want = [f"r{i % 3}/docs/{i}.md" for i in range(17)]
    for i, name in enumerate(want):
        put(tree, name, 1_700_000_000 + i)

    def run():
        ingest.ingest(spark, str(tree), str(out), str(checkpoint), 1).awaitTermination()
        return sorted(r.file_path for r in ingest.ingested(spark, str(out)).collect())

    assert run() == sorted(want)
    folders = {p.name for p in out.iterdir() if p.is_dir()}
    assert folders == {f"batch={n}" for n in range(9)} | {f"batch={n}-1" for n in range(8)}
    for commits in (checkpoint / "commits", checkpoint / "lane-1/commits"):  # the last batches were written, but their commits were lost
        last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
        (commits / str(last)).unlink()
        (commits / f".{last}.crc").unlink(missing_ok=True)
    put(tree, "r0/docs/late.md", 1)
    assert run() == sorted([*want, "r0/docs/late.md"])


def test_a_file_that_cannot_be_read_ends_the_stream_and_an_older_checkpoint_is_not_taken(spark, tmp_path):
    put(tmp_path / "tree", "r/docs/a.md", 1)
    (tmp_path / "begun/offsets").mkdir(parents=True)
    with pytest.raises(ValueError, match="begin a new one"):
        ingest.ingest(spark, str(tmp_path / "tree"), str(tmp_path / "out"), str(tmp_path / "begun"))
    taken = names.take_names(spark, str(tmp_path / "tree"), str(tmp_path / "checkpoint"), 5)
    (tmp_path / "tree/r/docs/a.md").unlink()
    query = ingest.file_stream(spark.newSession(), str(tmp_path / "tree"), taken[0]).writeStream.format("noop")
    with pytest.raises(Exception, match="a.md"):
        query.option("checkpointLocation", str(tmp_path / "read")).trigger(availableNow=True).start().awaitTermination()
