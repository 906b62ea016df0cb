"""Counts kept by a stream, and files that come late."""

import datetime as dt
import os
from collections import Counter

from leafmill.streaming import counts, ingest

NOON = dt.datetime(2026, 3, 20, 12, tzinfo=dt.UTC)


def put(root, name, days_ago, text="# T\n\ntext"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    when = (NOON - dt.timedelta(days=days_ago)).timestamp()
    os.utime(path, (when, when))


def run(spark, tmp_path, **how):
    for query in counts.keep_counts(spark, str(tmp_path / "tree"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), **how):
        query.awaitTermination()
    rows = counts.category_counts(spark, str(tmp_path / "out")).collect()
    return {(r.repo_name, r.category): (r.n_files, r.n_late) for r in rows}


def test_counts_equal_the_batch_job_and_late_rows_are_apart(spark, tmp_path):
    tree = tmp_path / "tree"
    names = [f"r{i % 2}/{'docs' if i % 3 else 'examples'}/{i}.md" for i in range(12)]
    for i, name in enumerate(names):
        put(tree, name, i)
    put(tree, "r0/docs/examples/two.md", 1)
    for name in ("r0/docs/image.png", "r0/src/none.md", "r0/docs/.git/x.md"):
        put(tree, name, 2)
    want = Counter((n.split("/")[0], n.split("/")[1]) for n in names) + Counter([("r0", "docs"), ("r0", "examples")])
    assert run(spark, tmp_path, delay="3 days", files_per_batch=4) == {k: (n, 0) for k, n in want.items()}
    days = counts.daily_counts(spark, str(tmp_path / "out")).collect()
    assert sum(r.n_files for r in days) == 14 and len({r.day for r in days}) == 12

    # Files of the newest day give the watermark; a day that it has not passed is still open.
    put(tree, "r0/docs/open.md", 2)
    put(tree, "r0/docs/late.md", 9)
    put(tree, "r1/tutorials/late.md", 30)
    want[("r0", "docs")] += 1
    late = {("r0", "docs"): 1, ("r1", "tutorials"): 1}
    got = run(spark, tmp_path, delay="3 days", files_per_batch=4)
    assert got == {k: (want[k], late.get(k, 0)) for k in {*want, *late}}

    for name in ("in_time", "arrived"):  # the last batch was written, but its commit was lost
        commits = tmp_path / "checkpoint" / name / "commits"
        last = max(int(f) for f in os.listdir(commits) if f.isdigit())
        (commits / str(last)).unlink()
        (commits / f".{last}.crc").unlink(missing_ok=True)
    assert run(spark, tmp_path, delay="3 days", files_per_batch=4) == got


def test_a_stream_takes_files_of_any_age(spark, tmp_path):
    """A checkout keeps old times; a file much older than the newest one seen is still taken."""
    where = [str(tmp_path / n) for n in ("tree", "out", "checkpoint")]
    put(tmp_path / "tree", "r/docs/new.md", 0)
    ingest.ingest(spark, *where).awaitTermination()
    put(tmp_path / "tree", "r/docs/old.md", 900)
    ingest.ingest(spark, *where).awaitTermination()
    assert sorted(r.file_path for r in ingest.ingested(spark, where[1]).collect()) == ["r/docs/new.md", "r/docs/old.md"]


def test_state_has_no_more_pieces_than_can_be_worked_on_at_once(spark, tmp_path):
    """Each is committed with each batch, be it empty; a session's shuffle partitions may be many."""
    for i in range(40):
        put(tmp_path / "tree", f"r{i % 3}/docs/{i}.md", 1)
    many = spark.newSession()
    many.conf.set("spark.sql.shuffle.partitions", "60")
    assert run(many, tmp_path, files_per_batch=40) == {(f"r{i}", "docs"): (14 if i == 0 else 13, 0) for i in range(3)}
    for name in ("in_time", "arrived"):
        pieces = [p for p in (tmp_path / "checkpoint" / name / "state" / "0").iterdir() if p.name.isdigit()]
        assert len(pieces) <= spark.sparkContext.defaultParallelism
    assert many.conf.get("spark.sql.shuffle.partitions") == "60"


def test_a_small_batch_has_few_pieces_of_state_and_all_names_are_written_seldom(spark, tmp_path):
    """A piece is committed for every few hundred files; names given out are not gathered every ten batches."""
    for i in range(24):
        put(tmp_path / "tree", f"r{i % 3}/docs/{i}.md", 1)
    assert run(spark, tmp_path, files_per_batch=2) == {(f"r{i}", "docs"): (8, 0) for i in range(3)}
    for name in ("in_time", "arrived"):
        checkpoint = tmp_path / "checkpoint" / name
        assert len([p for p in (checkpoint / "state" / "0").iterdir() if p.name.isdigit()]) == 1
        assert not list((checkpoint / "sources" / "0").glob("*.compact"))
