"""What a whole job keeps on disk while it goes on."""

import os

from leafmill.plans import build


def test_conversions_are_gone_before_the_derived_corpora_are_written(spark, tmp_path, monkeypatch):
    (tmp_path / "tree/r/docs").mkdir(parents=True)
    for i in range(4):
        (tmp_path / f"tree/r/docs/{i}.md").write_text(f"# T{i}\n\ntext")
    shared = f"{spark.conf.get('spark.checkpoint.dir')}/leafmill"
    before, seen, write = set(os.listdir(shared)) if os.path.isdir(shared) else set(), {}, build.write_corpus

    def watched(corpus, output_dir, kind="standard", *rest):
        seen[kind] = {n.rpartition("-")[0] for n in set(os.listdir(shared)) - before}
        return write(corpus, output_dir, kind, *rest)

    monkeypatch.setattr(build, "write_corpus", watched)
    made = build.build_from_tree(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    assert [c.count() for c in (made.standard, made.sft, made.code_generation)] == [4, 4, 4]
    assert "converted" in seen["standard"] and seen["sft"] == seen["code_gen"] == set()
    parts = [p.name for p in (tmp_path / "out").rglob("part-*.parquet")]
    assert parts and all(name.endswith(".zstd.parquet") for name in parts)
