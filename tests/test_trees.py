"""The tree source: what is skipped is never listed, filters reach the walk, each repository is a partition."""

import pytest
from pyspark.sql import functions as F

from siltstone.sources import tree, tree_source


@pytest.fixture()
def repos(tmp_path):
    files = {
        "a/src/x.py": b"x = 1\n", "a/node_modules/deep/y.js": b"skip", "a/z.min.js": b"skip", "a/bad.txt": b"ok \xff end", "a/.git/config": b"skip", "a/big.c": b"c" * 2000,
        "b/lib/build/k.go": b"skip", "b/q.go": b"package q", "b/empty.rs": b"", "b/we[ird] {n}ame*.c": b"int x;", "c/target/t.rs": b"skip", "top.txt": b"not in a repository",
    }
    for name, body in files.items():
        p = tmp_path / "all" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return f"file://{tmp_path}/all"


def test_walk(spark, repos):
    rows = tree_source.read_trees(spark, repos)
    got = {(r["repo"], r["path"]): (r["length"], r["content"]) for r in rows.collect()}
    assert set(got) == {("a", "a/src/x.py"), ("a", "a/bad.txt"), ("a", "a/big.c"), ("b", "b/q.go"), ("b", "b/empty.rs"), ("b", "b/we[ird] {n}ame*.c")}
    assert got["a", "a/bad.txt"] == (8, "ok \ufffd end") and got["b", "b/empty.rs"] == (0, "")
    assert rows.rdd.getNumPartitions() == 3
    assert {r["path"] for r in tree_source.read_trees(spark, repos, maxBytes=1000).collect()} == {p for _, p in got if p != "a/big.c"}
    one = tree.read_tree(spark, f"{repos}/a")
    assert one.columns == ["path", "length", "content"] and {r["path"] for r in one.collect()} == {f"{repos}/a/{p}" for p in ("src/x.py", "bad.txt", "big.c")}
    assert tree_source.read_trees(spark, f"{repos}/none").count() == 0


def test_filters_reach_the_walk(spark, repos):
    rows = tree_source.read_trees(spark, repos).filter((F.col("repo") == "b") & (F.col("length") <= 6) & (F.col("path") != "b/empty.rs"))
    assert [r["path"] for r in rows.collect()] == ["b/we[ird] {n}ame*.c"] and rows.rdd.getNumPartitions() == 1
    reader = tree_source._Reader({"path": repos})
    left = list(reader.pushFilters([tree_source.In(("repo",), ("a", "b")), tree_source.EqualTo(("repo",), "a"), tree_source.LessThan(("length",), 7), tree_source.EqualTo(("path",), "x")]))
    assert left == [tree_source.EqualTo(("path",), "x")] and [p.name for p in reader.partitions()] == ["a"] and reader.most == 6
    listed = []

    class Listing:
        def __init__(self, fs):
            self.fs = fs

        def get_file_info(self, selector):
            listed.append(selector.base_dir.rpartition("/all/")[2])
            return self.fs.get_file_info(selector)

    fs, path = tree_source.folder(repos)
    assert [f.base_name for f in reader._files(Listing(fs), f"{path}/a")] == ["x.py"] and sorted(listed) == ["a", "a/src"]
