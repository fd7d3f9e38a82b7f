"""The source of listed files: pruned folders, unreadable ones, filters, and the same paths as Spark's own reader."""

import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quarry.functions.paths import excluded, is_excluded
from quarry.sources import folders, scan


@pytest.fixture
def tree(tmp_path):
    for name in ("a.py", "sub/b.py", "sub/deep/c.md", "node_modules/x/y/d.py", "node_modules/e.py", "other/.hidden.py", "other/_temp.py", "other/f.txt", "big/g.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("z" * (5000 if "big" in name else 10))
    return str(tmp_path)


def test_excluded_folders_are_not_opened(tree):
    asked, local = [], fs.LocalFileSystem()

    class Counting:
        def get_file_info(self, what):
            asked.append(os.path.relpath(what.base_dir, tree))
            return local.get_file_info(what)

    found = {os.path.relpath(f, tree) for f in folders.walk(Counting(), tree, True, ["*node_modules/*"])}
    assert found == set(asked) == {".", "sub", "sub/deep", "other", "big"}
    assert list(folders.walk(Counting(), tree, False, [])) == [tree]
    assert list(folders.walk(Counting(), tree, True, ["*"])) == []


def test_an_unreadable_folder_is_left_out(tree, caplog):
    class Refusing:
        def get_file_info(self, what):
            if what.base_dir.endswith("sub"):
                raise PermissionError("no")
            return fs.LocalFileSystem().get_file_info(what)

    found = {os.path.relpath(f, tree) for f in folders.walk(Refusing(), tree, True, [])}
    assert "sub" in found and "sub/deep" not in found and "node_modules/x/y" in found
    assert "can't be listed" in caplog.text


def test_the_same_files_as_sparks_reader(spark, tree):
    for how in ((True, [], []), (True, [".py"], ["*node_modules/*"]), (False, [], []), (True, [], ["*/deep/*", "a.py"]), (True, [], ["*"])):
        for most in (0, 0.001):
            mine = {tuple(r) for r in scan.list_folder(spark, tree, *how, most).collect()}
            theirs = {tuple(r) for r in scan.read_folder(spark, tree, *how, most, False).select("source", "file_size", "last_modified").collect()}
            assert mine == theirs
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan.list_folder(spark, tree + "/none").collect()
    assert scan.list_folder(spark, "file://" + tree + "/sub").count() == 2


def test_predicates_agree(spark):
    paths_ = ["/a/b/c.py", "/a/node/x", "c.py", "/x*y", "", "/a/b/"]
    patterns = ["*", "*b/*", "*.py", "/a/*", "c.py", "/x*y", "**", "", "*x*y"]
    frame = spark.createDataFrame([(p,) for p in paths_], "p string")
    for k in patterns:
        got = {r.p: r.e for r in frame.select("p", is_excluded(F.col("p"), [k]).alias("e")).collect()}
        assert got == {p: excluded(p, [k]) for p in paths_}, k
