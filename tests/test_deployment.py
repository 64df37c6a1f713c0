"""The deploy sink: what is visible after changes, failures, conflicts and undoing."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenset.operators import deploy
from lumenset.sources.deployment import Conflict, Deployment


def files(d):
    return {r.file: open(f"{d.root[7:]}/{r.path}", "rb").read() for r in d.manifest().collect()}


def wanted(spark, rows):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "file string, content binary")


@pytest.fixture
def target(spark, tmp_path):
    return Deployment(spark, str(tmp_path / "out"))


def test_deploy_change_and_undo(spark, target):
    assert files(target) == {} and target.version() == 0
    first = target.deploy(wanted(spark, [("a.png", b"A"), ("a.txt", b"cap"), ("b.png", b"B"), ("none.png", None), ("a.png", b"A")]))
    assert first == {"written": 3, "removed": 0, "files": 3, "version": 1}
    assert target.deploy(wanted(spark, [("a.png", b"A"), ("a.txt", b"new"), ("c.png", b"")])) == {"written": 2, "removed": 1, "files": 3, "version": 2}
    assert files(target) == {"a.png": b"A", "a.txt": b"new", "c.png": b""}
    assert target.undo() == 3 and files(target) == {"a.png": b"A", "a.txt": b"cap", "b.png": b"B"}
    one = spark.createDataFrame([("a.png",), ("a.txt",), ("a_1.png",)], "file string")
    assert target.deploy_some(wanted(spark, [("a.png", b"A"), ("a_1.png", b"A"), ("z.png", b"Z")]), one) == {"written": 1, "removed": 1, "files": 3, "version": 4}
    assert files(target) == {"a.png": b"A", "a_1.png": b"A", "b.png": b"B"}
    assert target.undeploy(one)["removed"] == 2 and files(target) == {"b.png": b"B"}
    assert target.undeploy()["files"] == 0 and files(target) == {}
    target.undo()
    assert files(target) == {"b.png": b"B"}


def test_a_failed_deployment_leaves_nothing_visible(spark, target):
    target.deploy(wanted(spark, [("a.png", b"A")]))
    rows = wanted(spark, [(f"f{i}.png", bytes([i])) for i in range(40)])

    @F.udf("binary")
    def failing(name, content):
        if name == "f33.png":
            raise RuntimeError("killed")
        return bytes(content)

    held = rows.repartition(4).select("file", failing("file", "content").alias("content"))
    with pytest.raises(Exception, match="killed"):
        target.deploy(held)
    assert target.version() == 1 and files(target) == {"a.png": b"A"}
    assert target.deploy(rows)["written"] == 40 and len(files(target)) == 40


def test_attempts_that_no_manifest_names_are_vacuumed(spark, target):
    for i in range(4):
        target.deploy(wanted(spark, [("a.png", b"A"), ("n.txt", b"%d" % i)]))
    stray = f"{target.root[7:]}/data/dead/7"
    os.makedirs(stray)
    open(f"{stray}/a.png", "wb").write(b"half")
    assert target.vacuum(keep=2) == 3  # two old texts and the half file
    assert files(target) == {"a.png": b"A", "n.txt": b"3"}
    target.undo()
    assert files(target)["n.txt"] == b"2"


def test_two_deployments_conflict(spark, target):
    target.deploy(wanted(spark, [("a.png", b"A")]))
    with pytest.raises(Conflict):
        target._commit(None, 0)
    assert target.version() == 1 and files(target) == {"a.png": b"A"}


def test_archives_hold_all_files(spark, target):
    assert target.zip(3).count() == 0
    rows = [(f"f{i}.txt", b"x" * i) for i in range(50)]
    target.deploy(wanted(spark, rows))
    got, shards = {}, target.zip(3).collect()
    for s in shards:
        with zipfile.ZipFile(f"{target.root[7:]}/{s.path}") as z:
            assert len(z.namelist()) == s.files and z.testzip() is None and os.path.getsize(f"{target.root[7:]}/{s.path}") == s.size
            got |= {n: z.read(n) for n in z.namelist()}
    assert got == dict(rows) and 1 < len(shards) <= 3


def test_a_set_with_repeats_and_hidden_media(spark, target):
    items = spark.createDataFrame([(1, "s1", "png", False, False, 2, "one"), (2, "s2", "png", True, False, 1, "two"), (3, "s3", "jpg", False, True, 1, "three")], "media_id long, sha256 string, file_extension string, hidden boolean, missing boolean, repeats int, caption string")
    plan = deploy.manifest(items)
    assert target.deploy(plan.select("file", F.encode("caption", "UTF-8").alias("content")))["files"] == 2
    assert files(target) == {"s1.png": b"one", "s1_1.png": b"one"}
