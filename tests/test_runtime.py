"""Where scratch tables go, and that superseded ones are removed."""

import os

import pytest

from labelmesh import runtime


class FakeSession:
    """Just the settings that choose the shared folder."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}-{folder}"})


def test_the_named_folder_is_used():
    assert runtime.shared_root(FakeSession("yarn", "hdfs:///scratch/")) == "hdfs:///scratch"


def test_a_cluster_must_name_a_folder():
    with pytest.raises(RuntimeError):
        runtime.shared_root(FakeSession("yarn"))


def test_a_local_session_gets_one_folder():
    session = FakeSession("local[2]")
    assert runtime.shared_root(session) == runtime.shared_root(session)
    assert os.path.isdir(runtime.shared_root(session))


def test_old_generations_are_removed(spark):
    rolling = runtime.Rolling("generation")
    paths = []
    for i in range(4):
        assert rolling.push(spark.range(i + 1)).count() == i + 1
        paths.append(rolling.generations[-1][1])
    local = [p.replace("file:", "") for p in paths]
    assert [os.path.isdir(p) for p in local] == [False, False, True, True]
    rolling.drop()
    assert not os.path.isdir(local[-1])


@pytest.mark.parametrize("rows_per_split", [None, 1])
def test_a_step_does_not_shuffle_annotations(spark, stub, rows_per_split):
    """The layout is read as it lies: only the posterior moves. Nothing of it is left after release."""
    from labelmesh.models.corpus import Corpus

    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus = Corpus.build(stub["annotations"], stub["items"], 3, stub["features"], rows_per_split)
        p = corpus.vote_start()
        tables = [layout.name for layout in corpus.layouts]
        for counted, table in ((corpus.soft_confusion(p), tables[0]), (corpus.soft_vocab(p), tables[1])):
            lines = counted._jdf.queryExecution().executedPlan().toString().split("\n")
            at = next(i for i, line in enumerate(lines) if "FileScan" in line and table in line)
            depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
            above = [line for line in lines[:at] if len(line) - len(line.lstrip(" :+-")) < depth]
            join = max(i for i, line in enumerate(lines[:at]) if "Join" in line)
            assert not any("Exchange" in line for line in lines[join:at] if line in above), "\n".join(lines)
            assert "Bucketed: true" in lines[at]
        paths = [layout.path for layout in corpus.layouts]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
    corpus.release()
    from labelmesh.runtime import path_bytes

    assert not any(spark.catalog.tableExists(name) for name in tables)
    for path in paths:
        with pytest.raises(Exception, match="does not exist"):
            path_bytes(spark, path)
