"""The shared folder: how it is found, and that it is left empty."""

import pytest

from dagmar.plans import fixpoint, lineage


def test_a_path_without_a_scheme_is_hadoops_to_resolve(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "_base", lambda _: str(tmp_path))
    assert lineage.shared_dir(spark).startswith("file:/")  # the default file system of these tests
    out = lineage.materialise(spark, spark.range(3))
    assert out.count() == 3 and len(list(tmp_path.iterdir())) == 1
    lineage.release(out)
    assert not list(tmp_path.iterdir())


def test_rounds_go_once_the_next_is_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "_base", lambda _: str(tmp_path))
    done = fixpoint.fixpoint(spark, spark.range(5), lambda df: df.selectExpr("greatest(id - 1, 0) AS id").distinct())
    assert len(list(tmp_path.iterdir())) == 1 and done.count() == 1
    lineage.release(done)
    assert not list(tmp_path.iterdir())


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage._base(Session())
