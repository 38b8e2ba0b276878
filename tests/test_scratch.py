from pathlib import Path

import pytest

from quiresift import scratch


def test_tables_go_with_their_block(spark):
    with scratch.freed():
        first = scratch.keep(spark.range(5), "first")
        last = scratch.keep(first.selectExpr("id * 2 AS id"), "last", lasting=True)
        with scratch.freed():
            inner = scratch.keep(spark.range(2), "inner")
        assert not Path(inner._kept_at).exists() and Path(first._kept_at).exists()
    assert not Path(first._kept_at).exists() and sorted(r.id for r in last.collect()) == [0, 2, 4, 6, 8]
    scratch.drop(last)
    assert not Path(last._kept_at).exists()
    plain = scratch.keep(spark.range(1), "plain")
    assert plain.count() == 1


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:
            class sc:
                class getCheckpointDir:
                    def isDefined(self):
                        return False

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
