import os

from tarnish import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, **conf):
        self.conf = Conf(conf)


def test_scratch_folder_is_the_configured_one():
    fake = Fake(**{"spark.checkpoint.dir": "hdfs:///shared", "spark.sql.warehouse.dir": "hdfs:///w"})
    assert session.scratch_dir(fake) == "hdfs:///shared"


def test_warehouse_stands_in_for_an_unset_folder():
    assert session.scratch_dir(Fake(**{"spark.sql.warehouse.dir": "hdfs:///w/"})) == "hdfs:///w/tarnish-scratch"


def folder(table):
    return table.scratch_path.removeprefix("file:")


def test_a_scope_leaves_nothing_behind(spark):
    with session.scratch_scope(spark):
        outer = session.materialise(spark.range(3), "a")
        with session.scratch_scope(spark):
            inner = session.materialise(spark.range(3), "b")
            assert inner.count() == 3
        assert not os.path.exists(folder(inner)) and os.path.exists(folder(outer))
    assert not os.path.exists(folder(outer))


def test_discard_removes_one_table(spark):
    one, two = (session.materialise(spark.range(2), x) for x in "ab")
    session.discard(one)
    assert not os.path.exists(folder(one)) and two.count() == 2
    session.discard(two)
