"""The shared checkpoint folder: taken from the session, made only for a local master, removable."""

import os

import pytest

from riskloom import session


class FakeConf:
    def get(self, *_):
        return None


class FakeSession:
    conf = FakeConf()

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return FakeConf()


def test_unset_folder_is_an_error_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(FakeSession())


def test_scratch_tables_are_released(spark, tmp_path):
    path = session.scratch_path(spark, "kept-for-a-while")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert session.release_scratch(spark)
    assert not os.path.exists(path)


def test_calls_run_side_by_side_and_keep_their_order():
    import threading

    from riskloom.session import at_once
    met = threading.Barrier(3, timeout=30)                     # passes only when all three are running

    def call(i):
        met.wait()
        return i

    assert at_once([lambda i=i: call(i) for i in range(3)]) == [0, 1, 2]
    with pytest.raises(ZeroDivisionError):
        at_once([lambda: 1 // 0, lambda: 1])


def test_the_two_threat_fits_run_side_by_side():
    import inspect

    from riskloom.ml import classify
    assert "at_once(" in inspect.getsource(classify.train_threat)
