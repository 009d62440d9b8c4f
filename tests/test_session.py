import pytest

from minutemill import session


def test_partitions_follow_the_input():
    def partitions(total):
        return int(session.conf_for_input(total)["spark.sql.shuffle.partitions"])

    assert partitions(1 << 20) == 200
    assert partitions(10 << 40) == 40_960
    assert partitions(100 << 40) == 409_600


def test_scratch_follows_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert first != second
    if shared:
        assert first.startswith(shared.rstrip("/"))


class _Cluster:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "yarn"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        session.scratch_path(_Cluster, "x")
