"""The shared folder comes from settings only."""

import pytest

from depot.operators.durable import shared_dir, small_table


class Session:
    def __init__(self, **settings):
        self.conf = settings


@pytest.mark.parametrize(
    "settings, folder",
    [
        ({"spark.checkpoint.dir": "/a/"}, "/a"),
        ({"spark.depot.shared.dir": "hdfs://x/b"}, "hdfs://x/b"),
        ({"spark.checkpoint.dir": "/a", "spark.depot.shared.dir": "/b"}, "/a"),
    ],
)
def test_folder_of_settings(settings, folder):
    assert shared_dir(Session(**settings)) == folder


def test_no_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_small_table_takes_any_text(spark):
    texts = ["it's", "a\\b", "\\'", 'say "x"']
    got = small_table(spark, [(t, 1) for t in texts], "t, n")
    assert [r.t for r in got.collect()] == texts
