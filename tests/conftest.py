import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from flowlens.session import BASE_CONF

    b = SparkSession.builder.master("local[*]").appName("flowlens-tests")
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "8")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from flowlens.session import ensure_checkpoint_dir

    # The session's spark.checkpoint.dir is used; a scratch folder only when it is unset.
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
