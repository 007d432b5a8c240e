import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from panelspark.storage import clear, discard, stash


def test_stash_and_clear(spark):
    df = spark.range(5)
    kept = stash(df, "t")
    assert kept.dtypes == df.dtypes and kept.count() == 5
    clear(spark)
    with pytest.raises((PySparkException, Py4JJavaError)):
        kept.collect()


def test_discard_takes_its_tables_alone(spark):
    gone, kept, plain = stash(spark.range(5), "a"), stash(spark.range(7), "b"), spark.range(3)
    discard(gone, plain)
    assert kept.count() == 7 and plain.count() == 3
    with pytest.raises((PySparkException, Py4JJavaError)):
        gone.collect()
