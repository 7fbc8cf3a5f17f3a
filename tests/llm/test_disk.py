"""Files on the disk while a query runs."""

import time

from graphlake.llm import common


def test_shuffle_files_go_with_the_action_that_made_them(spark, tmp_path):
    """Also where the table is kept in use, so that the driver's garbage collection can't remove them; results stay the same."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {b.toString() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.getAllBlocks()) if b.isShuffle()}
    with common.shuffles_removed(spark):
        known = files()
        df = spark.range(10_000).selectExpr("id % 500 as k").groupBy("k").count()
        first = common.written(df, f"{tmp_path}/a")
        kept = common.cut(df)
        assert [len(set(map(tuple, x.collect()))) for x in (first, kept, df, df)] == [500] * 4
        for _ in range(50):
            if not files() - known:
                break
            time.sleep(0.1)
        assert not files() - known
        assert sorted(map(tuple, df.toLocalIterator())) == sorted(map(tuple, kept.collect()))
    assert spark.conf.get(name, None) == before
