"""What the operators share: the shared folder, scratch tables, private names."""

from types import SimpleNamespace

import pytest

from lakequill.llm import common


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077"))
    assert common.shared_dir(session("spark://host:7077", "hdfs://n/x")) == "hdfs://n/x" and common.shared_dir(session("yarn", "/shared")) == "file:///shared"
    assert common.shared_dir(session("local[2]")).startswith("file:///")


def test_written_tables_are_released(spark):
    t = common.materialise(spark.range(10).toDF("a"))
    path = t.inputFiles()[0]
    assert t.count() == 10 and t.dtypes == [("a", "bigint")]
    common.release(t, spark.range(3))  # what was not written is left alone
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_private_names_are_new_whatever_the_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ID_ int, `x.y` int, text__ int")
    assert common.private(df, "id", "text") == ["id___", "text___"] and df.select(common.named("x.y")).first()[0] == 2
