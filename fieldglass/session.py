"""Session defaults and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def local_session(app: str = "fieldglass", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset, in local mode only, one of our own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-fieldglass-")
    return _own_dirs[context.applicationId]


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fieldglass-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; only once no result of it is read any more."""
    _delete(spark, _scratch(spark))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as spark.sql.shuffle.partitions says, by keys.

    For stages that compute much on few bytes: adaptive execution would join their partitions by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Materialised:
    """A DataFrame written to the shared folder; reading it again needs none of the tasks that made it."""

    def __init__(self, df: DataFrame, name: str):
        self._spark = df.sparkSession
        self.path = f"{_scratch(self._spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing reads them any more."""
        _delete(self._spark, self.path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df by writing it to the shared folder."""
    return Materialised(df, name).df
