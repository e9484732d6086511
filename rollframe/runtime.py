"""Session, table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; callers pass narrow rows only (some tens of bytes each).
BROADCAST_ROWS = 100_000


def get_spark(app: str = "rollframe", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the tests use; on a cluster pass the cluster's own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="rollframe-")
    atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the result survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


class Scratch:
    """A written table in the shared folder. Unlike a checkpoint it is columnar: later reads prune its columns."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/rollframe/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.path)

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path)
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    return Scratch(df.sparkSession, name).write(df)


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str, small_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a counted side: broadcast up to `limit` rows, else a shuffle join that AQE may split where a key is hot."""
    side = F.broadcast(small) if small_rows <= limit else small.hint("shuffle_merge")
    return big.join(side, on, how)


def join_salted(big: DataFrame, small: DataFrame, on: list[str], how: str, salt, salts: int) -> DataFrame:
    """Equi-join in which each key of `big` is spread over `salts` tasks; `small` is repeated that often.

    `salt` is a column of `big` that spreads the rows of one key (say a hash of the row's id)."""
    b = big.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return b.join(s, [*on, "_salt"], how).drop("_salt")
