"""Session set-up and the scale rules shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Long projections of string functions: methods beyond the JVM's compile limit would stay
# interpreted, so let Spark split them instead of fusing them into one stage method.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

BROADCAST_ROWS = 200_000  # narrow lookup rows that may be sent to every executor
SALTS = 32


def local_session(cores: int | str = 8, memory: str = "16g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("urlspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for local runs without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="urlspark-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for one intermediate table or sink."""
    return f"{checkpoint_dir(spark).rstrip('/')}/urlspark/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store the path names; a missing one is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written once, survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # of rows handed to Python at once; one larger row goes alone


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on the session hands rows to Python in batches of some MB, however long its rows are."""
    if spark.conf.get(BATCH) not in (str(size), f"{size}b"):
        spark.conf.set(BATCH, str(size))


SPREAD_SPLITS = 32  # a source of more splits is big enough to be left alone, whatever the cluster


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a small source has fewer splits than there are cores.

    Only sources of a few splits are shuffled, i.e. at most some 4 GB at the default split
    size; the cost of the shuffle is bounded however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= min(cores, SPREAD_SPLITS):
        return df
    return df.repartition(cores)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; looks at no more than max_rows + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a big left side to a lookup with unique keys, whatever the lookup's size.

    Up to ``max_rows`` the lookup is broadcast (checked first). Beyond that both sides
    are shuffled on key and salt: the lookup is copied per salt and left rows draw one
    from their content, so a key holding a third of all rows is spread over many tasks.
    """
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, how)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """The shuffled half of ``lookup_join``."""
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


FREQUENT = 1_000  # keys that are salted; any other has less than a thousandth of the rows


def frequent_join(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """``left`` joined to ``right``, which has one row per key and knows how many ``rows`` of ``left`` each key has.

    Only the most frequent keys and null are spread over several tasks, so a right side as large as the left one is not
    copied per salt. Those keys are broadcast, at most ``FREQUENT`` of them.
    """
    top = right.where(F.col(key).isNotNull()).orderBy(F.desc(rows), key).limit(FREQUENT)
    top = F.broadcast(top.select(F.col(key), F.lit(True).alias("_often")))
    often = F.coalesce("_often", F.lit(False))
    drawn = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    dealt = left.join(top, key, "left").withColumn("_salt", F.when(often | F.col(key).isNull(), drawn).otherwise(0)).drop("_often")
    salts = F.sequence(F.lit(0), F.when(often, SALTS - 1).otherwise(0))
    copies = right.join(top, key, "left").withColumn("_salt", F.explode(salts)).drop("_often", rows)
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")
