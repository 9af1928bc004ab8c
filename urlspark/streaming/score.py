"""URLs arriving as a stream: features and scores with frozen models.

Nothing here keeps state: features are a projection, the vocabulary and the trees are fixed.
The batch operators are used unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from urlspark.plans.scoring import Scorer, score_urls

URL_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("url", T.StringType())])


def read_url_stream(spark: SparkSession, path: str, schema: T.StructType = URL_SCHEMA,
                    name_filter: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in ``path``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet (exactly once per file sink); ``available_now`` handles what is there and stops."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def write_batches(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Handles what is there and stops; each batch is a folder of its own, which a batch that runs again overwrites.

    So a stream that is stopped between writing a batch and noting it repeats nothing, in any store. ``read_batches`` reads
    the table.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table that ``write_batches`` writes."""
    return spark.read.parquet(path).drop("batch")


def score_batches(urls: DataFrame, scorer: Scorer, path: str, checkpoint: str) -> StreamingQuery:
    """Score what has arrived of a URL stream since the last call, rejected URLs with their reason."""
    return write_batches(score_urls(urls, scorer), path, checkpoint)


def score_stream(urls: DataFrame, scorer: Scorer, path: str, checkpoint: str, available_now: bool = True):
    """Score a URL stream into Parquet: row_id, url, feature_error, prob_1, prediction."""
    return write_stream(score_urls(urls, scorer), path, checkpoint, available_now)
