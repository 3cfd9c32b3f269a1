"""Policy counters updated as offer feedback arrives (Structured Streaming).

The offer log is read as a file stream; a stateful ``groupBy(segment,
action)`` keeps trials and accepts; each micro-batch writes the complete
counter table (bounded by segments x actions) to a folder of its own, named by
the batch, and readers take the last complete one.  A batch that is run again
after a failure rewrites its own folder only, so a reader never finds a table
half written.  The checkpoint folder makes the query restartable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([T.StructField("CustomerID", T.LongType()),
                           T.StructField("segmento", T.StringType()),
                           T.StructField("acao", T.StringType()),
                           T.StructField("aceitou", T.IntegerType())])


def counters(stream: DataFrame) -> DataFrame:
    return stream.groupBy("segmento", "acao").agg(
        F.count(F.lit(1)).alias("tentativas"), F.sum(F.col("aceitou").cast("long")).alias("aceites"))


def run_policy_stream(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str,
                      files_per_trigger: int = 1000, available_now: bool = True, timeout: float = 600):
    """Start the stream over ``log_dir``; with ``available_now`` process what is
    there and stop.  Returns the finished (or running) StreamingQuery; raises
    ``TimeoutError`` (after stopping the query) if it isn't finished in
    ``timeout`` seconds, so unfinished counters are never taken for the result."""
    src = (spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
                .parquet(log_dir))

    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/{BATCH}{batch_id:012d}")

    w = (counters(src).writeStream.outputMode("complete").foreachBatch(sink)
                      .option("checkpointLocation", checkpoint))
    q = w.trigger(availableNow=True).start() if available_now else w.start()
    if available_now and not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError(f"the stream over {log_dir} was not finished after {timeout} seconds")
    return q


BATCH = "batch-"


def read_counters(spark: SparkSession, out_dir: str) -> DataFrame:
    """The counter table of the last batch that was written completely."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith(BATCH)
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return spark.read.parquet(str(max(done, key=lambda p: p.getName()).toString()))
