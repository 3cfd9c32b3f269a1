"""R13 with R10: counters and the blocks of the learning curve as keyed state per segment.

The log may arrive late and more than once.  Redelivered offers are dropped by
their event id within the watermark; each task then adds its rows up per
(segment, action, block of 50 rounds), so a segment with a third of the offers
sends a few rows to its state, not all of them.  The state of a segment
(``transformWithState``, RocksDB) holds the counters of its actions and a ring of
the eight newest blocks, which is what the 400-round window reads.  A block that
has left the ring is complete; rows that still come for it are written as
additions.  Each micro-batch writes a folder of its own, so a batch that runs
again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from churnkit.functions.columns import fixed, safe_div
from churnkit.functions.ordering import trailing_sums
from churnkit.operators.policy import CURVE_EVERY, CURVE_WINDOW, policy_grid
from churnkit.streaming.policy_stream import BATCH

OFFER_SCHEMA = "event_id long, ts timestamp, rodada long, segmento string, acao string, aceitou int"
PARTIAL = "segmento string, acao string, bloco long, n long, aceites long"
OUT = "tipo string, segmento string, chave string, n long, aceites long"
RING = CURVE_WINDOW // CURVE_EVERY
FILE_ROWS = 4_000_000  # offers of a whole log per file of a delivery (a delivery holds a quarter of them)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNT, BLOCK, LATE = "contador", "bloco", "atraso"


class SegmentState(StatefulProcessor):
    """Counters by action and the newest blocks of one segment; emits the new totals of what a batch touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pair = T.StructType([T.StructField("n", T.LongType()), T.StructField("aceites", T.LongType())])
        self.counts = handle.getMapState("counts", T.StructType([T.StructField("acao", T.StringType())]), pair)
        self.blocks = handle.getMapState("blocks", T.StructType([T.StructField("bloco", T.LongType())]), pair)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)
        out = []
        for acao, part in got.groupby("acao"):
            was = self.counts.getValue((acao,)) if self.counts.containsKey((acao,)) else (0, 0)
            now = (int(was[0] + part["n"].sum()), int(was[1] + part["aceites"].sum()))
            self.counts.updateValue((acao,), now)
            out.append((COUNT, key[0], acao, *now))
        held = {int(k[0]): (int(v[0]), int(v[1])) for k, v in self.blocks.iterator()}
        oldest = min(held) if len(held) >= RING else -1  # blocks before it have left the ring
        for bloco, part in got.groupby("bloco"):
            add = (int(part["n"].sum()), int(part["aceites"].sum()))
            if bloco < oldest and bloco not in held:
                out.append((LATE, key[0], str(bloco), *add))
                continue
            was = held.get(int(bloco), (0, 0))
            held[int(bloco)] = (was[0] + add[0], was[1] + add[1])
            self.blocks.updateValue((int(bloco),), held[int(bloco)])
            out.append((BLOCK, key[0], str(bloco), *held[int(bloco)]))
        for bloco in sorted(held)[:-RING]:
            self.blocks.removeKey((bloco,))
        yield pd.DataFrame(out, columns=["tipo", "segmento", "chave", "n", "aceites"])

    def close(self) -> None:
        pass


def deliver(log: DataFrame, parts: list[Column], log_dir: str) -> int:
    """Append the rows of each condition to ``log_dir``, in turn; the most files of one delivery, which are a micro-batch."""
    files = max(1, -(-log.count() // FILE_ROWS))
    for part in parts:
        log.where(part).coalesce(files).write.mode("append").parquet(log_dir)
    return files


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield b.groupby(["segmento", "acao", "bloco"], as_index=False).agg(n=("aceitou", "size"), aceites=("aceitou", "sum"))


def run_policy_state(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str, watermark: str = "1 day",
                     files_per_trigger: int = 1000, timeout: float = 600):
    """Process what has arrived under ``log_dir`` and stop; started again with the same
    ``checkpoint`` it goes on with new files.  ``watermark`` is how late an offer, or
    its second delivery, may come; what is later than that is dropped.  A run that
    isn't finished in ``timeout`` seconds raises ``TimeoutError``."""
    provider, width = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (provider, width)}
    spark.conf.set(provider, ROCKSDB)
    # every batch opens and commits a store per partition and stateful step: as many as run at once
    spark.conf.set(width, str(min(int(before[width]), max(1, spark.sparkContext.defaultParallelism))))
    try:
        log = spark.readStream.schema(OFFER_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(log_dir)
        once = log.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
        rows = once.select("segmento", "acao", F.floor((F.col("rodada") - 1) / CURVE_EVERY).cast("long").alias("bloco"),
                           F.col("aceitou").cast("long").alias("aceitou"))
        totals = rows.mapInPandas(_partial, PARTIAL).groupBy("segmento").transformWithStateInPandas(
            statefulProcessor=SegmentState(), outputStructType=OUT, outputMode="Append", timeMode="None")

        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("lote", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out_dir}/{BATCH}{batch_id:012d}")

        q = (totals.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        if not q.awaitTermination(timeout):
            q.stop()
            raise TimeoutError(f"the stream over {log_dir} was not finished after {timeout} seconds")
        return q
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """(tipo, segmento, chave, n, aceites): the last total of each counter and block, late rows added."""
    rows = spark.read.schema(f"{OUT}, lote long").parquet(f"{out_dir}/{BATCH}*")
    # a batch may bring a key's rows in several calls, each with a total; totals only grow
    last = (rows.where(F.col("tipo") != LATE).groupBy("tipo", "segmento", "chave").agg(F.max(F.struct("lote", "n", "aceites")).alias("t"))
            .select("tipo", "segmento", "chave", "t.n", "t.aceites"))
    late = rows.where(F.col("tipo") == LATE).select(F.lit(BLOCK).alias("tipo"), "segmento", "chave", "n", "aceites")
    return last.unionByName(late).groupBy("tipo", "segmento", "chave").agg(F.sum("n").alias("n"), F.sum("aceites").alias("aceites"))


def state_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """R5 from the stream: trials, accepts and rate of every segment and action."""
    c = _totals(spark, out_dir).where(F.col("tipo") == COUNT).select("segmento", F.col("chave").alias("acao"), F.col("n").alias("tentativas"), "aceites")
    return (policy_grid(spark).join(F.broadcast(c), ["segmento", "acao"], "left")  # segments x actions rows
            .select("segmento", "acao", F.coalesce("tentativas", F.lit(0)).cast("long").alias("tentativas"),
                    F.coalesce("aceites", F.lit(0)).cast("long").alias("aceites"),
                    fixed(safe_div("aceites", "tentativas"), 4).alias("taxa_estimada"), "posicao"))


def state_curve(spark: SparkSession, out_dir: str) -> DataFrame:
    """R10 from the stream: acceptance over the last 400 rounds, at every complete block of 50."""
    b = _totals(spark, out_dir).where(F.col("tipo") == BLOCK).groupBy(F.col("chave").cast("long").alias("bloco")).agg(
        F.sum("n").alias("n"), F.sum("aceites").alias("aceites")).where(F.col("n") == CURVE_EVERY)
    win = trailing_sums(b, "bloco", ["n", "aceites"], RING)
    return win.select(((F.col("bloco") + 1) * CURVE_EVERY).cast("long").alias("rodada"), fixed(F.col("aceites_win") / F.col("n_win"), 4).alias("taxa_aceite"))
