"""Atomic, versioned publication of tables and models.

A publication writes its members into a folder of its own, reads them back to
count and digest them, and last of all adds one manifest file to the commit log.
That file appears by one rename, so a reader sees a publication whole or not at
all; whatever a failed one wrote is never referred to.  Versions are never
changed, so a reader that resolved one can go on reading it.  One writer at a
time is assumed; if two take the same number, the log holds both and the later
attempt id is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = ("versao long, tentativa string, membro string, caminho string, linhas long, digest long, membros int, "
          "metrica double, promovida boolean, lote string")


def digest_of(df: DataFrame) -> tuple[int, int]:
    """(rows, an order-independent digest of their values): every row's hash, with how often it occurs, in one sum modulo 2^62."""
    each = df.select(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns]).alias("h"))
    row = each.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod("h", F.lit(1 << 62)).cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0) % (1 << 62)


def commit(spark: SparkSession, base: str, rows: Sequence[tuple]) -> None:
    """Add the manifest rows of one publication: one file, so one rename."""
    spark.createDataFrame(list(rows), COMMIT).coalesce(1).write.mode("append").json(f"{base}/commits")


def commits(spark: SparkSession, base: str) -> DataFrame:
    """The manifest rows of every complete publication."""
    spark.createDataFrame([], COMMIT).write.mode("ignore").json(f"{base}/commits")
    rows = spark.read.schema(COMMIT).json(f"{base}/commits")
    whole = rows.groupBy("tentativa").agg(F.count(F.lit(1)).alias("n"), F.first("membros").alias("m")).where("n = m").select("tentativa")
    return rows.join(whole, "tentativa", "left_semi")


def current(spark: SparkSession, base: str, version: int | None = None) -> list:
    """Manifest rows of the last promoted version (or of ``version``, promoted or not); empty if there is none."""
    log = commits(spark, base)
    log = log.where("promovida") if version is None else log.where(F.col("versao") == version)
    last = log.agg(F.max(F.struct("versao", "tentativa")).alias("v")).first()["v"]
    return [] if last is None else log.where((F.col("versao") == last["versao"]) & (F.col("tentativa") == last["tentativa"])).collect()


def publish(spark: SparkSession, base: str, tables: dict[str, DataFrame], models: dict[str, Callable[[str], None]] | None = None,
            metric: float | None = None) -> tuple[int, bool]:
    """Write the members as the next version; (version, whether it was promoted).

    ``models`` are functions that save something at a path they are given.  With a
    ``metric``, the version is promoted only if it does not lose against the
    promoted one (the challenger wins ties); a loser stays in the log, for
    reading by its number.  If a member can't be written, nothing is committed
    and the error is raised.
    """
    attempt = uuid.uuid4().hex
    before = current(spark, base)
    held = before[0]["metrica"] if before else None
    promoted = metric is None or held is None or metric >= held
    last = commits(spark, base).agg(F.max("versao")).first()[0] or 0
    members = len(tables) + len(models or {})
    if not members:
        raise ValueError("nothing to publish")
    rows = []
    for name, df in tables.items():
        path = f"{base}/data/{attempt}/{name}"
        df.write.parquet(path)
        n, digest = digest_of(spark.read.parquet(path))
        rows.append((name, path, n, digest))
    for name, save in (models or {}).items():
        path = f"{base}/data/{attempt}/{name}"
        save(path)
        rows.append((name, path, None, None))
    commit(spark, base, [(last + 1, attempt, name, path, n, digest, members, metric, promoted, None) for name, path, n, digest in rows])
    return last + 1, promoted


def path_of(spark: SparkSession, base: str, member: str, version: int | None = None) -> str:
    """Where a member of the current (or a given) version lies; KeyError if it isn't there."""
    for r in current(spark, base, version):
        if r["membro"] == member:
            return r["caminho"]
    raise KeyError(f"{member} was not published" + ("" if version is None else f" in version {version}"))


def read_member(spark: SparkSession, base: str, member: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(path_of(spark, base, member, version))


def changed_members(spark: SparkSession, base: str, version: int | None = None) -> list[str]:
    """Members whose files no longer have the rows that the manifest names."""
    found = current(spark, base, version)
    return [r["membro"] for r in found if r["linhas"] is not None and digest_of(spark.read.parquet(r["caminho"])) != (r["linhas"], r["digest"])]
