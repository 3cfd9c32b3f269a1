"""Versions are seen whole or not at all; buckets are rewritten only where rows changed."""

import pytest
from pyspark.sql import functions as F

from churnkit.operators import policy as pol
from churnkit.operators import serving as sv
from churnkit.plans.context import Chain
from churnkit.sources import publish as pb
from churnkit.sources.upsert import BucketTable, bucket_of
from conftest import SF_SMALL


@pytest.fixture
def table(spark):
    return lambda *v: spark.createDataFrame([(x,) for x in v], "x long")


def values(spark, base, member="t", **more):
    return sorted(r["x"] for r in pb.read_member(spark, base, member, **more).collect())


def test_a_failed_write_leaves_the_old_version(spark, table, tmp_path):
    base = str(tmp_path)
    assert pb.current(spark, base) == []
    with pytest.raises(KeyError):
        pb.read_member(spark, base, "t")
    assert pb.publish(spark, base, {"t": table(1, 2), "u": table(9)}) == (1, True)
    broken = table(5).select(F.raise_error(F.lit("no")).cast("long").alias("x"))
    for members in ({"t": table(3), "u": broken}, {"u": broken, "t": table(3)}):
        with pytest.raises(Exception, match="no"):
            pb.publish(spark, base, members)
        assert values(spark, base) == [1, 2] and values(spark, base, "u") == [9]
    assert pb.publish(spark, base, {"t": table(3)}) == (2, True)
    assert values(spark, base) == [3] and values(spark, base, version=1) == [1, 2]
    with pytest.raises(KeyError):  # a version is what was published with it
        pb.read_member(spark, base, "u")


def test_half_a_manifest_is_not_a_version(spark, table, tmp_path):
    base = str(tmp_path)
    pb.publish(spark, base, {"t": table(1)})
    pb.commit(spark, base, [(2, "x", "t", "/nowhere", 1, 1, 2, None, True, None)])  # one of two rows
    assert values(spark, base) == [1]
    assert pb.publish(spark, base, {"t": table(4)})[0] == 2


def test_a_loser_is_not_promoted(spark, table, tmp_path):
    base = str(tmp_path)
    assert pb.publish(spark, base, {"t": table(1)}, metric=0.7) == (1, True)
    assert pb.publish(spark, base, {"t": table(2)}, metric=0.6) == (2, False)
    assert values(spark, base) == [1] and values(spark, base, version=2) == [2]
    assert pb.publish(spark, base, {"t": table(3)}, metric=0.65) == (3, False)  # against the promoted one, not the last
    assert pb.publish(spark, base, {"t": table(4)}, metric=0.7) == (4, True)    # ties win
    assert values(spark, base) == [4]


def test_models_and_changed_files(spark, table, tmp_path):
    from pyspark.ml.feature import VectorAssembler, VectorAssembler as V
    base = str(tmp_path)
    pb.publish(spark, base, {"t": table(1, 1, 2)}, {"m": lambda p: VectorAssembler(inputCols=["x"], outputCol="v").write().save(p)})
    assert V.load(pb.path_of(spark, base, "m")).getOutputCol() == "v"
    assert pb.changed_members(spark, base) == []
    table(1, 2, 2).write.mode("overwrite").parquet(pb.path_of(spark, base, "t"))  # as many rows, other values
    assert pb.changed_members(spark, base) == ["t"]


def test_digest_ignores_order_and_counts_repeats(spark, table):
    assert pb.digest_of(table(1, 2, 3).repartition(3)) == pb.digest_of(table(3, 2, 1))
    assert pb.digest_of(table(1, 1, 2)) != pb.digest_of(table(1, 2, 2))
    assert pb.digest_of(table(1).where("false")) == (0, 0)


def test_upserts_equal_the_whole_log(spark, tmp_path):
    """After three increments (one delivered twice) the state is that of the whole log; untouched buckets keep their files."""
    c = Chain(spark, SF_SMALL)
    log = c.offer_events.cache()
    t = BucketTable(spark, str(tmp_path / "t"), sv.OFFER_STATE, "CustomerID", buckets=8)
    t.create(sv.never_contacted(c.segments))
    with pytest.raises(ValueError):
        t.create(sv.never_contacted(c.segments))
    whole = sorted(map(str, sv.next_best_offer(c.segments, log, c.order).collect()))
    few = log.where("CustomerID in (3, 4)")
    rest = log.where("CustomerID not in (3, 4)")
    before = t.places()
    touched = t.upsert(sv.offer_state(few.where("event_id % 2 = 0")), sv.merge_offer_state, "a")
    assert touched == sorted({r[0] for r in spark.createDataFrame([(3,), (4,)], "CustomerID long").select(bucket_of("CustomerID", 8)).collect()})
    after = t.places()
    assert {b for b in after if after[b] != before[b]} == set(touched)
    t.upsert(sv.offer_state(few.where("event_id % 2 = 1")), sv.merge_offer_state, "b")
    assert t.upsert(sv.offer_state(few.where("event_id % 2 = 0")), sv.merge_offer_state, "a") == []  # delivered again
    t.upsert(sv.offer_state(rest), sv.merge_offer_state, "c")
    assert sorted(map(str, sv.next_offer_of(t.read(), c.order).collect())) == whole
    assert t.upsert(sv.offer_state(log.where("false")), sv.merge_offer_state, "d") == [] and t.versions() == 5
    assert t.read().count() == c.segments.count()


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "k long, v long", "k", buckets=4)
    t.create(spark.range(20).selectExpr("id as k", "0L as v"))
    new = spark.createDataFrame([(3, 9)], "k long, v long")

    def broken(old, changes):
        return old.withColumn("v", F.raise_error(F.lit("no")).cast("long"))

    with pytest.raises(Exception, match="no"):
        t.upsert(new, broken, "x")
    assert t.read().where("v <> 0").isEmpty() and t.read().count() == 20
    t.upsert(new, lambda old, c: old.join(c.withColumnRenamed("v", "n"), "k", "left").selectExpr("k", "coalesce(n, v) as v"), "x")
    assert [tuple(r) for r in t.read().where("v <> 0").collect()] == [(3, 9)]


def test_offer_state_of_a_customer(spark):
    log = spark.createDataFrame([(1, "suporte", 0), (1, "bonus", 0), (1, "suporte", 0), (2, "upgrade", 1), (2, "bonus", 1)], "CustomerID long, acao string, aceitou int")
    got = {r["CustomerID"]: tuple(r)[1:] for r in sv.offer_state(log).collect()}
    place = {a: k for k, (a, _, _) in enumerate(pol.ACTIONS)}
    assert got[1] == (0, 0, 3, (1 << place["suporte"]) | (1 << place["bonus"]))
    assert got[2][:3] == (1, 95, 2)
