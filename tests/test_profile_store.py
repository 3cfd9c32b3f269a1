"""Sketches per file merge in any order to the profile of all files; only new files are read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.operators import profile_store as ps


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else f"v{rng.randrange(90)}", f"u{i}", None if i % 5 == 0 else rng.gauss(0, 10)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, few string, many string, x double")
    out = [str(tmp_path_factory.mktemp("p") / f"part{k}") for k in range(3)]
    for k, p in enumerate(out):
        df.where(F.col("id") % 3 == k).repartition(2).write.parquet(p)
    return rows, out


def table(df):
    return sorted(map(str, df.collect()))


def test_close_to_the_exact_profile(spark, folders, tmp_path):
    rows, paths = folders
    store = ps.ProfileStore(spark, str(tmp_path / "s"))
    assert len(store.add(paths)) == 6
    got = {r["coluna"]: r for r in store.columns().collect()}
    assert {c: (r["linhas"], r["nulos"]) for c, r in got.items()} == {
        "id": (20000, 0), "few": (20000, 1177), "many": (20000, 0), "x": (20000, 4000)}
    assert got["few"]["distintos"] == 90
    for c, n in (("many", 20000), ("id", 20000)):
        assert abs(got[c]["distintos"] - n) < 0.03 * n
    xs = np.sort([r[3] for r in rows if r[3] is not None])
    for q in (0.25, 0.5, 0.75):
        rank = np.searchsorted(xs, got["x"][f"q{int(q * 100)}"]) / len(xs)
        assert abs(rank - q) < 0.005
    few = {}
    for r in rows:
        few[r[1]] = few.get(r[1], 0) + 1
    top = store.top_values("few", 5).collect()
    assert [(r["valor"], r["contagem"], r["erro"]) for r in top] == [(v, n, 0) for v, n in sorted(few.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))[:5]]


def test_any_order_and_only_new_files(spark, folders, tmp_path):
    _, paths = folders
    a, b = ps.ProfileStore(spark, str(tmp_path / "a")), ps.ProfileStore(spark, str(tmp_path / "b"))
    a.add(paths)
    for p in (paths[2], paths[0], paths[1]):
        assert len(b.add([p])) == 2 and b.add([p]) == []
    assert a.files() == b.files()
    exact = ["coluna", "linhas", "nulos", "distintos"]
    assert table(a.columns().select(*exact)) == table(b.columns().select(*exact))
    assert table(a.top_values("few")) == table(b.top_values("few"))
    x = {n: s.columns().where("coluna = 'x'").first() for n, s in (("a", a), ("b", b))}
    assert all(abs(x["a"][q] - x["b"][q]) < 0.3 for q in ("q25", "q50", "q75"))  # of a spread of 10


def test_values_beyond_the_kept_ones_are_bounded_by_the_error(spark, folders, tmp_path, monkeypatch):
    rows, paths = folders
    monkeypatch.setattr(ps, "MAX_VALUES", 30)
    store = ps.ProfileStore(spark, str(tmp_path / "s"))
    store.add(paths)
    exact = {}
    for r in rows:
        exact[r[1]] = exact.get(r[1], 0) + 1
    for r in store.top_values("few", 90).collect():
        assert r["contagem"] <= exact[r["valor"]] <= r["contagem"] + r["erro"]


def test_a_failed_run_is_made_good(spark, folders, tmp_path):
    """Values that were written without their sketches don't count twice once the file is read again."""
    _, paths = folders
    whole, broken = ps.ProfileStore(spark, str(tmp_path / "w")), ps.ProfileStore(spark, str(tmp_path / "b"))
    whole.add(paths[:1])
    broken.files()
    ps.sketch_files(spark.read.parquet(paths[0]))[1].write.mode("append").parquet(f"{broken.base}/values")  # then it died
    broken.add(paths[:1])
    assert table(whole.top_values("few")) == table(broken.top_values("few"))
