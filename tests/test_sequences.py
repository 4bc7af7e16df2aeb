"""Series operators against pandas, with one entity holding most rows and small chunks."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchspark.operators import joins, sequences
from matchspark.plans import lookups
from matchspark.session import shared_dir


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 900
    team = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 9, n))
    day = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 25, n), unit="D")
    value = rng.normal(size=n)
    value[rng.random(n) < 0.2] = np.nan
    return pd.DataFrame({"team": team, "day": day.date, "id": np.arange(n), "x": value})


@pytest.fixture(scope="module")
def df(spark, frame):
    raw = spark.createDataFrame(frame.sample(frac=1.0, random_state=1))
    return raw.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def collected(df, *names):
    return df.orderBy("id").select("id", *names).toPandas()


def ordered(frame):
    return frame.sort_values(["team", "day", "id"])


def same(got, expected):
    np.testing.assert_allclose(
        got.astype(float).to_numpy(), expected.astype(float).to_numpy(), rtol=1e-9, atol=1e-12, equal_nan=True
    )


@pytest.mark.parametrize("chunk", [7, 40, None])
def test_bounded_frames(df, frame, chunk):
    rows = sequences.number(df, ["team"], ["day", "id"], F.col("day"))
    trailing = {f"mean_{w}": sequences.trailing_mean("x", w) for w in (3, 5, 10)}
    trailing["sum_5"] = sequences.trailing_sum("x", 5)
    trailing["tail_5"] = sequences.tail_weighted_mean("x", 5)
    weighted = {f"ewm_{w}": ("x", w) for w in (2, 3, 5, 10, 40)}
    got = collected(sequences.form(rows, ["team"], "seq", trailing, weighted, chunk=chunk), "seq", *trailing, *weighted)
    assert len(got) == len(frame)
    grouped = ordered(frame).groupby("team")["x"]
    for w in (3, 5, 10):
        expected = grouped.transform(lambda s, w=w: s.shift(1).rolling(w, min_periods=1).mean()).sort_index()
        same(got[f"mean_{w}"], expected)
    same(got["sum_5"], grouped.transform(lambda s: s.shift(1).rolling(5, min_periods=1).sum()).sort_index())
    for w in (2, 3, 5, 10, 40):
        same(got[f"ewm_{w}"], grouped.transform(lambda s, w=w: s.shift(1).ewm(span=w, min_periods=1).mean()).sort_index())
    tail = grouped.transform(lambda s: [s.iloc[max(0, i - 4) : i + 1].ewm(span=5).mean().iloc[-1] for i in range(len(s))])
    same(got["tail_5"], tail.sort_index())
    same(got["seq"], ordered(frame).groupby("team").cumcount().sort_index())


def test_unbounded_frames(df, frame):
    measures = {
        "n": sequences.count_of(F.col("x")),
        "s": sequences.sum_of(F.col("x")),
        "m": sequences.max_of(F.col("x")),
        "l": sequences.last_of(F.col("x")),
    }
    ran = sequences.running(df, ["team"], ["day", "id"], F.col("day"), measures)
    w = Window.partitionBy("team").orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        "id", F.count("x").over(w).alias("n"), F.sum("x").over(w).alias("s"), F.max("x").over(w).alias("m"),
        F.last("x", True).over(w).alias("l"),
    )
    got, expected = collected(ran, *measures), collected(plain, *measures)
    for c in measures:
        same(got[c], expected[c])


def test_future_rows_never_matter(df):
    def features(d):
        rows = sequences.number(d, ["team"], ["day", "id"], F.col("day"))
        return sequences.form(rows, ["team"], "seq", {"m": sequences.trailing_mean("x", 5)}, {"e": ("x", 5)}, chunk=16)

    cut_day = F.lit("2024-01-15").cast("date")
    changed = df.withColumn("x", F.when(F.col("day") >= cut_day, 1000.0).otherwise(F.col("x")))
    early = F.col("day") < cut_day
    a, b = collected(features(df).filter(early), "m", "e"), collected(features(changed).filter(early), "m", "e")
    pd.testing.assert_frame_equal(a, b)


def test_no_group_exceeds_chunk_and_reach(df, monkeypatch):
    rows = sequences.number(df, ["team"], ["day", "id"], F.col("day"))
    size = sequences.Trailing(3, lambda w: F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    largest = sequences.form(rows, ["team"], "seq", {"size": size}, chunk=32).agg(F.max("size")).first()[0]
    assert largest == 35


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.choice([1, 1, 1, 2, 3], 300), "t": rng.integers(0, 50, 300), "id": np.arange(300)})
    right = pd.DataFrame({"k": rng.choice([1, 1, 2], 120), "t": rng.integers(0, 50, 120), "v": np.arange(120)})
    found = joins.asof(
        spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "t", ["v"],
        lambda t: F.floor(t / 10), strict=strict, tie=["v"],
    )
    got = found.orderBy("id").toPandas()["v"]
    expected = pd.merge_asof(
        left.sort_values(["t", "id"]), right.sort_values(["t", "v"]), on="t", by="k", allow_exact_matches=not strict
    ).sort_values("id")["v"]
    same(got, expected.reset_index(drop=True))


def test_interval_sums(spark):
    rng = np.random.default_rng(4)
    left = pd.DataFrame({"k": rng.choice([1, 1, 2, 5], 200), "t": rng.integers(0, 60, 200), "id": np.arange(200)})
    events = pd.DataFrame({"k": rng.choice([1, 2], 400), "t": rng.integers(0, 60, 400), "w": rng.integers(1, 5, 400)})
    got = joins.interval_sums(
        spark.createDataFrame(left), spark.createDataFrame(events), ["k"], ["id"], "t", "t", F.col("t") - 7,
        {"n": F.lit(1), "w": F.col("w")}, lambda t: F.floor(t / 10),
    ).orderBy("id").toPandas()
    for _, row in left.iterrows():
        hit = events[(events.k == row.k) & (events.t <= row.t) & (events.t >= row.t - 7)]
        assert got.loc[row.id, "n"] == len(hit) and got.loc[row.id, "w"] == hit.w.sum()


def test_dedupe_and_last_rows(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k int, t int, v string")
    first = sequences.dedupe(df, ["k"], [F.col("t")])
    last = sequences.dedupe(df, ["k"], [F.col("t")], keep="last")
    assert sorted(r.v for r in first.collect()) == ["a", "c"]
    assert sorted(r.v for r in last.collect()) == ["b", "c"]
    assert {r.v for r in sequences.last_rows(df, ["k"], [F.col("t")], 1).collect()} == {"b", "c"}


def test_dimension_keys_must_be_unique(spark):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert joins.unique_dimension(good, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        joins.unique_dimension(good.union(good), ["k"]).collect()


@pytest.mark.parametrize("strict", [False, True])
def test_asof_by_days(spark, strict):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": rng.choice([1, 1, 1, 2, 3], 300), "t": rng.integers(0, 50, 300), "id": np.arange(300)})
    right = pd.DataFrame({"k": rng.choice([1, 1, 2], 120), "t": rng.integers(0, 50, 120), "v": np.arange(120)})
    found = joins.asof(
        spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "t", ["v"], None, strict=strict, tie=["v"],
    )
    assert found.columns == ["k", "t", "id", "v"]
    expected = pd.merge_asof(
        left.sort_values(["t", "id"]), right.sort_values(["t", "v"]), on="t", by="k", allow_exact_matches=not strict
    ).sort_values("id")["v"]
    same(found.orderBy("id").toPandas()["v"], expected.reset_index(drop=True))


@pytest.mark.parametrize("strict", [False, True])
def test_asof_by_days_treats_nulls_as_blocks_do(spark, strict):
    left = spark.createDataFrame([(1, None, 1), (1, 5, 2), (None, 5, 3), (2, 3, 4), (2, None, 5), (2, 3, 4)], "k int, t int, id int")
    right = spark.createDataFrame([(1, None, 10), (1, 9, 11), (None, 1, 12), (2, 3, None), (2, 2, 14)], "k int, s int, v int")
    rows = [
        sorted(map(str, joins.asof(left, right, ["k"], "t", "s", ["v"], block, strict=strict, tie=["v"]).collect()))
        for block in (None, lambda t: t)
    ]
    assert rows[0] == rows[1] and len(rows[0]) == 6


def test_frames_and_weighted_means_share_a_shuffle(df):
    rows = sequences.number(df, ["team"], ["day", "id"], F.col("day"))
    trailing, weighted = {"m": sequences.trailing_mean("x", 5)}, {"e": ("x", 5)}
    both = sequences.form(rows, ["team"], "seq", trailing, weighted)
    alone = sequences.form(rows, ["team"], "seq", weighted=weighted)
    shuffles = lambda f: f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(both) == shuffles(alone)
    apart = sequences.form(sequences.form(rows, ["team"], "seq", trailing), ["team"], "seq", weighted=weighted)
    pd.testing.assert_frame_equal(collected(both, "m", "e"), collected(apart, "m", "e"))
    far = sequences.form(rows, ["team"], "seq", {"m": sequences.trailing_mean("x", 700)}, weighted)
    assert far.columns == [*rows.columns, "m", "e"] and collected(far, "e").equals(collected(apart, "e"))


def test_domestic_form_shuffles_the_last_matches_of_a_day(spark):
    """A day of many matches counts for as many rows as the form looks back on; the states are those over all matches."""
    rows = [("d", 1 + i // 400, f"{i:05d}", i % 2 == 0, i * 7 % 5, i * 3 % 4) for i in range(1200)]
    dom = spark.createDataFrame(rows, "team string, day int, match_id string, is_home boolean, goals_for long, goals_against long")
    dom = dom.select("*", F.date_add(F.lit("2001-01-01").cast("date"), F.col("day")).alias("match_date")).drop("day")
    dom = dom.unionByName(dom.filter("match_id < '00002'").withColumn("match_date", F.lit(None).cast("date")))
    asked = spark.createDataFrame([("d", d) for d in range(1, 6)], "team string, day int")
    asked = asked.select("team", "day", F.date_add(F.lit("2001-01-01").cast("date"), F.col("day")).alias("match_date"))
    found = lookups.with_domestic_form(asked, dom)
    got = {r["day"]: (r["dom_total_games"], r["dom_avg_for"], r["dom_home_pct"]) for r in found.collect()}
    for day in range(1, 6):
        before = rows[: 400 * min(day - 1, 3)]
        last = before[-5:]
        want = (len(before) + 2, sum(r[4] for r in last) / 5, sum(r[3] for r in last) / 5) if before else (None, None, None)
        assert got[day] == pytest.approx(want) if before else got[day] == want
    # what the series reads was folded to the last rows of each day
    written = re.findall(r"day-ends-[0-9a-f]+", "".join(found.inputFiles()))
    assert written and spark.read.parquet(f"{shared_dir(spark)}/{written[0]}").count() == 3 * 5 + 2


def test_interval_sums_of_days_order_days_only(spark):
    """Events and asked days are folded before they are put in order; null days and repeated keys count as before."""
    day = F.date_add(F.lit("2001-01-01").cast("date"), F.col("day").cast("int"))
    events = spark.range(3000).select((F.col("id") % 2).alias("team"), (F.col("id") % 7).alias("day"), "id").withColumn("day", day)
    events = events.unionByName(spark.sql("select 0L as team, cast(null as date) as day, 5L as id"))
    asked = [(0, 1, 3), (1, 0, 3), (2, 1, 0), (3, 0, None), (4, 9, 3), (5, 0, 40), (5, 0, 4)]
    left = spark.createDataFrame(asked, "id long, team long, day int").withColumn("day", day)
    start = F.date_sub("day", 2)
    measures = {"n": F.lit(1), "total": F.col("id")}
    found = joins.interval_sums(left, events, ["team"], ["id"], "day", "day", start, measures, None)
    before = joins.interval_sums(left, events, ["team"], ["id"], "day", "day", start, measures, lambda d: d)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, before.select(*found.columns).collect()))
    got = {r["id"]: r["n"] for r in found.collect()}
    of_day = lambda team, d: sum(i % 2 == team and i % 7 == d for i in range(3000))
    assert got == {
        0: sum(of_day(1, d) for d in (1, 2, 3)), 1: sum(of_day(0, d) for d in (1, 2, 3)), 2: of_day(1, 0), 3: 1, 4: 0,
        5: sum(of_day(0, d) for d in (2, 3, 4)),
    }
    written = re.findall(r"day-sums-[0-9a-f]+", "".join(found.inputFiles()))
    assert written and spark.read.parquet(f"{shared_dir(spark)}/{written[0]}").count() <= 2 * len(asked)
