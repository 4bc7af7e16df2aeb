"""Places in a whole table, and joins with a tolerance of days."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from matchspark.operators import joins, sequences


def test_ranks_are_those_of_one_sort(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"id": np.arange(5000), "v": rng.integers(0, 40, 5000).astype(float)})
    frame.loc[::97, "v"] = np.nan
    df = spark.createDataFrame(frame).withColumn("v", F.nanvl("v", F.lit(None))).repartition(13)
    got = sequences.ranked(df, [F.desc_nulls_last("v"), F.asc("id")]).toPandas().sort_values("rank")
    want = frame.sort_values(["v", "id"], ascending=[False, True], na_position="last")
    assert got["rank"].tolist() == list(range(1, 5001)) and got.id.tolist() == want.id.tolist()
    assert sequences.ranked(df.limit(0), [F.asc("id")]).count() == 0


def day(n):
    return datetime.date(2024, 1, n)


def test_nearest_rows_are_used_once(spark):
    left = [(1, "a", day(5)), (2, "a", day(6)), (3, "a", day(9)), (4, "b", day(5)), (5, "c", None), (6, None, day(5)), (7, "d", day(5))]
    right = [(10, "a", day(5), 1.0), (11, "a", day(7), 2.0), (12, "b", day(7), 3.0), (13, "b", day(4), 4.0), (14, "c", day(5), 5.0), (15, "d", day(4), 6.0), (16, "d", day(6), 7.0)]
    found = joins.merge_nearest(
        spark.createDataFrame(left, "id long, team string, day date"), spark.createDataFrame(right, "other long, team string, day date, xg double"),
        ["team"], "day", ["xg"], "id", "other",
    )
    got = {r["id"]: (r["days_apart"], r["xg"]) for r in found.collect()}
    # 2 lies a day from 10 and from 11; 10 is nearer to 1
    assert got == {1: (0, 1.0), 2: (1, 2.0), 3: (None, None), 4: (1, 4.0), 5: (None, None), 6: (None, None), 7: (1, 6.0)}
    wide = joins.merge_nearest(
        spark.createDataFrame(left, "id long, team string, day date"), spark.createDataFrame(right, "other long, team string, day date, xg double"),
        ["team"], "day", ["xg"], "id", "other", days=2,
    )
    assert {r["id"]: r["xg"] for r in wide.collect()} == {1: 1.0, 2: 2.0, 3: None, 4: 4.0, 5: None, 6: None, 7: 6.0}


def paired(left, right, days):
    """Pairs by trying all of them, nearest first, then by the smaller ids: {left id: (days apart, value)}."""
    met, used = {}, set()
    some = [(abs((a[2] - b[2]).days), a[0], b[0], b[3]) for a in left for b in right if a[1] == b[1]]
    while some := [p for p in some if p[0] <= days and p[1] not in met and p[2] not in used]:
        # the nearest of all, the smallest left id of these and its smallest right id are each other's nearest
        apart, a, b, v = min(some)
        met[a] = (apart, v)
        used.add(b)
    return {a[0]: met.get(a[0], (None, None)) for a in left}


LEFT, RIGHT = "id long, team string, day date", "other string, team string, day date, xg double"


def nearest(spark, left, right, days):
    found = joins.merge_nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["team"], "day", ["xg"], "id", "other", days=days)
    rows = found.collect()
    assert len(rows) == len(left)
    return {r["id"]: (r["days_apart"], r["xg"]) for r in rows}


def random_sides(seed, moved=0, most=40):
    rng = np.random.default_rng(seed)
    at = lambda: day(1) + datetime.timedelta(days=int(rng.integers(0, most)))
    left = [(int(i), "ab"[rng.integers(0, 2)], at()) for i in rng.permutation(160)]
    right = [(f"x{i}", "ab"[rng.integers(0, 2)], at() + datetime.timedelta(days=moved), float(i)) for i in rng.permutation(200)]
    return left, right


def test_nearest_rows_of_full_days(spark):
    for seed, moved, days, most in [(1, 0, 1, 40), (2, 0, 1, 120), (3, 1, 1, 8), (4, 0, 2, 90), (5, 2, 3, 30), (6, 0, 0, 20)]:
        left, right = random_sides(seed, moved, most)
        assert nearest(spark, left, right, days) == paired(left, right, days), (seed, days)


def test_nearest_rows_with_ids_on_several_days_and_keys(spark):
    for days in (1, 2):
        left, right = random_sides(7, 0, 60)
        left += [(left[0][0], "a", day(3)), (left[1][0], "b", day(9)), (left[5][0], "c", day(9)), left[9]]
        right += [(right[0][0], "a", day(4), -1.0), (right[2][0], "c", day(9), -2.0), right[7], ("x500", "d", day(9), 0.0)]
        assert nearest(spark, left, right, days) == paired(left, right, days)


def test_a_null_id_holds_its_nearest_row(spark):
    left = [(None, "a", day(5)), (1, "a", day(6)), (2, "b", day(6)), (3, "c", day(5))]
    right = [("x", "a", day(5), 1.0), ("y", "b", day(5), 2.0), (None, "c", day(5), 3.0), ("z", "c", day(6), 4.0)]
    assert nearest(spark, left, right, 1) == {None: (None, None), 1: (None, None), 2: (1, 2.0), 3: (None, None)}


def test_nearest_rows_make_no_pairs(spark, monkeypatch):
    """Days of many rows: what is written does not grow with the product of both sides."""
    written, cut = [], joins.cut

    def counted(df, *rest):
        table = cut(df, *rest)
        written.append(table.count())
        return table

    monkeypatch.setattr(joins, "cut", counted)
    left = [(i, "a", day(1 + i % 3)) for i in range(300)]
    right = [(f"x{i:04}", "a", day(1 + i % 3), float(i)) for i in range(900)]
    assert nearest(spark, left, right, 1) == {i: (0, float(i)) for i in range(300)}
    assert sum(written) <= len(left) + len(right)
