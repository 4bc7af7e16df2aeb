"""Name resolution against a brute-force search; cleaning rules."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from matchspark.operators import names

WORD = st.text("abA ", min_size=0, max_size=5)


def brute(name, targets, aliases):
    hits = [(0, 0, t) for t in targets if t == name]
    hits += [(1, rank, c) for raw, c, rank in aliases if raw == name and c in targets]
    low = name.lower()
    hits += [(2, abs(len(name) - len(t)), t) for t in targets if name and t and (low in t.lower() or t.lower() in low)]
    return min(hits)[2::-2] if hits else None


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(WORD, min_size=1, max_size=12), st.sets(WORD, min_size=1, max_size=12), st.lists(st.tuples(WORD, WORD), max_size=4))
def test_resolve(spark, raw, targets, pairs):
    aliases = [(a, c, i) for i, (a, c) in enumerate(pairs)]
    found = names.resolve(
        spark.createDataFrame([(n,) for n in raw], "name string"),
        spark.createDataFrame([(t,) for t in targets], "target string"),
        spark.createDataFrame(aliases, "raw string, canonical string, rank int"),
    )
    got = {r.name: (r.target, r.tier) for r in found.collect()}
    expected = {n: b for n in raw if (b := brute(n, targets, aliases))}
    assert got == expected


def test_cleaned(spark):
    raw = ["Germany Bayern  Munich", " Malmö FF (H)", "Fenerbahçe[a]", "Ireland Shelbourne", "Norway Bodø/Glimt", "Republic of Ireland Bohs"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(raw)], "i int, name string")
    aliases = spark.createDataFrame([("Norway Bodø/Glimt", "Bodo/Glimt"), ("Bayern Munich", "Bayern")], "raw string, canonical string")
    got = [r.name for r in names.cleaned(df, "name", aliases).orderBy("i").collect()]
    assert got == ["Bayern", "Malmo FF", "Fenerbahce", "Shelbourne", "Bodo/Glimt", "Bohs"]
