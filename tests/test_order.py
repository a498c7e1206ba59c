from pyspark.sql import functions as F

from millrace.operators import metrics, order, sampling

ROWS = [("a", float(i % 7), i % 2, i) for i in range(200)] + [("b", 1.0, 1, 900), (None, 2.0, 0, 901), (None, 3.0, 1, 902)]


def plain_auc(rows):
    wins = sum((p > n) + 0.5 * (p == n) for p, y in rows if y for n, z in rows if not z)
    pairs = sum(y for _, y in rows) * sum(1 - y for _, y in rows)
    return wins / pairs if pairs else None


def test_places_and_sums_equal_plain_ones(spark):
    df = spark.createDataFrame(ROWS, "g string, s double, y int, id long").repartition(7)
    got = {r.id: r for r in order.running(df, ["g"], [F.asc("id")], {"upto": F.col("y"), "place": F.lit(1)}).collect()}
    for g in ("a", "b", None):
        total = 0
        for place, (_, _, y, i) in enumerate(sorted((r for r in ROWS if r[0] == g), key=lambda r: r[3]), 1):
            total += y
            assert (got[i].upto, got[i].place) == (total, place)
    hashed = order.hash_placed(df, ["g"], sampling.hash_key("s", F.col("id")), "id", "rn").withColumn("h", sampling.hash_key("s", F.col("id"))).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in hashed if r.g == g), key=lambda r: r.h)
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1))
    assert order.placed(df.limit(0), ["g"], [F.asc("id")], "n").collect() == []
    assert sorted(r.n for r in order.placed(df, [], [F.desc("id")], "n").collect()) == list(range(1, len(ROWS) + 1))


def test_curves_equal_plain_ones_with_null_groups(spark):
    df = spark.createDataFrame(ROWS, "g string, s double, y int, id long")
    got = {r.g: r.auc for r in metrics.roc_auc(df, ["g"], "s", "y").collect()}
    for g in ("a", "b", None):
        want = plain_auc([(s, y) for h, s, y, _ in ROWS if h == g])
        assert got[g] == want or abs(got[g] - want) < 1e-12


def test_no_window_holds_a_group(spark):
    df = spark.createDataFrame(ROWS, "g string, s double, y int, id long")
    plan = sampling.ranked(df, ["g"], "s", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "[g#" in plan and all("_range" in line for line in plan.splitlines() if "Window [row_number" in line)
