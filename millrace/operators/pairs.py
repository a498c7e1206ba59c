"""Metrics of answers that belong together: A/B choices, swapped orders, controls, paired questions, several runs.

Each is one grouping by the key that ties rows together and one aggregation; nothing is joined with itself, as the
variants of a case are few and become columns of its group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ratio


def choice_metrics(rows: DataFrame, by: list[str], gold: str, chosen: str) -> DataFrame:
    """Per group of rows with gold A or B and a choice of A, B or anything else: rates over all rows but ``chose_a`` (over valid ones), and the 2 x 2 table."""
    g, p = F.col(gold), F.coalesce(F.col(chosen), F.lit(""))
    cell = lambda a, b: F.count_if((g == a) & (p == b))
    c = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(p.isin("A", "B")).alias("valid"), F.count_if(g == "A").alias("gold_a"), F.count_if(g == "B").alias("gold_b"),
        cell("A", "A").alias("a_as_a"), cell("A", "B").alias("a_as_b"), cell("B", "A").alias("b_as_a"), cell("B", "B").alias("b_as_b"),
    )
    col = F.col
    return c.select(
        *by, "n", "a_as_a", "a_as_b", "b_as_a", "b_as_b", (col("n") - col("valid")).alias("unknown"), ratio(col("valid"), col("n")).alias("valid_rate"),
        ratio(col("a_as_a") + col("b_as_b"), col("n")).alias("accuracy"), ratio(col("a_as_a") + col("b_as_a"), col("valid")).alias("chose_a"),
        ratio(col("a_as_a"), col("gold_a")).alias("accuracy_a"), ratio(col("b_as_b"), col("gold_b")).alias("accuracy_b"),
    )


def swap_metrics(rows: DataFrame, by: list[str], case: str, order: str, orders: tuple[str, str], chosen: str, meant: str, right: str) -> DataFrame:
    """Cases that were asked in both ``orders``: same thing meant, both right, letter flipped.

    ``chosen`` is the letter, ``meant`` what stands behind it (null if the letter is neither A nor B), ``right`` a boolean.
    Of rows that repeat a case and order, the one with the largest values counts."""
    side = lambda o: F.max(F.when(F.col(order) == o, F.struct(F.col(chosen).alias("chosen"), F.col(meant).alias("meant"), F.col(right).alias("right"))))
    cases = rows.groupBy(*by, case).agg(side(orders[0]).alias("x"), side(orders[1]).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    letters = x["chosen"].isin("A", "B") & y["chosen"].isin("A", "B")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), share(x["meant"] == y["meant"]).alias("consistent"), share(x["right"] & y["right"]).alias("both_right"), share(letters & (x["chosen"] != y["chosen"])).alias("flipped"))


def paired_accuracy(rows: DataFrame, by: list[str], pair: str, right: Column, size: int = 2) -> DataFrame:
    """Share of the pairs of exactly ``size`` rows that are right in all of them."""
    pairs = rows.groupBy(*by, pair).agg(F.count("*").alias("_n"), F.bool_and(F.coalesce(right, F.lit(False))).alias("_all")).filter(F.col("_n") == size)
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(F.col("_all").cast("double")).alias("paired_accuracy"))


def score_stats(rows: DataFrame, by: list[str], score: str, levels: range = range(1, 6)) -> DataFrame:
    """Count, mean, median, counts by level and the shares of good (4 and more) and bad (2 and less) of whole-number scores.

    The median is of the level counts, so no group is held whole."""
    s = F.col(score)
    c = rows.filter(s.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(s.cast("double")).alias("mean"), *[F.count_if(s == v).alias(f"n{v}") for v in levels], F.avg((s >= 4).cast("double")).alias("good"), F.avg((s <= 2).cast("double")).alias("bad"))

    def at(place: Column) -> Column:  # the level of the place-th score, from 1
        below, out = F.lit(0), F.lit(None).cast("int")
        for v in levels:
            below = below + F.col(f"n{v}")
            out = F.coalesce(out, F.when(below >= place, F.lit(v)))
        return out

    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor((F.col("n") + 2) / 2))) / 2.0
    return c.withColumn("median", middle)


def control_deltas(rows: DataFrame, sample: str, variant: str, score: str, original: str, controls: list[str]) -> DataFrame:
    """Per control: samples scored under both it and the original, mean difference, and how often the original is above, equal, below."""
    one = lambda v: F.max(F.when(F.col(variant) == v, F.col(score)))
    wide = rows.groupBy(sample).agg(one(original).alias("_o"), *[one(c).alias(f"_c{i}") for i, c in enumerate(controls)])
    long = wide.select("_o", F.explode(F.array(*[F.struct(F.lit(c).alias("control"), F.col(f"_c{i}").alias("_c")) for i, c in enumerate(controls)])).alias("x")).select("_o", "x.control", "x._c").filter("_o IS NOT NULL AND _c IS NOT NULL")
    d = F.col("_o") - F.col("_c")
    share = lambda c: F.avg(c.cast("double"))
    return long.groupBy("control").agg(F.count("*").alias("pairs"), F.avg("_o").alias("original_mean"), F.avg("_c").alias("control_mean"), F.avg(d).alias("mean_delta"), share(d > 0).alias("above"), share(d == 0).alias("equal"), share(d < 0).alias("below"))


def metric_deltas(method: DataFrame, control: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Method less control of each metric, for the groups that both have."""
    a = method.select(*by, *[F.col(m).alias(f"_m_{m}") for m in metrics])
    b = control.select(*by, *[F.col(m).alias(f"_c_{m}") for m in metrics])
    return a.join(b, by).select(*by, *[F.col(f"_m_{m}").alias(f"{m}_method") for m in metrics], *[(F.col(f"_m_{m}") - F.col(f"_c_{m}")).alias(f"{m}_delta") for m in metrics])


def in_all(tables: list[DataFrame], key: str) -> DataFrame:
    """The keys that every table has."""
    return reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), tables[1:], tables[0].select(key).distinct())


def label_metrics(rows: DataFrame, label: str, gold: str, predicted: str, known: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per label, micro, macro) of a table with a row for each (row, label) that is in the gold or predicted set.

    Labels that are not ``known`` count as wrong in the micro rates only; macro F1 is over labels with gold rows."""
    g, p = F.col(gold), F.col(predicted)
    each = rows.filter(known).groupBy(label).agg(F.count_if(g).alias("support"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    each = each.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("support"))})
    each = each.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    tp, fp, fn = F.count_if(g & p), F.count_if(~g & p), F.count_if(g & ~p)
    micro = rows.agg(ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), ratio(F.count_if(p & ~known), F.count_if(p)).alias("unknown_rate"))
    micro = micro.withColumn("micro_f1", ratio(2 * F.col("micro_precision") * F.col("micro_recall"), F.col("micro_precision") + F.col("micro_recall")))
    macro = each.agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))
    return each, micro, macro
