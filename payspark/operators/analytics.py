"""What the dashboard shows, as queries over stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payspark.functions.text import cents, format_amount
from payspark.sources.checkpoints import settled

#: Ties of a period go by id.
ORDER = ("periodo", "id")


def by_period(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*ORDER)


def valid(rows: DataFrame) -> DataFrame:
    """Rows with a positive gross pay; NaN is none."""
    return rows.where((F.col("total_devengado") > 0) & ~F.isnan("total_devengado"))


def kpis(rows: DataFrame) -> DataFrame:
    """One row: latest gross, net and tax rate, growth of gross pay since the first in percent to one decimal, companies.

    First and last are aggregates, so nothing is sorted.
    """
    order = F.struct(*ORDER)
    pick = lambda f, c: f(F.col(c), order)
    last, first = pick(F.max_by, "total_devengado"), pick(F.min_by, "total_devengado")
    return valid(rows).agg(
        last.alias("latest_gross"), pick(F.max_by, "liquido_percibir").alias("latest_net"), pick(F.max_by, "irpf_porcentaje").alias("latest_irpf"),
        F.round((last / first - 1) * 100, 1).alias("growth_percent"), F.count_distinct("empresa").alias("companies"), F.count("*").alias("documents"),
    )


def kpi_texts(rows: DataFrame) -> DataFrame:
    """The same as they are shown: amounts with thousands separators and their unit, rates in percent."""
    found = kpis(rows)
    percent = lambda c: F.concat(F.format_number(c, 1), F.lit(" %"))
    return found.select(
        format_amount(F.col("latest_gross")).alias("gross"), format_amount(F.col("latest_net")).alias("net"), percent("latest_irpf").alias("tax_rate"),
        percent("growth_percent").alias("growth"), F.col("companies").cast("string").alias("companies"),
    )


def with_deductions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``total_deducciones``, gross less net pay to the cent, which documents don't hold."""
    return rows.withColumn("total_deducciones", cents(F.col("total_devengado") - F.col("liquido_percibir")))


def pay_series(rows: DataFrame) -> DataFrame:
    """(periodo, id, total_devengado, liquido_percibir) in order, for a line of each."""
    return by_period(valid(rows).select("periodo", "id", "total_devengado", "liquido_percibir"))


def pay_series_long(rows: DataFrame) -> DataFrame:
    """The same with a row for each line: (periodo, id, series, amount)."""
    pays = valid(rows).select("periodo", "id", F.expr("stack(2, 'gross', total_devengado, 'net', liquido_percibir) as (series, amount)"))
    return pays.orderBy("series", *ORDER)


def ranked(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, first, total): distinct values, how often each comes, the rank from 0 of its first place, and
    the size of its group.

    Values are counted before they are shuffled and dealt out by ranges, so a
    group of any size is spread over tasks; what one of them has of a group is
    a row in a small table, from which the next one's ranks go on.
    """
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n")).repartitionByRange(group, value)
    parts = settled(counted.withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy(group, "part").agg(F.sum("n").alias("own"))
    whole = Window.partitionBy(group)
    before = F.sum("own").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    known = sums.select(
        F.col(group).alias("in_group"), F.col("part").alias("in_part"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("own").over(whole).alias("total")
    )
    here = F.sum("n").over(Window.partitionBy("part", group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    joined = parts.withColumn("here", F.coalesce(here, F.lit(0))).join(known, F.col(group).eqNullSafe(F.col("in_group")) & (F.col("part") == F.col("in_part")))
    return joined.select(group, value, "n", (F.col("before") + F.col("here")).alias("first"), "total")


#: Interquartile ranges from the quartiles beyond which a pay is an outlier.
REACH = 1.5


def quartiles(found: DataFrame) -> DataFrame:
    """(empresa, lowest, q1, median, q3, highest, documents, low_fence, high_fence) of ``ranked`` gross pays."""
    pay = F.col("total_devengado")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("first") <= place) & (place < F.col("first") + F.col("n")), pay))

    def quartile(share: float) -> Column:
        place = (F.col("total") - 1) * share
        low, high, here = F.floor(place), F.ceil(place), F.max(place)
        between = (F.max(high) - here) * at(low) + (here - F.max(low)) * at(high)
        return F.when(F.max(low) == F.max(high), at(low)).otherwise(between)

    named = [quartile(q / 4).alias(n) for q, n in ((1, "q1"), (2, "median"), (3, "q3"))]
    boxes = found.groupBy("empresa").agg(F.min(pay).alias("lowest"), *named, F.max(pay).alias("highest"), F.sum("n").alias("documents"))
    reach = REACH * (F.col("q3") - F.col("q1"))
    return boxes.select("*", (F.col("q1") - reach).alias("low_fence"), (F.col("q3") + reach).alias("high_fence"))


def pay_ranges(rows: DataFrame) -> DataFrame:
    """Of each company's gross pays the quartiles (interpolated), extremes, number, whisker ends and number of outliers.

    A whisker ends at the last pay within 1.5 interquartile ranges of its
    quartile. Values are ranked once; the fences, a row for each company, meet
    the ranked values again, which have a row for each distinct pay.
    """
    found = settled(ranked(valid(rows).select("empresa", "total_devengado"), "empresa", "total_devengado"))
    boxes = quartiles(found)
    pay = F.col("total_devengado")
    fences = boxes.select(F.col("empresa").alias("_of"), "low_fence", "high_fence")
    inside = pay.between(F.col("low_fence"), F.col("high_fence"))
    ends = found.join(fences, F.col("empresa").eqNullSafe(F.col("_of"))).groupBy("_of").agg(
        F.min(F.when(inside, pay)).alias("low_whisker"), F.max(F.when(inside, pay)).alias("high_whisker"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers")
    )
    both = boxes.join(ends, F.col("empresa").eqNullSafe(F.col("_of")))
    return both.select("empresa", "lowest", "q1", "median", "q3", "highest", "documents", "low_whisker", "high_whisker", "outliers")


def outliers(rows: DataFrame) -> DataFrame:
    """Documents whose gross pay is over 1.5 interquartile ranges from the quartiles of its company."""
    found = valid(rows)
    fences = quartiles(ranked(found.select("empresa", "total_devengado"), "empresa", "total_devengado"))
    joined = found.join(fences.select(F.col("empresa").alias("_of"), "low_fence", "high_fence"), F.col("empresa").eqNullSafe(F.col("_of")))
    return joined.where(~F.col("total_devengado").between(F.col("low_fence"), F.col("high_fence"))).select("id", "empresa", "periodo", "total_devengado")


def tax_series(rows: DataFrame) -> DataFrame:
    """(periodo, empresa, id, irpf_porcentaje), a bar for each document."""
    return by_period(valid(rows).select("periodo", "empresa", "id", "irpf_porcentaje"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, by ``side`` (added or removed), each as often as that.

    Both sides are counted in one aggregation, with opposite signs, so each is
    read once and shuffled once, summed up before.
    """
    counted = right.withColumn("_sign", F.lit(1)).union(left.withColumn("_sign", F.lit(-1)))
    net = counted.groupBy(*right.columns).agg(F.sum("_sign").alias("_net")).where("_net <> 0")
    side = F.when(F.col("_net") > 0, "added").otherwise("removed").alias("side")
    return net.select(*right.columns, side, F.explode(F.sequence(F.lit(1), F.abs("_net"))).alias("_copy")).drop("_copy")
