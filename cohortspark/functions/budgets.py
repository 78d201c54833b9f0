"""Arithmetic that answers state: calculations and time budgets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def twelve_digits(x: Column) -> Column:
    return F.format_string("%.11e", x).cast("double")


def calculate(operation: Column, values: Column) -> Column:
    """sum, difference, product or median of 1 to 50 finite numbers within 1e9; null where not allowed or beyond 1e12."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1e9)
    fine = F.size(values).between(1, 50) & (F.size(F.filter(values, lambda x: ~F.coalesce(finite(x), F.lit(False)))) == 0)
    zero, one = F.lit(0.0), F.lit(1.0)
    total = F.aggregate(values, zero, lambda a, x: a + x)
    rest = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: a - x)
    product = F.aggregate(values, one, lambda a, x: a * x)
    ordered, n = F.array_sort(values), F.size(values)
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    result = F.when(operation == "sum", total).when(operation == "difference", rest).when(operation == "product", product).when(operation == "median", median)
    return F.when(fine & (F.abs(result) <= 1e12), twelve_digits(result))


def weekly_budget(hours: Column, weeks: Column, planned: Column) -> Column:
    """{total, shortfall, fits, required_weeks}; null outside of 0-168 hours, 0-260 weeks or a plan of 0 to 100,000."""
    ok = hours.between(0, 168) & weeks.between(0, 260) & (planned.isNull() | ((planned > 0) & (planned <= 100_000)))
    total = twelve_digits(hours * weeks)
    short = twelve_digits(F.greatest(F.lit(0.0), planned - total))
    plan = planned.isNotNull()
    return F.when(ok, F.struct(total.alias("total"), F.when(plan, short).alias("shortfall"), F.when(plan, short == 0).alias("fits"), F.when(plan & (hours > 0), twelve_digits(planned / F.nullif(hours, F.lit(0.0)))).alias("required_weeks")))


def calendar_budget(hours: Column, month: Column, planned: Column, today: Column) -> Column:
    """{by_start, through_end, shortfall} of hours from today (date) to a month YYYY-MM, to two decimals; null if invalid."""
    ok = month.rlike(r"\A20[0-9]{2}-(0[1-9]|1[0-2])\z") & hours.between(0, 168) & (planned.isNull() | (planned > 0))
    first = F.to_date(F.concat(F.when(ok, month), F.lit("-01")))
    until = lambda d: F.round(F.greatest(F.lit(0), F.datediff(d, today)) / 7 * hours, 2)
    end = until(F.add_months(first, 1))
    return F.when(ok, F.struct(until(first).alias("by_start"), end.alias("through_end"), F.round(F.greatest(F.lit(0.0), planned - end), 2).alias("shortfall")))
