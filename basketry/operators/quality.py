"""Declarative data-quality checks.

Each ``check_*`` returns the violating rows (or groups) as a DataFrame, so a
failing check can be inspected without collecting the table.  ``run_checks``
evaluates a whole suite with one aggregate pass per table for all row-level
checks (NULL, accepted values, range, expression) plus one grouped pass per
uniqueness check, and returns one summary row per check.

NULL policy: only ``not_null`` reports NULLs; the other checks ignore them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accepted(col: str, values: Iterable) -> Column:
    return F.col(col).isin(list(values))


def check_unique(df: DataFrame, col: str) -> DataFrame:
    """Values of ``col`` appearing more than once (NULLs ignored)."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n_records"))
        .where(F.col("n_records") > 1)
    )


def check_not_null(df: DataFrame, col: str) -> DataFrame:
    """Rows where the column is NULL."""
    return df.where(F.col(col).isNull())


def check_accepted(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Values outside the accepted set, with their counts (NULLs ignored)."""
    return (
        df.where(F.col(col).isNotNull() & ~_accepted(col, values))
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def _range_violation(col: str, min_value=None, max_value=None, inclusive: bool = True) -> Column:
    c = F.col(col)
    bad = F.lit(False)
    if min_value is not None:
        bad = bad | ((c < F.lit(min_value)) if inclusive else (c <= F.lit(min_value)))
    if max_value is not None:
        bad = bad | ((c > F.lit(max_value)) if inclusive else (c >= F.lit(max_value)))
    return c.isNotNull() & bad


def check_range(df: DataFrame, col: str, min_value=None, max_value=None, inclusive: bool = True) -> DataFrame:
    """Rows outside [min, max] (inclusive by default); NULLs ignored."""
    return df.where(_range_violation(col, min_value, max_value, inclusive))


def check_expr(df: DataFrame, column: str, expression: str, where: str | None = None) -> DataFrame:
    """Rows (in the ``where`` scope) for which ``column <expression>`` is false; NULL is not a failure."""
    cond = F.expr(f"{column} {expression}")
    scope = F.expr(where) if where else F.lit(True)
    return df.where(scope & ~F.coalesce(cond, F.lit(True)))


def check_same_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of two frames (e.g. before/after a labelling merge) and whether they agree."""
    ca = a.agg(F.count(F.lit(1)).alias("left_rows"))
    cb = b.agg(F.count(F.lit(1)).alias("right_rows"))
    return ca.crossJoin(cb).select("left_rows", "right_rows", (F.col("left_rows") == F.col("right_rows")).alias("same"))


@dataclass(frozen=True)
class Check:
    """One declared check of a model column."""

    model: str
    column: str
    test: str  # unique | not_null | accepted_values | accepted_range | expression_is_true
    values: tuple = ()
    min_value: object = None
    max_value: object = None
    inclusive: bool = True
    expression: str | None = None
    where: str | None = None
    name: str = field(default="")

    @property
    def label(self) -> str:
        return self.name or f"{self.test}_{self.model}_{self.column}"


# The declared test suite of the raw source and the marts.
CHECKS: list[Check] = [
    Check("orders", "order_id", "unique"),
    Check("orders", "order_id", "not_null"),
    Check("fct_orders", "order_id", "unique"),
    Check("fct_orders", "order_id", "not_null"),
    Check("dim_products", "product_id", "unique"),
    Check("dim_products", "product_id", "not_null"),
    Check("monthly_revenue", "order_month", "not_null"),
    Check("monthly_revenue", "order_month", "unique"),
    Check("monthly_revenue", "revenue", "not_null"),
    Check("dim_customer", "customer_unique_id", "unique"),
    Check("dim_customer", "customer_unique_id", "not_null"),
    Check("product_cost_decomposition", "product_id", "not_null"),
    Check("product_cost_decomposition", "product_id", "unique"),
    Check("product_cost_decomposition", "category", "not_null"),
    Check(
        "product_cost_decomposition",
        "reliability_score",
        "accepted_values",
        values=("High Confidence", "Low Confidence", "Single Sale"),
    ),
    Check("product_cost_decomposition", "is_price_rebalanced", "not_null"),
    Check("product_cost_decomposition", "is_price_rebalanced", "accepted_values", values=(True, False)),
    Check("product_cost_decomposition", "avg_total_cost", "accepted_range", min_value=0, inclusive=True),
    Check("customer_retention", "customer_unique_id", "not_null"),
    Check("customer_retention", "order_sequence", "not_null"),
    Check("customer_retention", "order_sequence", "accepted_range", min_value=1),
    Check(
        "customer_retention",
        "lifecycle_stage",
        "accepted_values",
        values=(
            "Repeat Transaction",
            "Lapsed (One-Time)",
            "New (Potential Repeat)",
            "Initial Purchase (Loyalist)",
            "No Order",
        ),
    ),
    Check(
        "customer_retention",
        "days_between_orders",
        "expression_is_true",
        expression=">= 0",
        where="order_sequence > 1",
    ),
    Check("customer_retention", "order_id", "not_null"),
    Check("customer_retention", "order_id", "unique"),
    Check("monthly_revenue_by_cat", "revenue_month", "not_null"),
    Check("monthly_revenue_by_cat", "product_category", "not_null"),
    Check("monthly_revenue_by_cat", "monthly_revenue", "not_null"),
]


# Our own additions beyond the declared suite: the translation key must be unique,
# or the category join would multiply order items.
EXTRA_CHECKS: list[Check] = [
    Check("product_category_name_translation", "product_category_name", "unique"),
    Check("product_category_name_translation", "product_category_name", "not_null"),
]


def _row_failure(c: Check) -> Column:
    if c.test == "not_null":
        return F.col(c.column).isNull()
    if c.test == "accepted_values":
        return F.col(c.column).isNotNull() & ~_accepted(c.column, c.values)
    if c.test == "accepted_range":
        return _range_violation(c.column, c.min_value, c.max_value, c.inclusive)
    if c.test == "expression_is_true":
        scope = F.expr(c.where) if c.where else F.lit(True)
        return scope & ~F.coalesce(F.expr(f"{c.column} {c.expression}"), F.lit(True))
    raise ValueError(f"not a row-level test: {c.test}")


def _distinct_offenders(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row: per accepted-values check, the number of distinct values outside its set."""
    bad = [F.col(c.column).isNotNull() & ~_accepted(c.column, c.values) for c in checks]
    tagged = [
        F.when(b, F.struct(F.lit(j).alias("i"), F.col(c.column).cast("string").alias("v")))
        for j, (b, c) in enumerate(zip(bad, checks))
    ]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    pairs = (
        df.where(any_bad)
        .select(F.explode(F.array_compact(F.array(*tagged))).alias("o"))
        .select("o.i", "o.v")
        .distinct()
    )
    return pairs.agg(*[F.count_if(F.col("i") == j).alias(f"v{j}") for j in range(len(checks))])


def run_checks(tables: dict[str, DataFrame], checks: Iterable[Check] = CHECKS) -> DataFrame:
    """One summary row per check: (model, column_name, test_name, failures, status).

    Failures count violating rows, except ``unique`` (duplicated values) and
    ``accepted_values`` (distinct offending values).  One pass per table for
    the row-level checks.  A table with a uniqueness check is grouped by that
    column once; the row-level failure counts ride along in the same grouped
    aggregate and are summed afterwards, and the duplicate count is the number
    of non-NULL groups with more than one row.  When the table is already
    partitioned by that column (a mart keyed by it) the grouping adds no
    exchange.  Tables without a uniqueness check get a single global ``agg``.
    """
    checks = [c for c in checks if c.model in tables]
    by_model: dict[str, list[Check]] = {}
    for c in checks:
        by_model.setdefault(c.model, []).append(c)
    parts: list[DataFrame] = []
    for model, cs in by_model.items():
        df = tables[model]
        row_checks = [c for c in cs if c.test not in ("unique", "accepted_values")]
        uniq = [c for c in cs if c.test == "unique"]
        valued = [c for c in cs if c.test == "accepted_values"]
        counts = [F.count_if(_row_failure(c)).alias(f"f{i}") for i, c in enumerate(row_checks)]
        if len(uniq) == 1:
            u = uniq[0].column
            grouped = df.groupBy(u).agg(F.count(F.lit(1)).alias("__n"), *counts)
            totals = grouped.agg(
                *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(row_checks))],
                F.count_if(F.col(u).isNotNull() & (F.col("__n") > 1)).alias("u0"),
            )
            order = row_checks + uniq
            names = [f"f{i}" for i in range(len(row_checks))] + ["u0"]
        else:
            extra = [
                check_unique(df, c.column).agg(F.count(F.lit(1)).alias(f"u{j}"))
                for j, c in enumerate(uniq)
            ]
            totals = df.agg(*counts) if counts else None
            for e in extra:
                totals = e if totals is None else totals.crossJoin(e)
            order = row_checks + uniq
            names = [f"f{i}" for i in range(len(row_checks))] + [f"u{j}" for j in range(len(uniq))]
        # accepted values: the number of distinct offending values, all such checks of
        # the table in one pass over its offending rows only
        if valued:
            v = _distinct_offenders(df, valued)
            totals = v if totals is None else totals.crossJoin(v)
            order = order + valued
            names = names + [f"v{j}" for j in range(len(valued))]
        stack = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c.model).alias("model"),
                        F.lit(c.column).alias("column_name"),
                        F.lit(c.test).alias("test_name"),
                        F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("failures"),
                    )
                    for c, n in zip(order, names)
                ]
            )
        ).alias("r")
        parts.append(totals.select(stack).select("r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))
