"""Command line: load raw CSVs, build the marts, run the declared checks.

    python -m basketry ingest --csv DATA_DIR --root WAREHOUSE
    python -m basketry build  --root WAREHOUSE [--select fct_orders,dim_customer]
    python -m basketry run    --csv DATA_DIR --root WAREHOUSE
    python -m basketry report --root WAREHOUSE [--categories a,b] [--years 2017,2018] [--contamination 0.05]

``build`` (and ``run``) exits non-zero when a check fails, so a start-up
script can stop on bad data.  WAREHOUSE is any Hadoop path (a shared file
system or object store on a cluster).
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from .operators.quality import CHECKS, EXTRA_CHECKS, run_checks
from .plans.build import MARTS, STAGING, build, buildable
from .session import build_session
from .sources.files import ingest_dir, load_tables, read_table, table_exists


def ingest(spark: SparkSession, csv_dir: str, root: str, prefix: str = "") -> int:
    """Read every CSV in ``csv_dir`` and load it to the raw tier; returns the number of tables."""
    tables = ingest_dir(spark, csv_dir, prefix=prefix)
    if not tables:
        return 0
    report = load_tables(tables, root, "raw")
    for r in report.orderBy("table_name").collect():
        print(f"loaded raw.{r.table_name}: {r.row_count} rows")
    return len(tables)


def build_and_check(spark: SparkSession, root: str, select: list[str] | None = None) -> bool:
    """Build marts from the raw tier into the analytics tier, then run the check suite.

    Marts whose raw tables are not loaded are reported and left out; a table
    that is there but cannot be read fails.
    """
    raw = {src: read_table(spark, root, "raw", src) for src, _fn in STAGING.values() if table_exists(spark, root, "raw", src)}
    wanted, skipped = buildable(raw, select or list(MARTS))
    for mart, absent in skipped.items():
        print(f"SKIP {mart}: no raw table {', '.join(absent)}")
    if not wanted:
        print("nothing to build")
        return False
    models = build(raw, root=root, select=wanted)
    tables = {k: v for k, v in models.items() if k in MARTS}
    if "stg_order" in models:
        tables["orders"] = models["stg_order"]
    if "product_category_name_translation" in raw:
        tables["product_category_name_translation"] = raw["product_category_name_translation"]
    summary = run_checks(tables, CHECKS + EXTRA_CHECKS).collect()
    failed = [r for r in summary if r.status != "pass"]
    for r in summary:
        print(f"{r.status.upper():4} {r.test_name:<20} {r.model}.{r.column_name} failures={r.failures}")
    print(f"{len(summary) - len(failed)} passed, {len(failed)} failed")
    return not failed


def report(
    spark: SparkSession,
    root: str,
    categories: list[str] | None = None,
    years: list[int] | None = None,
    contamination: float = 0.05,
) -> dict[str, list]:
    """The dashboards' numbers from the written marts (only KPI rows reach the driver).

    Product audit: anomaly and Pareto KPIs for the selected categories (all when
    none are given); retention: customers, repeat rates, lifecycle shares and
    same-day orders; category revenue: yearly mean monthly revenue.  Labels and
    selected columns are kept by the marts' versions: a second report of the
    same choice scans neither product nor retention mart.
    """
    from .operators import aggregates as A
    from .operators import filters as FL
    from .operators import metrics as K
    from .operators.anomaly import detect_anomalies
    from .sources.files import read_mart
    from .sources.results import result, selection

    def labels(pcd: DataFrame) -> DataFrame:
        return detect_anomalies(FL.in_categories(pcd, categories) if categories else pcd, contamination=contamination)

    out: dict[str, list] = {}
    labelled = result(spark, root, "product_cost_decomposition", repr(("labels", sorted(categories or []), contamination)), labels)
    out["anomalies"] = K.anomaly_kpis(FL.reliable_only(labelled)).collect()
    out["pareto"] = K.pareto_kpis(labelled).collect()
    ret = selection(spark, root, "customer_retention", ["customer_unique_id", "order_sequence", "total_customer_orders", "lifecycle_stage", "days_between_orders"])
    out["customers"] = K.unique_customers(ret).collect()
    out["repeat_rate"] = K.repeat_rate(ret).collect()
    out["customer_repeat_rate"] = K.customer_repeat_rate(ret).collect()
    out["lifecycle"] = K.lifecycle_distribution(ret).orderBy("lifecycle_stage").collect()
    out["same_day"] = K.same_day_kpis(ret).collect()
    rev = read_mart(spark, root, "monthly_revenue_by_cat")
    if categories:
        rev = FL.in_values(rev, "product_category", categories)
    if years:
        rev = FL.in_values(rev, "revenue_year", years)
    out["yearly_avg_revenue"] = A.yearly_avg_revenue(rev).orderBy("product_category", "revenue_year").collect()
    return out


def main(argv: list[str] | None = None) -> int:
    """Command-line entry point; returns the process exit code."""
    ap = argparse.ArgumentParser(prog="basketry")
    ap.add_argument("command", choices=["ingest", "build", "run", "report"])
    ap.add_argument("--csv", help="folder with the source CSV files")
    ap.add_argument("--root", required=True, help="warehouse root (raw/ and analytics/ tiers)")
    ap.add_argument("--prefix", default="", help="dataset prefix to drop from file names")
    ap.add_argument("--select", default="", help="comma-separated marts to build (default: all)")
    ap.add_argument("--master", default=None)
    ap.add_argument("--categories", default="", help="report: comma-separated category selection")
    ap.add_argument("--years", default="", help="report: comma-separated years")
    ap.add_argument("--contamination", type=float, default=0.05, help="report: anomaly share (0.01-0.20)")
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    ok = True
    if a.command in ("ingest", "run"):
        if not a.csv:
            ap.error("--csv is required")
        t0 = time.perf_counter()
        n = ingest(spark, a.csv, a.root, a.prefix)
        print(f"ingested {n} tables in {time.perf_counter() - t0:.2f} s")
    if a.command in ("build", "run"):
        t0 = time.perf_counter()
        ok = build_and_check(spark, a.root, [s for s in a.select.split(",") if s] or None)
        print(f"built and checked in {time.perf_counter() - t0:.2f} s")
    if a.command == "report":
        cats = [c for c in a.categories.split(",") if c]
        years = [int(y) for y in a.years.split(",") if y]
        for section, rows in report(spark, a.root, cats, years, a.contamination).items():
            print(f"== {section}")
            for r in rows:
                print("  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()))
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
