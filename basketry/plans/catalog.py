"""Query catalog: every operator as a query over the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame computed
from the whole input tables (through the fixture adapters), so its work
grows with the data.  ``plans/oracle.py`` holds the matching DuckDB SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_to, safe_divide
from ..functions.temporal import (
    days_between,
    elapsed_days,
    month_of,
    month_start,
    to_timestamp_ntz,
    year_month_label,
    year_of,
)
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import marts as M
from ..operators import metrics as K
from ..operators import quality as Q
from ..operators import staging as S
from ..functions.labels import RESULT_ANOMALY, RESULT_NORMAL, RESULT_UNSCORED, value_map
from ..operators.anomaly import (
    above_quantile,
    anomaly_features,
    audit_view,
    detect_anomalies,
    isolation_forest_scores,
    outlier_map,
    z_outliers,
)
from ..schemas import RAW_SCHEMAS
from ..session import ensure_checkpoint_dir
from ..sources import files as FS
from ..sources import fixtures as FX

# Fixed selections used by the dashboard-style queries (what a dashboard user would pick).
SELECTED_CATEGORIES = ["STANDARD goods", "ECONOMY goods", "Unknown"]
SELECTED_YEARS = [1996, 1997, 1998]
RECENCY_BIN_DAYS = 50
GAP_BIN_DAYS = 0.5
Z_CUTOFF = 2.0
CONTAMINATION = 0.05


class Models:
    """Lazily derived raw, staging and mart frames for one (session, data folder)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # raw (adapters)
    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        return FX.raw_tables(self.spark, self.sf_dir)

    # staging
    @cached_property
    def stg_order(self) -> DataFrame:
        return S.stg_order(self.raw["orders"])

    @cached_property
    def stg_items(self) -> DataFrame:
        return S.stg_order_items(self.raw["order_items"])

    @cached_property
    def stg_customer(self) -> DataFrame:
        return S.stg_customer(self.raw["customers"])

    @cached_property
    def stg_products(self) -> DataFrame:
        return S.stg_products(self.raw["products"])

    @cached_property
    def stg_translate(self) -> DataFrame:
        return S.stg_category_translate(self.raw["product_category_name_translation"])

    @cached_property
    def stg_sellers(self) -> DataFrame:
        return S.stg_sellers(self.raw["sellers"])

    # marts
    @cached_property
    def fct(self) -> DataFrame:
        return M.fct_orders(self.stg_order, self.stg_items)

    @cached_property
    def dim_products(self) -> DataFrame:
        return M.dim_products(self.stg_products, self.stg_translate)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return M.dim_customer(self.fct, self.stg_customer)

    @cached_property
    def monthly_revenue(self) -> DataFrame:
        return M.monthly_revenue(self.fct)

    @cached_property
    def revenue_by_cat(self) -> DataFrame:
        return M.monthly_revenue_by_cat(self.stg_order, self.stg_items, self.stg_products, self.stg_translate)

    @cached_property
    def base_stats(self) -> DataFrame:
        return M.product_base_stats(self.stg_items, self.dim_products)

    @cached_property
    def features(self) -> DataFrame:
        return M.cost_features(self.base_stats)

    @cached_property
    def pcd(self) -> DataFrame:
        return M.pareto(self.features)

    @cached_property
    def mapping(self) -> DataFrame:
        return M.order_mapping(self.fct, self.stg_customer)

    @cached_property
    def retention_facts(self) -> DataFrame:
        return M.retention_facts(self.mapping)

    @cached_property
    def retention(self) -> DataFrame:
        return M.with_retention_labels(self.retention_facts)

    @cached_property
    def event_retention(self) -> DataFrame:
        """Retention over purchase events (sub-day gaps) for the technical-split metrics."""
        return M.with_retention_labels(M.retention_facts(FX.purchase_events(self.spark, self.sf_dir)))

    def scratch(self, what: str) -> str:
        base = ensure_checkpoint_dir(self.spark).rstrip("/")
        return f"{base}/basketry-{what}-{uuid.uuid4().hex[:12]}"


QueryFn = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, QueryFn] = {}


def query(name: str):
    """Register a catalog query under ``name``."""
    def deco(fn: Callable[[Models], DataFrame]):
        _REG[name] = lambda spark, sf_dir, _fn=fn: _fn(Models(spark, sf_dir))
        _REG[name].__doc__ = fn.__doc__
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    """All registered queries: name -> (spark, sf_dir) -> DataFrame."""
    return dict(_REG)


# ------------------------------------------------------------------ sources / sinks
@query("ingest_csv")
def _ingest_csv(m: Models) -> DataFrame:
    """raw tables → CSV (text timestamps, header) → directory ingest with declared schemas → staged orders."""
    d = m.scratch("csv")
    for name in ("orders", "customers"):
        df = m.raw[name]
        df = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        df.write.mode("overwrite").option("header", True).csv(f"{d}/shop_{name}_dataset.csv")
    tables = FS.ingest_dir(m.spark, d, FX.adapter_schemas(), prefix="shop_")
    return S.stg_order(tables["orders"])


def content_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row_count, content): rows, and the sum of a 32-bit digest of each row's values as text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns])
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias("content"),
    )


@query("ingest_all")
def _ingest_all(m: Models) -> DataFrame:
    """All nine raw tables → CSV (columns in reverse order, quoted line breaks and quotes) → directory ingest by
    header → raw tier; rows and content of the loaded tables."""
    d, root = m.scratch("csv"), m.scratch("raw")
    for name, df in m.raw.items():
        text = df.select(*[F.col(c).cast("string").alias(c) for c in reversed(df.columns)])
        text.write.option("header", True).option("escape", '"').csv(f"{d}/shop_{name}_dataset.csv")
    tables = FS.ingest_dir(m.spark, d, FX.adapter_schemas(), prefix="shop_")
    FS.load_tables(tables, root, "raw")
    out = None
    for name, schema in RAW_SCHEMAS.items():
        loaded = FS.read_table(m.spark, root, "raw", name)
        one = content_key(loaded, schema.fieldNames()).select(F.lit(name).alias("table_name"), "row_count", "content")
        out = one if out is None else out.unionByName(one)
    return out


#: Columns of each mart whose content the whole-build query reports.
BUILD_COLUMNS = {
    "fct_orders": ["order_id", "customer_id", "order_status", "total_items"],
    "dim_products": ["product_id", "category_name"],
    "dim_customer": ["customer_unique_id", "total_orders", "customer_segment"],
    "monthly_revenue": ["order_month", "total_fullfilled_orders", "revenue"],
    "monthly_revenue_by_cat": ["revenue_month", "product_category", "monthly_revenue", "product_sold"],
    "product_cost_decomposition": ["product_id", "category", "sales_count", "product_revenue", "is_revenue_workhorse"],
    "customer_retention": ["order_id", "order_sequence", "lifecycle_stage", "retention_window"],
}


@query("build_all")
def _build_all(m: Models) -> DataFrame:
    """Build of all seven marts, written and read back: rows and content of each."""
    models = _built(m)
    out = None
    for name, columns in BUILD_COLUMNS.items():
        one = content_key(models[name], columns).select(F.lit(name).alias("mart"), "row_count", "content")
        out = one if out is None else out.unionByName(one)
    return out


@query("build_bucketed")
def _build_bucketed(m: Models) -> DataFrame:
    """Build with the fact and the customer bridge in buckets: rows and content of the two marts that join them."""
    from .build import build

    models = build(m.raw, root=m.scratch("bucketed"), select=["dim_customer", "customer_retention"], buckets=8)
    out = None
    for name in ("dim_customer", "customer_retention"):
        one = content_key(models[name], BUILD_COLUMNS[name]).select(F.lit(name).alias("mart"), "row_count", "content")
        out = one if out is None else out.unionByName(one)
    return out


def _built(m: Models) -> dict[str, DataFrame]:
    from .build import build

    return build(m.raw, root=m.scratch("build"))


@query("normalize_columns")
def _normalize_columns(m: Models) -> DataFrame:
    """Messy source headers ('Customer Id', 'customer.unique id', …) → normalised names."""
    c = m.raw["customers"]
    messy = c.toDF("Customer_Id", "customer.unique id", "Customer Zip Code Prefix", "CUSTOMER_CITY", "customer state")
    return FS.normalize_columns(messy)


@query("raw_roundtrip")
def _raw_roundtrip(m: Models) -> DataFrame:
    """write_table (overwrite) to the raw tier and read back."""
    root = m.scratch("tables")
    FS.write_table(m.raw["order_items"], root, "raw", "order_items")
    return FS.read_table(m.spark, root, "raw", "order_items")


@query("load_report")
def _load_report(m: Models) -> DataFrame:
    """Rows per loaded raw table, counted during the write."""
    root = m.scratch("load")
    return FS.load_tables(m.raw, root, "raw")


@query("mart_roundtrip")
def _mart_roundtrip(m: Models) -> DataFrame:
    """Build of two marts with written tables; the read-back order fact (build_all builds all)."""
    from .build import build

    models = build(m.raw, root=m.scratch("build"), select=["fct_orders", "monthly_revenue"])
    return models["fct_orders"]


@query("mart_scan")
def _mart_scan(m: Models) -> DataFrame:
    """Column-pruned scan of a written mart."""
    from .build import build

    root = m.scratch("scan")
    build(m.raw, root=root, select=["monthly_revenue_by_cat"])
    return FS.read_mart(m.spark, root, "monthly_revenue_by_cat", ["revenue_month", "product_category", "monthly_revenue"])


@query("mart_reuse")
def _mart_reuse(m: Models) -> DataFrame:
    """The same selection of a mart read twice: the second reader scans the kept result."""
    from ..sources.results import selection
    from .build import build

    root = m.scratch("reuse")
    build(m.raw, root=root, select=["monthly_revenue_by_cat"])
    read = lambda: selection(m.spark, root, "monthly_revenue_by_cat", ["revenue_month", "product_category", "monthly_revenue"], "revenue_year >= 1996")
    read()
    return read()


@query("table_versions")
def _table_versions(m: Models) -> DataFrame:
    """A table replaced twice: the rows of its last two versions, each read by its number."""
    from ..sources import versions as V

    root, items = m.scratch("versions"), m.raw["order_items"].select("order_id", "price")
    for least in (3, 2, 1):
        FS.write_table(items.where(F.col("order_id") % 4 >= least), root, "raw", "order_items", observe=False)
    out = None
    for version in V.versions(m.spark, FS.table_path(root, "raw", "order_items")):
        rows = FS.read_table(m.spark, root, "raw", "order_items", version=version)
        one = rows.agg(F.count(F.lit(1)).alias("row_count"), F.sum("price").cast("decimal(38,2)").alias("price"))
        one = one.select(F.lit(version.number).cast("bigint").alias("version"), "row_count", "price")
        out = one if out is None else out.unionByName(one)
    return out


@query("ingest_rejects")
def _ingest_rejects(m: Models) -> DataFrame:
    """Order items as CSV, some with malformed prices or numbers, loaded with the malformed rows set aside: good rows, rejected values."""
    d, root = m.scratch("csv"), m.scratch("checked")
    items = m.raw["order_items"]
    text = items.select(*[F.col(c).cast("string").alias(c) for c in items.columns])
    key = F.col("order_id").cast("bigint")
    text = text.withColumns({
        "price": F.when(key % 50 == 0, F.concat(F.lit("EUR "), F.col("price"))).otherwise(F.col("price")),
        "order_item_id": F.when(key % 75 == 0, F.lit("one, or two")).otherwise(F.col("order_item_id")),
    })
    text.write.option("header", True).option("escape", '"').csv(f"{d}/order_items.csv")
    FS.load_checked(m.spark, f"{d}/order_items.csv", FX.adapter_schemas()["order_items"], root, "raw", "order_items")
    good = FS.read_table(m.spark, root, "raw", "order_items")
    good = content_key(good, ["order_id", "order_item_id", "product_id", "price"]).select(F.lit("(good)").alias("column"), "row_count", "content")
    bad = FS.rejected_rows(m.spark, root, "raw", "order_items")
    bad = bad.groupBy("column").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.length("value")).cast("bigint").alias("content"))
    return good.unionByName(bad)


@query("mart_category_year")
def _mart_category_year(m: Models) -> DataFrame:
    """Category/year selection on the year-partitioned mart: the year filter prunes folders."""
    from .build import build

    root = m.scratch("partitioned")
    built = build(m.raw, root=root, select=["monthly_revenue_by_cat"])["monthly_revenue_by_cat"]
    mart = FS.read_mart(m.spark, root, "monthly_revenue_by_cat", schema=built.schema)
    return FL.in_category_year(mart, SELECTED_CATEGORIES, SELECTED_YEARS)


# ------------------------------------------------------------------ staging
for _name, _attr in [
    ("stg_category_translate", "stg_translate"),
    ("stg_customer", "stg_customer"),
    ("stg_order", "stg_order"),
    ("stg_order_items", "stg_items"),
    ("stg_products", "stg_products"),
    ("stg_sellers", "stg_sellers"),
]:
    query(_name)(lambda m, _a=_attr: getattr(m, _a))


# ------------------------------------------------------------------ filters
@query("flt_status")
def _flt_status(m: Models) -> DataFrame:
    return FL.exclude_status(m.fct, M.EXCLUDED_STATUSES)


@query("flt_positive_amount")
def _flt_positive(m: Models) -> DataFrame:
    return FL.positive_amount(m.fct, "total_order_amount")


@query("flt_categories")
def _flt_categories(m: Models) -> DataFrame:
    return FL.in_categories(m.pcd, SELECTED_CATEGORIES).select("product_id", "category", "product_revenue")


@query("flt_category_year")
def _flt_category_year(m: Models) -> DataFrame:
    return FL.in_category_year(m.revenue_by_cat, SELECTED_CATEGORIES, SELECTED_YEARS)


@query("flt_reliable")
def _flt_reliable(m: Models) -> DataFrame:
    return FL.reliable_only(m.pcd).select("product_id", "category", "sales_count", "reliability_score")


@query("flt_workhorse")
def _flt_workhorse(m: Models) -> DataFrame:
    return FL.workhorses(m.pcd).select("product_id", "category", "product_revenue", "pareto_revenue_pct")


@query("flt_repeat")
def _flt_repeat(m: Models) -> DataFrame:
    return FL.repeat_orders(m.retention).select("order_id", "customer_unique_id", "order_sequence")


@query("flt_true_repeat")
def _flt_true_repeat(m: Models) -> DataFrame:
    return FL.true_repeats(m.event_retention).select("order_id", "customer_unique_id", "days_between_orders")


@query("true_repeats")
def _true_repeats(m: Models) -> DataFrame:
    return FL.drop_technical_splits(m.event_retention, 0.05)


def z_labelled(m: Models) -> DataFrame:
    """The product mart with a label from the z-score alone (stands in for the forest's)."""
    outlier = F.coalesce(F.abs(F.col("total_cost_z_score")) > Z_CUTOFF, F.lit(False))
    return m.pcd.withColumn("Result", F.when(outlier, RESULT_ANOMALY).otherwise(RESULT_NORMAL))


@query("flt_anomalies")
def _flt_anomalies(m: Models) -> DataFrame:
    return FL.anomalies_only(z_labelled(m)).select("product_id", "category", "Result")


# ------------------------------------------------------------------ joins
@query("join_orders_items")
def _join_orders_items(m: Models) -> DataFrame:
    return J.attach_order_totals(m.stg_order.select("order_id", "customer_id"), A.order_totals(m.stg_items))


@query("join_translation")
def _join_translation(m: Models) -> DataFrame:
    t = m.stg_translate.select(F.col("category_name_pt").alias("product_category_name"), "category_name_en")
    return J.join_small(m.stg_products.select("product_id", "product_category_name"), t, "product_category_name", "left")


@query("join_fact_customer")
def _join_fact_customer(m: Models) -> DataFrame:
    return J.fact_with_person(m.fct.select("order_id", "customer_id", "total_order_amount"), m.stg_customer)


@query("join_person_stats")
def _join_person_stats(m: Models) -> DataFrame:
    persons = M.customers_unique(m.stg_customer)
    stats = A.customer_stats(m.fct, m.stg_customer).select("customer_unique_id", "total_orders", "lifetime_value")
    return persons.join(stats, "customer_unique_id", "left")


@query("cross_max_date")
def _cross_max_date(m: Models) -> DataFrame:
    mp = m.mapping
    return J.with_global(mp, A.max_value(mp, "purchase_at", "max_data_date"))


@query("join_order_item_product")
def _join_oip(m: Models) -> DataFrame:
    return J.order_item_product(
        m.stg_order.select("order_id", "purchase_at"),
        m.stg_items.select("order_id", "order_item_id", "product_id", "total_item_cost"),
        m.stg_products.select("product_id", "product_category_name"),
    )


@query("join_items_dim")
def _join_items_dim(m: Models) -> DataFrame:
    return m.stg_items.select("order_id", "order_item_id", "product_id", "price").join(
        m.dim_products.select("product_id", "category_name"), "product_id", "inner"
    )


@query("order_mapping")
def _order_mapping(m: Models) -> DataFrame:
    return m.mapping


# ------------------------------------------------------------------ aggregates
@query("agg_order_totals")
def _agg_order_totals(m: Models) -> DataFrame:
    return A.order_totals(m.stg_items)


@query("agg_customer_stats")
def _agg_customer_stats(m: Models) -> DataFrame:
    return A.customer_stats(m.fct, m.stg_customer)


@query("agg_max_date")
def _agg_max_date(m: Models) -> DataFrame:
    return A.max_value(m.mapping, "purchase_at", "max_data_date")


@query("agg_month")
def _agg_month(m: Models) -> DataFrame:
    return A.monthly_totals(m.fct)


@query("agg_month_category")
def _agg_month_category(m: Models) -> DataFrame:
    return m.revenue_by_cat.select("revenue_month", "product_category", "monthly_revenue", "product_sold")


@query("agg_product_means")
def _agg_product_means(m: Models) -> DataFrame:
    return A.product_moments(m.stg_items).select("product_id", "sales_count", "avg_price", "avg_freight", "avg_total_cost")


@query("agg_product_volatility")
def _agg_product_volatility(m: Models) -> DataFrame:
    return A.product_moments(m.stg_items).select(
        "product_id", "price_volatility", "freight_volatility", "total_cost_volatility"
    )


@query("distinct_on_person")
def _distinct_on_person(m: Models) -> DataFrame:
    return M.customers_unique(m.stg_customer)


@query("hist_recency_nice")
def _hist_recency_nice(m: Models) -> DataFrame:
    """Recency of all orders in at most 50 bins of a readable width."""
    return A.nice_histogram(m.retention, "recency_days", 50)


@query("hist_gap_nice")
def _hist_gap_nice(m: Models) -> DataFrame:
    """Gaps of true repeats in at most 200 bins of a readable width."""
    return A.nice_histogram(FL.true_repeats(m.event_retention), "days_between_orders", 200)


@query("kpi_unique_customers_sketch")
def _kpi_unique_sketch(m: Models) -> DataFrame:
    """Per year: orders and distinct persons, and whether the union of the months' sketches is within its error bound."""
    ret = m.retention
    year = lambda c: F.year(c).cast("bigint").alias("year")
    sketched = K.persons_of(K.person_sketches(ret).withColumn("year", year(F.col("order_month"))), ["year"]).withColumnRenamed("persons", "estimate")
    exact = ret.groupBy(year(F.col("most_recent_purchase_at"))).agg(F.count_distinct("customer_unique_id").alias("persons"))
    off = F.abs(F.col("estimate") - F.col("persons")) <= F.ceil(F.col("persons") * F.lit(K.SKETCH_ERROR))
    return sketched.join(exact, "year").select("year", "orders", "persons", off.alias("within_bound"))


@query("flt_many_products")
def _flt_many_products(m: Models) -> DataFrame:
    """A selection of very many values (every third key up to 300,000): joined, not spelled out."""
    return FL.in_values(m.pcd, "product_id", range(0, 300_000, 3)).select("product_id", "category", "sales_count")


@query("kpi_unique_customers")
def _kpi_unique(m: Models) -> DataFrame:
    return K.unique_customers(m.retention)


@query("distinct_categories")
def _distinct_categories(m: Models) -> DataFrame:
    return A.distinct_sorted(m.pcd, "category")


@query("distinct_years")
def _distinct_years(m: Models) -> DataFrame:
    return A.distinct_sorted(m.revenue_by_cat, "revenue_year", "int")


@query("kpi_repeat_rate")
def _kpi_repeat_rate(m: Models) -> DataFrame:
    return K.repeat_rate(m.retention)


@query("customer_repeat_rate")
def _kpi_customer_repeat_rate(m: Models) -> DataFrame:
    return K.customer_repeat_rate(m.retention)


@query("lifecycle_distribution")
def _lifecycle_distribution(m: Models) -> DataFrame:
    return K.lifecycle_distribution(m.retention)


@query("hist_recency")
def _hist_recency(m: Models) -> DataFrame:
    return A.histogram(m.retention, "recency_days", RECENCY_BIN_DAYS)


@query("hist_gap")
def _hist_gap(m: Models) -> DataFrame:
    return A.histogram(FL.true_repeats(m.event_retention), "days_between_orders", GAP_BIN_DAYS, 0.0)


@query("yearly_avg_revenue")
def _yearly_avg_revenue(m: Models) -> DataFrame:
    return A.yearly_avg_revenue(m.revenue_by_cat)


@query("kpi_pareto")
def _kpi_pareto(m: Models) -> DataFrame:
    return K.pareto_kpis(m.pcd)


@query("kpi_same_day")
def _kpi_same_day(m: Models) -> DataFrame:
    return K.same_day_kpis(m.event_retention)


@query("max_gap")
def _max_gap(m: Models) -> DataFrame:
    return K.max_gap(m.event_retention)


@query("category_month_series")
def _category_month_series(m: Models) -> DataFrame:
    sel = FL.in_category_year(m.revenue_by_cat, SELECTED_CATEGORIES, SELECTED_YEARS)
    return sel.select(
        "product_category", "revenue_year", "revenue_month_num", "monthly_revenue", "product_sold"
    ).orderBy("product_category", "revenue_year", "revenue_month_num")


# ------------------------------------------------------------------ windows
@query("win_prev_order")
def _win_prev(m: Models) -> DataFrame:
    return m.retention_facts.select("order_id", "customer_unique_id", "purchase_at", "previous_order_at")


@query("win_order_sequence")
def _win_seq(m: Models) -> DataFrame:
    return m.retention_facts.select("order_id", "customer_unique_id", "order_sequence")


@query("win_customer_orders")
def _win_count(m: Models) -> DataFrame:
    return m.retention_facts.select("order_id", "customer_unique_id", "total_customer_orders")


@query("win_category_mean")
def _win_cat_mean(m: Models) -> DataFrame:
    return m.features.select("product_id", "category", "cat_avg_total_cost")


@query("win_category_stddev")
def _win_cat_sd(m: Models) -> DataFrame:
    return m.features.select("product_id", "category", "cat_stddev_total_cost")


@query("win_category_freight")
def _win_cat_freight(m: Models) -> DataFrame:
    return m.features.select("product_id", "category", "cat_avg_freight_share")


@query("win_running_revenue")
def _win_running(m: Models) -> DataFrame:
    return m.pcd.select("product_id", "category", "product_revenue", "cumulative_category_revenue")


@query("win_total_revenue")
def _win_total(m: Models) -> DataFrame:
    return m.pcd.select("product_id", "category", "total_category_revenue")


def _with_skew(m: Models, heavy_rows: int, bucket_rows: int, fn: Callable[[], DataFrame]) -> DataFrame:
    """``fn()`` with limits so low that keys are split (they are looked for as the frame is made)."""
    limits = {"basketry.skew.heavyRows": heavy_rows, "basketry.skew.bucketRows": bucket_rows}
    old = {k: m.spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            m.spark.conf.set(k, str(v))
        return fn()
    finally:
        for k, v in old.items():
            m.spark.conf.unset(k) if v is None else m.spark.conf.set(k, v)


@query("retention_split")
def _retention_split(m: Models) -> DataFrame:
    """The retention mart with every person of more than 15 orders cut into buckets of about 6."""
    return _with_skew(m, 15, 6, lambda: m.retention)


@query("pareto_split")
def _pareto_split(m: Models) -> DataFrame:
    """Running revenue with every category of more than 100 products cut into buckets of about 40."""
    cols = ("product_id", "category", "product_revenue", "cumulative_category_revenue", "total_category_revenue")
    return _with_skew(m, 100, 40, lambda: m.pcd.select(*cols))


# ------------------------------------------------------------------ sorts
@query("sort_month")
def _sort_month(m: Models) -> DataFrame:
    return m.monthly_revenue.orderBy(F.desc("order_month"))


@query("sort_year_month_revenue")
def _sort_ymr(m: Models) -> DataFrame:
    return m.revenue_by_cat.orderBy(F.desc("revenue_year"), F.desc("revenue_month_num"), F.desc("monthly_revenue"))


# ------------------------------------------------------------------ scalar functions
@query("fn_cast_timestamp")
def _fn_cast_ts(m: Models) -> DataFrame:
    o = m.raw["orders"].select("order_id", F.col("order_purchase_timestamp").cast("string").alias("ts_text"))
    return o.select("order_id", "ts_text", to_timestamp_ntz("ts_text").alias("ts"))


@query("fn_month")
def _fn_month(m: Models) -> DataFrame:
    return m.stg_order.select("order_id", month_start("purchase_at").alias("order_month"))


@query("fn_numeric")
def _fn_numeric(m: Models) -> DataFrame:
    return m.stg_items.select(
        "order_id", "order_item_id", "product_id", F.col("total_item_cost").cast("decimal(20,4)").alias("cost_numeric")
    )


@query("fn_round")
def _fn_round(m: Models) -> DataFrame:
    return m.base_stats.select(
        "product_id",
        round_to(F.col("avg_price") / F.lit(Decimal(3)), 2).alias("third_price_2"),
        round_to(F.col("avg_total_cost") / F.lit(Decimal(7)), 4).alias("seventh_cost_4"),
    )


@query("fn_year_month")
def _fn_year_month(m: Models) -> DataFrame:
    return m.stg_order.select("order_id", year_of("purchase_at").alias("y"), month_of("purchase_at").alias("m"))


@query("fn_year_month_label")
def _fn_ym_label(m: Models) -> DataFrame:
    return m.stg_order.select("order_id", year_month_label("purchase_at").alias("year_month"))


@query("fn_days_between")
def _fn_days_between(m: Models) -> DataFrame:
    return m.stg_order.select(
        "order_id", round_to(days_between("estimated_delivery_at", "purchase_at"), 6).alias("days")
    )


@query("fn_recency_days")
def _fn_recency(m: Models) -> DataFrame:
    return m.stg_order.select("order_id", elapsed_days("estimated_delivery_at", "purchase_at").alias("elapsed_days"))


@query("fn_coalesce")
def _fn_coalesce(m: Models) -> DataFrame:
    return m.stg_order.select(
        "order_id", F.coalesce("delivered_to_customer_at", "delivered_to_carrier_at", "estimated_delivery_at").alias("first_known")
    )


@query("fn_safe_divide")
def _fn_safe_divide(m: Models) -> DataFrame:
    return m.fct.select(
        "order_id", round_to(safe_divide(F.col("total_freight"), F.col("total_price")), 6).alias("freight_ratio")
    )


@query("fn_volume")
def _fn_volume(m: Models) -> DataFrame:
    return m.dim_products.select("product_id", "volume_cm3")


@query("fn_case_segment")
def _fn_case_segment(m: Models) -> DataFrame:
    return m.dim_customer.select("customer_unique_id", "lifetime_value", "customer_segment")


@query("fn_fillna")
def _fn_fillna(m: Models) -> DataFrame:
    return m.retention.select("order_id", "days_between_orders").fillna({"days_between_orders": 0})


@query("fn_value_map")
def _fn_value_map(m: Models) -> DataFrame:
    codes = {"delivered": "done", "shipped": "open", "canceled": "void"}
    return m.stg_order.select("order_id", value_map(F.col("order_status"), codes).alias("state"))


# ------------------------------------------------------------------ marts and their columns
query("fct_orders")(lambda m: m.fct)
query("dim_products")(lambda m: m.dim_products)
query("dim_customer")(lambda m: m.dim_customer)
query("monthly_revenue")(lambda m: m.monthly_revenue)
query("monthly_revenue_by_cat")(lambda m: m.revenue_by_cat)
query("product_base_stats")(lambda m: m.base_stats)
query("product_cost_decomposition")(lambda m: m.pcd)
query("retention_facts")(
    lambda m: m.retention_facts.select(
        "customer_unique_id",
        "order_id",
        "purchase_at",
        "previous_order_at",
        "order_sequence",
        "total_customer_orders",
        "days_between_orders",
        "recency_days",
    )
)
query("customer_retention")(lambda m: m.retention)
query("event_retention")(lambda m: m.event_retention)  # the retention mart over purchase events


@query("customer_segments")
def _customer_segments(m: Models) -> DataFrame:
    return m.dim_customer.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"))


@query("reliability_score")
def _reliability(m: Models) -> DataFrame:
    return m.base_stats.select("product_id", "sales_count", "reliability_score")


@query("freight_share")
def _freight_share(m: Models) -> DataFrame:
    return m.features.select("product_id", "avg_freight", "avg_total_cost", "freight_share_pct")


@query("category_benchmarks")
def _category_benchmarks(m: Models) -> DataFrame:
    return M.category_benchmarks(m.base_stats)


@query("total_cost_z_score")
def _z(m: Models) -> DataFrame:
    return m.features.select("product_id", "category", "total_cost_z_score")


@query("price_rebalanced")
def _rebalanced(m: Models) -> DataFrame:
    return m.features.select("product_id", "sales_count", "is_price_rebalanced")


@query("freight_deviation")
def _freight_dev(m: Models) -> DataFrame:
    return M.freight_share_corrected(m.features).select(
        "product_id", "freight_pct_diff_from_avg", "cat_avg_freight_share_pct", "freight_share_pct_diff"
    )


@query("cost_cv")
def _cost_cv(m: Models) -> DataFrame:
    return m.features.select("product_id", "total_cost_cv")


@query("product_revenue")
def _product_revenue(m: Models) -> DataFrame:
    return m.features.select("product_id", "avg_price", "sales_count", "product_revenue")


@query("pareto_products")
def _pareto_products(m: Models) -> DataFrame:
    return m.pcd.select(
        "product_id",
        "category",
        "cumulative_category_revenue",
        "total_category_revenue",
        "product_revenue_share_pct",
        "pareto_revenue_pct",
        "is_revenue_workhorse",
    )


@query("pareto_categories")
def _pareto_categories(m: Models) -> DataFrame:
    cat = m.pcd.groupBy("category").agg(A.money_sum("product_revenue").alias("category_revenue"))
    # one row per category; more of them than the heavy-key limit are cut into buckets as any heavy key is
    one = cat.withColumn("scope", F.lit("all")).checkpoint()
    return M.pareto(one, value="category_revenue", by="scope").select(
        "category",
        "category_revenue",
        F.col("cumulative_category_revenue").alias("cumulative_revenue"),
        F.col("total_category_revenue").alias("total_revenue"),
        F.col("product_revenue_share_pct").alias("revenue_share_pct"),
        "pareto_revenue_pct",
        F.col("is_revenue_workhorse").alias("is_top_category"),
    )


@query("lifecycle_stage")
def _lifecycle(m: Models) -> DataFrame:
    return m.retention.select("order_id", "order_sequence", "total_customer_orders", "recency_days", "lifecycle_stage")


@query("retention_window")
def _ret_window(m: Models) -> DataFrame:
    return m.retention.select("order_id", "order_sequence", "days_between_orders", "retention_window")


# ------------------------------------------------------------------ analytics / ML
@query("anomaly_features")
def _anomaly_features(m: Models) -> DataFrame:
    return anomaly_features(FL.reliable_only(m.pcd))


@query("isolation_forest")
def _isolation_forest(m: Models) -> DataFrame:
    return isolation_forest_scores(FL.reliable_only(m.pcd), contamination=CONTAMINATION)


@query("anomaly_labels")
def _anomaly_labels(m: Models) -> DataFrame:
    return detect_anomalies(m.pcd, contamination=CONTAMINATION)


@query("kpi_anomalies")
def _kpi_anomalies(m: Models) -> DataFrame:
    labelled = detect_anomalies(m.pcd, contamination=CONTAMINATION)
    return K.anomaly_kpis(FL.reliable_only(labelled))


@query("audit_view")
def _audit_view(m: Models) -> DataFrame:
    return audit_view(detect_anomalies(m.pcd, contamination=CONTAMINATION))


@query("anomaly_split")
def _anomaly_split(m: Models) -> DataFrame:
    """Which products the forest has labelled: every one but single sales, all rows kept."""
    labelled = detect_anomalies(m.pcd, contamination=CONTAMINATION)
    return labelled.select("product_id", (F.col("Result") != RESULT_UNSCORED).alias("is_analyzed"))


@query("anomaly_min_rows")
def _anomaly_min_rows(m: Models) -> DataFrame:
    """With fewer trainable rows than asked for nothing is analysed."""
    return detect_anomalies(m.pcd, contamination=CONTAMINATION, min_rows=10**12).select("product_id", "Result")


@query("anomaly_min_rows_bound")
def _anomaly_min_rows_bound(m: Models) -> DataFrame:
    """Asked for as many trainable rows as there are, products are labelled; asked for one more, none is."""
    n = FL.reliable_only(m.pcd).count()
    at = detect_anomalies(m.pcd, contamination=CONTAMINATION, min_rows=n).select("product_id", F.col("Result").alias("at_bound"))
    over = detect_anomalies(m.pcd, contamination=CONTAMINATION, min_rows=n + 1).select("product_id", F.col("Result").alias("below_bound"))
    return at.join(over, "product_id")


@query("kpi_items_analyzed")
def _kpi_items_analyzed(m: Models) -> DataFrame:
    labelled = detect_anomalies(m.pcd, contamination=CONTAMINATION)
    return K.anomaly_kpis(FL.reliable_only(labelled)).select("items_analyzed")


@query("audit_columns")
def _audit_columns(m: Models) -> DataFrame:
    """The audit table of labelled products, without the label."""
    return audit_view(detect_anomalies(m.pcd, contamination=CONTAMINATION)).drop("Result")


@query("audit_only_anomalies")
def _audit_only_anomalies(m: Models) -> DataFrame:
    return audit_view(z_labelled(m), only_workhorses=True, only_anomalies=True)


@query("outlier_map")
def _outlier_map(m: Models) -> DataFrame:
    """Frame of the outlier map: trained rows with price, freight, sales and features, without the label."""
    return outlier_map(detect_anomalies(m.pcd, contamination=CONTAMINATION)).drop("Result")


@query("cv_above_quantile")
def _cv_above_quantile(m: Models) -> DataFrame:
    """The contamination cut on a given column: products above the exact 0.95 quantile of cost variation."""
    return above_quantile(FL.reliable_only(m.pcd), "total_cost_cv", 1 - CONTAMINATION)


@query("audit_workhorses")
def _audit_workhorses(m: Models) -> DataFrame:
    v = audit_view(m.pcd.withColumn("Result", F.lit(None).cast("string")), only_workhorses=True)
    return v.drop("Result")


@query("z_outliers")
def _z_outliers(m: Models) -> DataFrame:
    return z_outliers(m.pcd, "total_cost_z_score", Z_CUTOFF).select("product_id", "category", "total_cost_z_score")


# ------------------------------------------------------------------ data quality
@query("dq_unique")
def _dq_unique(m: Models) -> DataFrame:
    return Q.check_unique(m.stg_items, "order_id")


@query("dq_not_null")
def _dq_not_null(m: Models) -> DataFrame:
    return Q.check_not_null(m.retention, "previous_order_at").select("order_id", "order_sequence")


@query("dq_accepted_values")
def _dq_accepted(m: Models) -> DataFrame:
    return Q.check_accepted(m.stg_order, "order_status", ["delivered", "shipped", "processing"])


@query("dq_accepted_range")
def _dq_range(m: Models) -> DataFrame:
    return Q.check_range(m.base_stats, "sales_count", min_value=4, inclusive=True).select("product_id", "sales_count")


@query("dq_expression")
def _dq_expr(m: Models) -> DataFrame:
    return Q.check_expr(m.event_retention, "days_between_orders", "> 0.05", "order_sequence > 1").select(
        "order_id", "days_between_orders"
    )


@query("dq_same_count")
def _dq_same_count(m: Models) -> DataFrame:
    return Q.check_same_count(m.pcd, detect_anomalies(m.pcd, contamination=CONTAMINATION))


@query("dq_report")
def _dq_report(m: Models) -> DataFrame:
    """The declared checks over the marts of one build, as written."""
    return Q.run_checks({"orders": m.stg_order, **{k: v for k, v in _built(m).items() if k in BUILD_COLUMNS}})


FLAGSHIP = "customer_retention"
