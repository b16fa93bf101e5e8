"""Model build: staging views and mart tables in dependency order.

Staging models are lazy DataFrames.  Marts are written as parquet tables
(overwrite) under ``<root>/analytics`` when a root is given, then read back,
so every later mart reads the materialised table instead of recomputing its
lineage — the same role a table materialisation plays in a warehouse, and
a lineage cut that survives executor loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from ..operators import marts as M
from ..operators import staging as S
from ..sources.bucketed import read_bucketed, write_bucketed
from ..sources.files import read_table, write_table

STAGING: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "stg_order": ("orders", S.stg_order),
    "stg_order_items": ("order_items", S.stg_order_items),
    "stg_customer": ("customers", S.stg_customer),
    "stg_products": ("products", S.stg_products),
    "stg_category_translate": ("product_category_name_translation", S.stg_category_translate),
    "stg_sellers": ("sellers", S.stg_sellers),
}

# mart -> (upstream models, builder over the model dict)
MARTS: dict[str, tuple[tuple[str, ...], Callable[[dict[str, DataFrame]], DataFrame]]] = {
    "fct_orders": (("stg_order", "stg_order_items"), lambda m: M.fct_orders(m["stg_order"], m["stg_order_items"])),
    "dim_products": (
        ("stg_products", "stg_category_translate"),
        lambda m: M.dim_products(m["stg_products"], m["stg_category_translate"]),
    ),
    "dim_customer": (("fct_orders", "stg_customer"), lambda m: M.dim_customer(m["fct_orders"], m["stg_customer"])),
    "monthly_revenue": (("fct_orders",), lambda m: M.monthly_revenue(m["fct_orders"])),
    "monthly_revenue_by_cat": (
        ("stg_order", "stg_order_items", "stg_products", "stg_category_translate"),
        lambda m: M.monthly_revenue_by_cat(
            m["stg_order"], m["stg_order_items"], m["stg_products"], m["stg_category_translate"]
        ),
    ),
    "product_cost_decomposition": (
        ("stg_order_items", "dim_products"),
        lambda m: M.product_cost_decomposition(m["stg_order_items"], m["dim_products"]),
    ),
    "customer_retention": (
        ("fct_orders", "stg_customer"),
        lambda m: M.customer_retention(m["fct_orders"], m["stg_customer"]),
    ),
}


# Marts written with folder partitioning: the dashboards select years of the
# category revenue, so a year filter prunes folders at the scan.
MART_PARTITIONS: dict[str, list[str]] = {"monthly_revenue_by_cat": ["revenue_year"]}

# Tables that a build with buckets deals by the key of the order-to-person bridge: the fact and the bridge meet
# in two joins (lifetime values, retention) and an aggregate, all on this key.
BUCKET_KEYS: dict[str, str] = {"fct_orders": "customer_id", "stg_customer": "customer_id"}


def stage(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All staging models whose raw table is present."""
    return {name: fn(raw[src]) for name, (src, fn) in STAGING.items() if src in raw}


def buildable(raw: Iterable[str], select: Iterable[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Of the selected marts those whose raw tables are all there, and the absent ones of the others."""
    have, ok, absent = set(raw), [], {}
    for mart in select:
        need = {STAGING[d][0] for m in _closure([mart]) for d in MARTS[m][0] if d in STAGING}
        if need <= have:
            ok.append(mart)
        else:
            absent[mart] = sorted(need - have)
    return ok, absent


def _closure(select: Iterable[str]) -> list[str]:
    """Selected marts plus the marts they depend on, in a valid build order."""
    need: set[str] = set()

    def visit(m: str) -> None:
        if m in need or m not in MARTS:
            return
        for dep in MARTS[m][0]:
            visit(dep)
        need.add(m)

    for m in select:
        if m not in MARTS:
            raise KeyError(f"unknown mart {m!r}")
        visit(m)
    return [m for m in MARTS if m in need]


def _levels(names: list[str]) -> list[list[str]]:
    """Group marts into dependency levels: every mart's upstream marts are in earlier levels."""
    level: dict[str, int] = {}
    for m in names:  # ``names`` is already in a valid build order
        deps = [d for d in MARTS[m][0] if d in MARTS]
        level[m] = 1 + max((level[d] for d in deps), default=-1)
    out: list[list[str]] = [[] for _ in range(max(level.values(), default=-1) + 1)]
    for m in names:
        out[level[m]].append(m)
    return out


def build(
    raw: dict[str, DataFrame],
    root: str | None = None,
    select: Iterable[str] | None = None,
    threads: int = 4,
    buckets: int | None = None,
) -> dict[str, DataFrame]:
    """Build the models; with ``root``, write each mart and continue from the written table.

    Marts of one dependency level are independent, so with ``root`` they are
    written concurrently from up to ``threads`` driver threads (separate Spark
    jobs sharing the executors); the next level starts when its inputs are
    written.  Without ``root`` everything stays lazy.  With ``buckets`` the
    fact and the customer bridge are written in that many buckets of the order's
    customer id, and the marts above them join and aggregate without shuffling
    either (a number of buckets that suits the fact's size, the same at every build).
    """
    models: dict[str, DataFrame] = dict(stage(raw))
    spark = next(iter(models.values())).sparkSession
    names = _closure(select if select is not None else MARTS)
    if root is None:
        for name in names:
            models[name] = MARTS[name][1](models)
        return models

    def materialise(name: str) -> DataFrame:
        df = MARTS[name][1](models)
        if buckets and name in BUCKET_KEYS:
            write_bucketed(df, root, "analytics", name, BUCKET_KEYS[name], buckets)
            return read_bucketed(spark, root, "analytics", name)
        write_table(df, root, "analytics", name, observe=False, partition_by=MART_PARTITIONS.get(name))
        return read_table(spark, root, "analytics", name, schema=df.schema).select(*df.columns)

    needed = {dep for name in names for dep in MARTS[name][0]}
    for name in BUCKET_KEYS.keys() & STAGING.keys() & models.keys() & needed if buckets else ():
        write_bucketed(models[name], root, "staging", name, BUCKET_KEYS[name], buckets)
        models[name] = read_bucketed(spark, root, "staging", name)

    for level in _levels(names):
        if threads > 1 and len(level) > 1:
            with ThreadPoolExecutor(max_workers=min(threads, len(level))) as pool:
                done = dict(zip(level, pool.map(materialise, level)))
        else:
            done = {name: materialise(name) for name in level}
        models.update(done)
    return models
