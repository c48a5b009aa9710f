"""Dashboard metrics over a (filtered) order mart.

Every function is ``view -> DataFrame`` and lazy. Global figures that feed a
row-level expression (total revenue, the minimum group size) enter through
scalar subqueries: computed once, inlined as a literal, no join. Top-k and
arg-max compile to ``TakeOrderedAndProject`` (per-partition top-k, then a
merge of k rows per task), never a global sort. Values are unrounded here;
``present`` rounds floating columns for reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.aggregates import exact_medians_row
from orderlens.functions.columns import (
    as_double,
    metric,
    minimum_group_orders,
    safe_ratio,
    share_of_collected,
    share_or_null,
)
from orderlens.functions.formats import count_text, fixed_text, money_text, percent_text

REVENUE = T.DecimalType(38, 2)
FREIGHT = T.DecimalType(38, 4)
TOP_K = 10


def present(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column (sums of doubles differ in the last bits by order)."""
    return df.select(
        *[metric(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
          for f in df.schema.fields]
    )


def filter_view(mart: DataFrame, state: str | None = None, category: str | None = None) -> DataFrame:
    """Customer-state filter, then product-category filter; ``None``/'All' skips one."""
    view = mart
    if state not in (None, "All"):
        view = view.where(F.col("customer_state") == F.lit(state))
    if category not in (None, "All"):
        view = view.where(F.col("product_category") == F.lit(category))
    return view


def _struct_scalar(df: DataFrame) -> Column:
    """All columns of a one-row (or empty) DataFrame as one struct scalar subquery."""
    return df.select(F.struct(*df.columns).alias("s")).scalar()


def kpis(view: DataFrame) -> DataFrame:
    """Headline block: revenue, freight, orders, late orders, AOV, delivery, rates, review.

    ``total_orders`` is ``count(*)``: the mart's ``order_id`` is unique (checked
    when it is materialised), so no distinct-count shuffle is needed.
    An empty view gives one row with 0 orders and null ratios.
    """
    a = view.agg(
        F.sum("total_sales").cast(REVENUE).alias("total_revenue"),
        F.sum("total_freight").cast(FREIGHT).alias("total_freight"),
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum("is_late"), F.lit(0)).cast(T.LongType()).alias("late_orders"),
        F.avg("delivery_days").alias("average_delivery"),
        F.avg("is_late").alias("late_rate"),
        F.avg("average_review_score").alias("average_review"),
    )
    return a.select(
        "total_revenue",
        "total_freight",
        "total_orders",
        "late_orders",
        F.when(F.col("total_orders") > 0, as_double("total_revenue") / F.col("total_orders")).alias("average_order_value"),
        "average_delivery",
        "late_rate",
        (F.lit(1.0) - F.col("late_rate")).alias("on_time_rate"),
        "average_review",
        share_of_collected("total_freight", "total_revenue").alias("freight_share"),
        minimum_group_orders("total_orders").alias("minimum_group_orders"),
    )


def with_rank(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with its total order as a column: ``rank`` from 1 (a summary, one row per group)."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def sorted_outputs(mart: DataFrame) -> DataFrame:
    """Ranks of all sorted outputs: which, rank, key, and the revenue it is sorted by (if it is)."""
    none = F.lit(None).cast(REVENUE)
    parts = []
    for name, df, key in (("category_summary", category_summary(mart), "product_category"),
                          ("state_summary", state_summary(mart), "customer_state")):
        ranked = with_rank(df, *_by_revenue(key))
        parts.append(ranked.select(F.lit(name).alias("output"), "rank", F.col(key).alias("key"), "revenue"))
    months = with_rank(monthly_revenue(mart), "purchase_period")
    parts.append(months.select(F.lit("monthly_revenue").alias("output"), "rank", F.col("purchase_period").alias("key"), none.alias("revenue")))
    domains = with_rank(filter_domains(mart), "domain", "value")
    parts.append(domains.select(F.lit("filter_domains").alias("output"), "rank",
                                F.concat_ws("=", "domain", "value").alias("key"), none.alias("revenue")))
    return reduce(DataFrame.unionByName, parts)


def widest_review_gap_view(mart: DataFrame) -> DataFrame:
    """The orders of the customer state whose reviews fall most when late (ties: the first state)."""
    gaps = mart.groupBy("customer_state").agg(
        (F.avg(F.when(F.col("delivery_status") == "On Time", F.col("average_review_score")))
         - F.avg(F.when(F.col("delivery_status") == "Late", F.col("average_review_score")))).alias("gap"))
    widest = gaps.where("gap is not null").orderBy(F.desc("gap"), "customer_state").limit(1)
    return mart.where(F.col("customer_state") == widest.select("customer_state").scalar())


def number_formats(mart: DataFrame) -> DataFrame:
    """Per order, figures of the mart in all formats; sixteenths and eighths of them end in ties."""
    sales, items = F.col("total_sales").cast(T.DoubleType()), F.col("item_count").cast(T.DoubleType())
    return mart.select(
        "order_id", percent_text(items / 16).alias("share"), percent_text(items / 80, 2).alias("fine_share"),
        fixed_text(sales / 8, 2).alias("eighth"), fixed_text(-sales / 4, 1).alias("quarter"),
        fixed_text(F.col("delivery_days"), 1).alias("days"), fixed_text(sales * 12.5, 0, grouped=True).alias("grouped"),
        fixed_text(items * 0.15, 1).alias("binary"), count_text(F.floor(sales)).alias("units"), money_text("total_sales").alias("money"))


def category_summary(view: DataFrame) -> DataFrame:
    """Per category: revenue, freight, orders, late rate, freight share (null if no value)."""
    return view.groupBy("product_category").agg(
        F.sum("total_sales").cast(REVENUE).alias("revenue"),
        F.sum("total_freight").cast(FREIGHT).alias("freight"),
        F.count("*").alias("orders"),
        F.avg("is_late").alias("late_rate"),
    ).withColumn("freight_share", share_or_null("freight", "revenue"))


def state_summary(view: DataFrame) -> DataFrame:
    """Per customer state: revenue, orders, late rate, average delivery days."""
    return view.groupBy("customer_state").agg(
        F.sum("total_sales").cast(REVENUE).alias("revenue"),
        F.count("*").alias("orders"),
        F.avg("is_late").alias("late_rate"),
        F.avg("delivery_days").alias("average_delivery"),
    )


def monthly_revenue(view: DataFrame) -> DataFrame:
    """Revenue per ``yyyy-MM`` period present in the view (absent months not filled)."""
    return view.groupBy("purchase_period").agg(F.sum("total_sales").cast(REVENUE).alias("revenue"))


def _min_group(view: DataFrame) -> Column:
    return view.agg(minimum_group_orders(F.count("*"))).scalar()


def eligible(summary: DataFrame, view: DataFrame) -> DataFrame:
    """Groups with at least the minimum group size of orders."""
    return summary.where(F.col("orders") >= _min_group(view))


def _by_revenue(key: str) -> list[Column]:
    return [F.desc("revenue"), F.asc(key)]


def _by_late_rate(key: str) -> list[Column]:
    # arg-max of the late rate over a revenue-ordered table: ties -> more revenue
    return [F.desc("late_rate"), F.desc("revenue"), F.asc(key)]


def top_categories(view: DataFrame, k: int = TOP_K) -> DataFrame:
    return category_summary(view).orderBy(*_by_revenue("product_category")).limit(k)


def top_states(view: DataFrame, k: int = TOP_K) -> DataFrame:
    return state_summary(view).orderBy(*_by_revenue("customer_state")).limit(k)


def late_rate_by_state_eligible(view: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k eligible states by late rate (the late-rate chart)."""
    return eligible(state_summary(view), view).orderBy(*_by_late_rate("customer_state")).limit(k)


def category_eligible(view: DataFrame) -> DataFrame:
    """All categories that reach the minimum group size."""
    return eligible(category_summary(view), view)


def _leader(among: Column, falling: list[str], key: str, carry: list[str] = ()) -> Column:
    """The group that leads by ``falling`` (each descending, nulls last), then by ``key``, as an aggregate.

    A minimum over structs of negated measures: it merges per-partition leaders
    and needs no sort. A measure ``m`` is read back as ``-_m``.
    """
    fields = [f for m in falling for f in (F.col(m).isNull().alias(f"_no_{m}"), (-F.col(m)).alias(f"_{m}"))]
    return F.min(F.when(among, F.struct(*fields, key, *carry)))


def concentration(view: DataFrame) -> DataFrame:
    """Top category / state and their revenue shares; top-three category share (two scans of the view)."""
    is_cat, is_state = F.col("_gid") == CATEGORY_SET, F.col("_gid") == STATE_SET
    top3 = category_summary(view).orderBy(*_by_revenue("product_category")).limit(3).agg(F.sum("revenue")).scalar()
    a = grouping_table(view).agg(
        F.sum(F.when(is_cat, F.col("revenue"))).cast(REVENUE).alias("total"),
        _leader(is_cat, ["revenue"], "product_category").alias("c"),
        _leader(is_state, ["revenue"], "customer_state").alias("s"),
    )
    total = F.col("total")
    return a.select(
        F.col("c.product_category").alias("top_category"),
        safe_ratio(-F.col("c._revenue"), total).alias("top_category_share"),
        F.col("s.customer_state").alias("top_state"),
        safe_ratio(-F.col("s._revenue"), total).alias("top_state_share"),
        safe_ratio(top3, total).alias("top_three_category_share"),
    )


def concentration_cols(cats: DataFrame, states: DataFrame, total: Column) -> list[Column]:
    """Concentration columns from the two summaries and the total revenue (a column of the row)."""
    cats = cats.orderBy(*_by_revenue("product_category"))
    states = states.orderBy(*_by_revenue("customer_state"))
    top_cat = _struct_scalar(cats.limit(1).select("product_category", "revenue"))
    top_state = _struct_scalar(states.limit(1).select("customer_state", "revenue"))
    top3 = cats.limit(3).agg(F.sum("revenue").alias("r")).scalar()
    return [
        top_cat["product_category"].alias("top_category"),
        safe_ratio(top_cat["revenue"], total).alias("top_category_share"),
        top_state["customer_state"].alias("top_state"),
        safe_ratio(top_state["revenue"], total).alias("top_state_share"),
        safe_ratio(top3, total).alias("top_three_category_share"),
    ]


def peak_period(view: DataFrame) -> DataFrame:
    """Month with the highest revenue; ties go to the earliest month."""
    return peak_from(monthly_revenue(view))


def peak_from(months: DataFrame) -> DataFrame:
    return (
        months.orderBy(F.desc("revenue"), F.asc("purchase_period"))
        .limit(1)
        .select(F.col("purchase_period").alias("peak_period"), F.col("revenue").alias("peak_revenue"))
    )


def latest_growth(view: DataFrame) -> DataFrame:
    """Last present month vs the one before: ``last / previous - 1``.

    Null with fewer than two months or a non-positive previous month. Reads
    only the two latest rows of the monthly table (top-2, no window).
    """
    return growth_from(monthly_revenue(view))


def growth_from(months: DataFrame) -> DataFrame:
    last2 = months.orderBy(F.desc("purchase_period")).limit(2)
    a = last2.agg(
        F.count("*").alias("_n"),
        F.max("purchase_period").alias("latest_period"),
        F.max_by("revenue", "purchase_period").alias("latest_revenue"),
        F.min("purchase_period").alias("_p0"),
        F.min_by("revenue", "purchase_period").alias("_r0"),
    )
    two = F.col("_n") == 2
    prev = F.when(two, F.col("_r0"))
    return a.select(
        "latest_period",
        "latest_revenue",
        F.when(two, F.col("_p0")).alias("previous_period"),
        prev.alias("previous_revenue"),
        F.when(two & (prev > 0), as_double("latest_revenue") / as_double(prev) - F.lit(1.0)).alias("latest_growth"),
    )


def repeat_customers(view: DataFrame) -> DataFrame:
    """Customers (by unique id, nulls dropped), repeat customers and the repeat rate."""
    per_customer = (
        view.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.count("*").alias("orders"))
    )
    a = per_customer.agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("orders") > 1).alias("repeat_customers"),
    )
    return a.select(
        "customers",
        "repeat_customers",
        F.when(F.col("customers") > 0, F.col("repeat_customers") / F.col("customers"))
        .otherwise(F.lit(0.0)).alias("repeat_rate"),
    )


def late_delay(view: DataFrame) -> DataFrame:
    """Late orders and their mean days past the estimate (0.0 when none are late)."""
    late = F.col("is_late") == 1
    return view.agg(
        F.count_if(late).alias("late_orders"),
        F.coalesce(
            F.avg(F.when(late, F.col("delivery_days") - F.col("estimated_delivery_days"))), F.lit(0.0)
        ).alias("average_late_delay"),
    )


def review_by_status(view: DataFrame) -> DataFrame:
    """Mean review per delivery status (one row per status present)."""
    return view.groupBy("delivery_status").agg(F.avg("average_review_score").alias("average_review"))


def review_gap(view: DataFrame) -> DataFrame:
    """Mean review of on-time minus late orders; null unless both means exist."""
    a = view.agg(
        F.avg(F.when(F.col("delivery_status") == "On Time", F.col("average_review_score"))).alias("review_on_time"),
        F.avg(F.when(F.col("delivery_status") == "Late", F.col("average_review_score"))).alias("review_late"),
    )
    return a.withColumn("review_gap", F.col("review_on_time") - F.col("review_late"))


def risk_leaders(view: DataFrame) -> DataFrame:
    """Highest-risk eligible state and category; eligible category with the top freight share.

    Two scans of the view: its row count (the minimum group size) and the group summaries.
    """
    enough = F.col("orders") >= _min_group(view)
    is_cat, is_state = enough & (F.col("_gid") == CATEGORY_SET), enough & (F.col("_gid") == STATE_SET)
    g = grouping_table(view).withColumn("freight_share", share_or_null("freight", "revenue"))
    a = g.agg(
        _leader(is_state, ["late_rate", "revenue"], "customer_state", ["orders"]).alias("s"),
        _leader(is_cat, ["late_rate", "revenue"], "product_category", ["orders"]).alias("c"),
        _leader(is_cat & F.col("freight_share").isNotNull(), ["freight_share", "revenue"], "product_category").alias("f"),
    )
    return a.select(
        F.col("s.customer_state").alias("highest_risk_state"),
        (-F.col("s._late_rate")).alias("highest_risk_state_late_rate"),
        F.col("s.orders").alias("highest_risk_state_orders"),
        F.col("c.product_category").alias("highest_risk_category"),
        (-F.col("c._late_rate")).alias("highest_risk_category_late_rate"),
        F.col("c.orders").alias("highest_risk_category_orders"),
        F.col("f.product_category").alias("highest_freight_category"),
        (-F.col("f._freight_share")).alias("highest_freight_category_share"),
    )


def risk_cols(cats: DataFrame, states: DataFrame, min_group: Column) -> list[Column]:
    """Risk-leader columns from the two summaries and the minimum group size (scalar)."""
    states = states.where(F.col("orders") >= min_group)
    cats = cats.where(F.col("orders") >= min_group)
    s = _struct_scalar(states.orderBy(*_by_late_rate("customer_state")).limit(1)
                       .select("customer_state", "late_rate", "orders"))
    c = _struct_scalar(cats.orderBy(*_by_late_rate("product_category")).limit(1)
                       .select("product_category", "late_rate", "orders"))
    fr = _struct_scalar(
        cats.where(F.col("freight_share").isNotNull())
        .orderBy(F.desc("freight_share"), F.desc("revenue"), F.asc("product_category")).limit(1)
        .select("product_category", "freight_share")
    )
    return [
        s["customer_state"].alias("highest_risk_state"),
        s["late_rate"].alias("highest_risk_state_late_rate"),
        s["orders"].alias("highest_risk_state_orders"),
        c["product_category"].alias("highest_risk_category"),
        c["late_rate"].alias("highest_risk_category_late_rate"),
        c["orders"].alias("highest_risk_category_orders"),
        fr["product_category"].alias("highest_freight_category"),
        fr["freight_share"].alias("highest_freight_category_share"),
    ]


_GS_KEYS = ["product_category", "customer_state", "purchase_period"]
# grouping_id bit set = column aggregated away; bits follow _GS_KEYS order
CATEGORY_SET, STATE_SET, MONTH_SET = 0b011, 0b101, 0b110


def grouping_table(view: DataFrame) -> DataFrame:
    """Category, state and month aggregates from ONE scan and ONE shuffle (grouping sets).

    Rows are expanded once per grouping set before the map-side partial
    aggregate, so the shuffle carries only partial rows per (set, key). The
    result has one row per category, state and month: small at any scale.
    """
    return view.groupingSets([["product_category"], ["customer_state"], ["purchase_period"]], *_GS_KEYS).agg(
        F.grouping_id().alias("_gid"),
        F.sum("total_sales").cast(REVENUE).alias("revenue"),
        F.sum("total_freight").cast(FREIGHT).alias("freight"),
        F.count("*").alias("orders"),
        F.avg("is_late").alias("late_rate"),
        F.avg("delivery_days").alias("average_delivery"),
    )


def split_grouping_table(g: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(category summary, state summary, monthly revenue) out of ``grouping_table``."""
    cats = g.where(F.col("_gid") == CATEGORY_SET).select(
        "product_category", "revenue", "freight", "orders", "late_rate",
        share_or_null("freight", "revenue").alias("freight_share"))
    states = g.where(F.col("_gid") == STATE_SET).select("customer_state", "revenue", "orders", "late_rate", "average_delivery")
    months = g.where(F.col("_gid") == MONTH_SET).select("purchase_period", "revenue")
    return cats, states, months


def filter_domains(mart: DataFrame, state: str | None = None) -> DataFrame:
    """Sorted option lists: states, categories (after the state filter), seller states (one scan)."""

    def option(name: str, col: str) -> Column:
        return F.struct(F.lit(name).alias("domain"), F.col(col).alias("value"))

    options = F.array(
        option("customer_state", "customer_state"),
        option("product_category", "product_category"),
        option("model_product_category", "product_category"),
        option("seller_state", "seller_state"),
    )
    if state not in (None, "All"):
        chosen = F.coalesce(F.col("customer_state") == F.lit(state), F.lit(False))
        options = F.filter(options, lambda o: (o["domain"] != "product_category") | chosen)
    return mart.select(F.inline(options)).distinct().orderBy("domain", "value")


def feature_defaults(mart: DataFrame) -> DataFrame:
    """Scoring-form defaults over the unfiltered mart: exact medians (days to 1 dp)."""
    cols = ["total_sales", "total_freight", "estimated_delivery_days"]
    meds = exact_medians_row(mart, cols).select(F.struct(*cols).alias("m")).scalar()
    sales, freight, days = (meds[c] for c in cols)
    return mart.agg(F.count("*").alias("orders")).select(
        "orders",
        sales.alias("median_total_sales"),
        freight.alias("median_total_freight"),
        F.bround(days, 1).alias("median_estimated_delivery_days"),
    )


def preview(view: DataFrame, n: int = 100) -> DataFrame:
    """First ``n`` rows of the view by order id (a bounded sample is the feature)."""
    return view.orderBy("order_id").limit(n)
