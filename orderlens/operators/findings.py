"""Rule-based findings as tables: recommendations, insights, business status.

All metrics of a view are gathered into one row (global aggregates plus scalar
subqueries); each rule is a ``CASE WHEN`` producing a struct or null, and the
surviving structs are exploded into rows. Nothing is collected to the driver.
Boundaries are strict exactly as the rules state them. An empty view yields
no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.config import checkpoint_root
from orderlens.functions.formats import count_text, fixed_text, money_text, percent_text
from orderlens.operators import metrics as K

# --- fixed values -----------------------------------------------------------
LATE_RATE_GUARDRAIL = 0.10
FREIGHT_SHARE_GUARDRAIL = 0.15
REVIEW_TARGET = 4.0
REVIEW_GAP_ALERT = 0.25
LATE_DELAY_ALERT_DAYS = 3.0
REPEAT_RATE_TARGET = 0.10
TOP_THREE_SHARE_ALERT = 0.60

# Message texts (printf-style; '%s' takes pre-formatted numbers).
TEXT = {
    "R1_warn": "Audit carrier and seller fulfillment because %s of orders are late, above the 10%% guardrail.",
    "R1_ok": "Keep the current delivery controls and monitor exceptions; the %s late rate is within the 10%% guardrail.",
    "R2_warn": "Renegotiate shipping rates or revise free-shipping thresholds because freight represents %s of collected order value.",
    "R2_ok": "Continue monitoring freight by route; its current %s share is below the 15%% alert level.",
    "R3_warn": "Prioritize service recovery and seller quality checks because the average review is %s/5.",
    "R3_ok": "Preserve the practices supporting the %s/5 review score and investigate low-score exceptions.",
    "R4": "Protect stock availability and seller coverage in %s, which generates %s of filtered revenue.",
    "R5": "Review routes, carriers, and promised dates in %s; its late rate is %s across %s orders.",
    "R6": "Inspect seller handling and packaging SLAs for %s; it has the highest eligible category late rate at %s.",
    "R7": "Test bundling, regional fulfillment, or minimum-order thresholds for %s, where freight reaches %s of collected value.",
    "R8": "Send proactive delay notifications and recovery offers; late delivery is associated with a %s-point review penalty.",
    "R9": "Introduce carrier escalation before the promised date because late orders miss it by %s days on average.",
    "R10_low": "Launch post-purchase and second-order campaigns; only %s of customers in this view placed more than one order.",
    "R10_ok": "Build loyalty offers around the %s repeat-customer base.",
    "R11_down": "Investigate availability, demand, and campaign changes because the latest monthly revenue fell %s.",
    "R11_up": "Identify the categories and states behind the latest %s monthly growth and repeat the strongest actions.",
    "R12": "Reduce category concentration by developing adjacent categories; the top three currently contribute %s of revenue.",
    "I1": "Category leader: %s contributes %s of revenue.",
    "I2": "Geographic leader: %s contributes %s of revenue.",
    "I3": "Revenue concentration: the top three categories account for %s of revenue.",
    "I4": "Peak sales period: %s generated R$ %s.",
    "I5": "Delivery outcome: %s of %s orders were late; %s arrived on time.",
    "I6": "Customer retention: %s of %s customers placed more than one order.",
    "I7": "Freight burden: freight represents %s of the total amount collected from products and shipping.",
    "I8_late": "Late-order severity: late deliveries missed the estimate by %s days on average.",
    "I8_none": "Late-order severity: no late orders appear in the selected view.",
    "I9": "Latest monthly movement: revenue %s by %s versus the previous period.",
    "I10": "Highest-risk state: %s has a %s late rate across %s eligible orders.",
    "I11": "Highest-risk category: %s has a %s late rate across %s eligible orders.",
    "I12": "Delivery effect on reviews: on-time orders score %s points %s than late orders on average.",
    "I13": "Highest freight burden: %s spends %s of collected value on freight.",
    "G1_ok": "Delivery is within the 10% late-rate guardrail.",
    "G1_warn": "Delivery is outside the 10% late-rate guardrail.",
    "G2_ok": "Customer reviews meet the 4/5 target.",
    "G2_warn": "Customer reviews are below the 4/5 target.",
    "G3_ok": "Freight is within the 15% cost guardrail.",
    "G3_warn": "Freight is above the 15% cost guardrail.",
}
# ---------------------------------------------------------------------------

FINDING_FIELDS = ["rule_id", "seq", "severity", "label", "subject", "metric_1", "metric_2", "metric_3", "text"]


def dashboard_metrics(view: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Every scalar the rules read, as one row, in three scans of the view.

    Scan 1: one global aggregate (KPIs, late delay, review means). Scan 2: the
    category / state / month summaries via grouping sets, checkpointed (one
    row per group); concentration, peak, growth and risk leaders are read
    from that small table. Scan 3: orders per customer for the repeat rate.
    ``groups`` is that small table where the caller already has it.
    """
    late = F.col("is_late") == 1
    status = F.col("delivery_status")
    g = view.agg(
        F.sum("total_sales").cast(K.REVENUE).alias("total_revenue"),
        F.sum("total_freight").cast(K.FREIGHT).alias("total_freight"),
        F.count("*").alias("total_orders"),
        F.coalesce(F.sum("is_late"), F.lit(0)).cast(T.LongType()).alias("late_orders"),
        F.avg("delivery_days").alias("average_delivery"),
        F.avg("is_late").alias("late_rate"),
        F.avg("average_review_score").alias("average_review"),
        F.avg(F.when(late, F.col("delivery_days") - F.col("estimated_delivery_days"))).alias("_late_delay"),
        F.avg(F.when(status == "On Time", F.col("average_review_score"))).alias("review_on_time"),
        F.avg(F.when(status == "Late", F.col("average_review_score"))).alias("review_late"),
    )
    if groups is None:
        # Materialise the small grouping-sets table once (shared checkpoint folder):
        # every derived scalar then reads it instead of re-scanning the view.
        checkpoint_root(view.sparkSession)
        groups = K.grouping_table(view).checkpoint(eager=True)
    cats, states, months = K.split_grouping_table(groups)
    min_group = cats.agg(K.minimum_group_orders(F.sum("orders"))).scalar()
    peak = K._struct_scalar(K.peak_from(months))
    growth = K.growth_from(months).select("latest_growth").scalar()
    rep = K._struct_scalar(K.repeat_customers(view))
    return g.select(
        "total_revenue", "total_freight", "total_orders", "late_orders",
        F.when(F.col("total_orders") > 0, K.as_double("total_revenue") / F.col("total_orders")).alias("average_order_value"),
        "average_delivery", "late_rate", (F.lit(1.0) - F.col("late_rate")).alias("on_time_rate"), "average_review",
        K.share_of_collected("total_freight", "total_revenue").alias("freight_share"),
        K.minimum_group_orders("total_orders").alias("minimum_group_orders"),
        *K.concentration_cols(cats, states, F.col("total_revenue")),
        peak["peak_period"].alias("peak_period"), peak["peak_revenue"].alias("peak_revenue"),
        growth.alias("latest_growth"),
        rep["customers"].alias("customers"), rep["repeat_customers"].alias("repeat_customers"),
        rep["repeat_rate"].alias("repeat_rate"),
        F.coalesce(F.col("_late_delay"), F.lit(0.0)).alias("average_late_delay"),
        "review_on_time", "review_late", (F.col("review_on_time") - F.col("review_late")).alias("review_gap"),
        *K.risk_cols(cats, states, min_group),
    )


def _row(rule_id: str, seq: int, severity: str | Column, label: str, text: Column,
         subject: Column | None = None, m1: Column | None = None, m2: Column | None = None,
         m3: Column | None = None) -> Column:
    def dbl(c: Column | None) -> Column:
        return (c if c is not None else F.lit(None)).cast(T.DoubleType())

    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(seq).alias("seq"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        F.lit(label).alias("label"),
        (subject if subject is not None else F.lit(None)).cast(T.StringType()).alias("subject"),
        dbl(m1).alias("metric_1"),
        dbl(m2).alias("metric_2"),
        dbl(m3).alias("metric_3"),
        text.alias("text"),
    )


def _explode(metrics_row: DataFrame, rules: list[Column], with_text: bool) -> DataFrame:
    arr = F.filter(F.array(*rules), lambda r: r.isNotNull())
    out = metrics_row.where(F.col("total_orders") > 0).select(F.inline(arr))
    return out if with_text else out.drop("text")


def recommendations(view: DataFrame, with_text: bool = True) -> DataFrame:
    return recommendations_from(dashboard_metrics(view), with_text)


def recommendations_from(m: DataFrame, with_text: bool = True) -> DataFrame:
    """R1-R12 over a one-row metrics table (see ``dashboard_metrics``)."""
    c = F.col
    late, fs, rev = c("late_rate"), c("freight_share"), c("average_review")
    rules = [
        F.when(late > LATE_RATE_GUARDRAIL,
               _row("R1", 1, "warning", "High priority", F.format_string(TEXT["R1_warn"], percent_text(late)), m1=late))
        .otherwise(_row("R1", 1, "success", "Maintain", F.format_string(TEXT["R1_ok"], percent_text(late)), m1=late)),
        F.when(fs > FREIGHT_SHARE_GUARDRAIL,
               _row("R2", 2, "warning", "Cost", F.format_string(TEXT["R2_warn"], percent_text(fs)), m1=fs))
        .otherwise(_row("R2", 2, "info", "Cost", F.format_string(TEXT["R2_ok"], percent_text(fs)), m1=fs)),
        F.when(rev.isNotNull() & (rev < REVIEW_TARGET),
               _row("R3", 3, "warning", "Customer experience", F.format_string(TEXT["R3_warn"], fixed_text(rev, 2)), m1=rev))
        .when(rev.isNotNull(),
              _row("R3", 3, "success", "Customer experience", F.format_string(TEXT["R3_ok"], fixed_text(rev, 2)), m1=rev)),
        _row("R4", 4, "info", "Inventory",
             F.format_string(TEXT["R4"], c("top_category"), percent_text(c("top_category_share"))),
             subject=c("top_category"), m1=c("top_category_share")),
        F.when(c("highest_risk_state").isNotNull(),
               _row("R5", 5, "warning", "Geography",
                    F.format_string(TEXT["R5"], c("highest_risk_state"), percent_text(c("highest_risk_state_late_rate")),
                                    count_text(c("highest_risk_state_orders"))),
                    subject=c("highest_risk_state"), m1=c("highest_risk_state_late_rate"),
                    m2=c("highest_risk_state_orders"))),
        F.when(c("highest_risk_category").isNotNull(),
               _row("R6", 6, "warning", "Seller operations",
                    F.format_string(TEXT["R6"], c("highest_risk_category"), percent_text(c("highest_risk_category_late_rate"))),
                    subject=c("highest_risk_category"), m1=c("highest_risk_category_late_rate"),
                    m2=c("highest_risk_category_orders"))),
        F.when(c("highest_freight_category").isNotNull(),
               _row("R7", 7, "info", "Shipping efficiency",
                    F.format_string(TEXT["R7"], c("highest_freight_category"), percent_text(c("highest_freight_category_share"))),
                    subject=c("highest_freight_category"), m1=c("highest_freight_category_share"))),
        F.when(c("review_gap").isNotNull() & (c("review_gap") > REVIEW_GAP_ALERT),
               _row("R8", 8, "warning", "Reviews", F.format_string(TEXT["R8"], fixed_text(c("review_gap"), 2)),
                    m1=c("review_gap"))),
        F.when(c("average_late_delay") > LATE_DELAY_ALERT_DAYS,
               _row("R9", 9, "warning", "Escalation", F.format_string(TEXT["R9"], fixed_text(c("average_late_delay"), 1)),
                    m1=c("average_late_delay"))),
        F.when(c("repeat_rate") < REPEAT_RATE_TARGET,
               _row("R10", 10, "info", "Retention", F.format_string(TEXT["R10_low"], percent_text(c("repeat_rate"))),
                    m1=c("repeat_rate")))
        .otherwise(_row("R10", 10, "success", "Retention", F.format_string(TEXT["R10_ok"], percent_text(c("repeat_rate"))),
                        m1=c("repeat_rate"))),
        F.when(c("latest_growth").isNotNull() & (c("latest_growth") < 0),
               _row("R11", 11, "warning", "Revenue trend",
                    F.format_string(TEXT["R11_down"], percent_text(F.abs(c("latest_growth")))), m1=c("latest_growth")))
        .when(c("latest_growth").isNotNull(),
              _row("R11", 11, "success", "Revenue trend",
                   F.format_string(TEXT["R11_up"], percent_text(c("latest_growth"))), m1=c("latest_growth"))),
        F.when(c("top_three_category_share") > TOP_THREE_SHARE_ALERT,
               _row("R12", 12, "info", "Portfolio risk",
                    F.format_string(TEXT["R12"], percent_text(c("top_three_category_share"))),
                    m1=c("top_three_category_share"))),
    ]
    return _explode(m, rules, with_text)


def insights(view: DataFrame, with_text: bool = True) -> DataFrame:
    return insights_from(dashboard_metrics(view), with_text)


def insights_from(m: DataFrame, with_text: bool = True) -> DataFrame:
    """I1-I13 over a one-row metrics table."""
    c = F.col
    g, gap = c("latest_growth"), c("review_gap")
    rules = [
        _row("I1", 1, "info", "Category leader",
             F.format_string(TEXT["I1"], c("top_category"), percent_text(c("top_category_share"))),
             subject=c("top_category"), m1=c("top_category_share")),
        _row("I2", 2, "info", "Geographic leader",
             F.format_string(TEXT["I2"], c("top_state"), percent_text(c("top_state_share"))),
             subject=c("top_state"), m1=c("top_state_share")),
        _row("I3", 3, "info", "Revenue concentration",
             F.format_string(TEXT["I3"], percent_text(c("top_three_category_share"))), m1=c("top_three_category_share")),
        _row("I4", 4, "info", "Peak sales period",
             F.format_string(TEXT["I4"], c("peak_period"), money_text(c("peak_revenue"))),
             subject=c("peak_period"), m1=c("peak_revenue")),
        _row("I5", 5, "info", "Delivery outcome",
             F.format_string(TEXT["I5"], count_text(c("late_orders")), count_text(c("total_orders")),
                             percent_text(c("on_time_rate"))),
             m1=c("late_orders"), m2=c("total_orders"), m3=c("on_time_rate")),
        _row("I6", 6, "info", "Customer retention",
             F.format_string(TEXT["I6"], percent_text(c("repeat_rate")), count_text(c("customers"))),
             m1=c("repeat_rate"), m2=c("customers")),
        _row("I7", 7, "info", "Freight burden", F.format_string(TEXT["I7"], percent_text(c("freight_share"))),
             m1=c("freight_share")),
        F.when(c("late_orders") > 0,
               _row("I8", 8, "info", "Late-order severity",
                    F.format_string(TEXT["I8_late"], fixed_text(c("average_late_delay"), 1)), subject=F.lit("late"),
                    m1=c("average_late_delay")))
        .otherwise(_row("I8", 8, "info", "Late-order severity", F.lit(TEXT["I8_none"]), subject=F.lit("none"))),
        F.when(g.isNotNull(),
               _row("I9", 9, "info", "Latest monthly movement",
                    F.format_string(TEXT["I9"], F.when(g >= 0, "increased").otherwise("decreased"), percent_text(F.abs(g))),
                    subject=F.when(g >= 0, "increased").otherwise("decreased"), m1=F.abs(g))),
        F.when(c("highest_risk_state").isNotNull(),
               _row("I10", 10, "info", "Highest-risk state",
                    F.format_string(TEXT["I10"], c("highest_risk_state"), percent_text(c("highest_risk_state_late_rate")),
                                    count_text(c("highest_risk_state_orders"))),
                    subject=c("highest_risk_state"), m1=c("highest_risk_state_late_rate"),
                    m2=c("highest_risk_state_orders"))),
        F.when(c("highest_risk_category").isNotNull(),
               _row("I11", 11, "info", "Highest-risk category",
                    F.format_string(TEXT["I11"], c("highest_risk_category"),
                                    percent_text(c("highest_risk_category_late_rate")),
                                    count_text(c("highest_risk_category_orders"))),
                    subject=c("highest_risk_category"), m1=c("highest_risk_category_late_rate"),
                    m2=c("highest_risk_category_orders"))),
        F.when(gap.isNotNull(),
               _row("I12", 12, "info", "Delivery effect on reviews",
                    F.format_string(TEXT["I12"], fixed_text(F.abs(gap), 2), F.when(gap >= 0, "higher").otherwise("lower")),
                    subject=F.when(gap >= 0, "higher").otherwise("lower"), m1=F.abs(gap))),
        F.when(c("highest_freight_category").isNotNull(),
               _row("I13", 13, "info", "Highest freight burden",
                    F.format_string(TEXT["I13"], c("highest_freight_category"),
                                    percent_text(c("highest_freight_category_share"))),
                    subject=c("highest_freight_category"), m1=c("highest_freight_category_share"))),
    ]
    return _explode(m, rules, with_text)


def business_status(view: DataFrame, with_text: bool = True) -> DataFrame:
    """Three guardrails: late rate, review target (null review is a warning), freight share."""
    return business_status_from(K.kpis(view), with_text)


def business_status_from(m: DataFrame, with_text: bool = True) -> DataFrame:
    """G1-G3 over a one-row KPI table."""
    c = F.col
    ok1 = c("late_rate") <= LATE_RATE_GUARDRAIL
    ok2 = c("average_review").isNotNull() & (c("average_review") >= REVIEW_TARGET)
    ok3 = c("freight_share") <= FREIGHT_SHARE_GUARDRAIL

    def status(sid: str, seq: int, label: str, ok: Column, value: Column) -> Column:
        healthy = F.coalesce(ok, F.lit(False))
        return _row(sid, seq, F.when(healthy, "success").otherwise("warning"), label,
                    F.when(healthy, TEXT[f"{sid}_ok"]).otherwise(TEXT[f"{sid}_warn"]), m1=value)

    rules = [
        status("G1", 1, "Delivery", ok1, c("late_rate")),
        status("G2", 2, "Reviews", ok2, c("average_review")),
        status("G3", 3, "Freight", ok3, c("freight_share")),
    ]
    return _explode(m, rules, with_text)


def finding_texts(view: DataFrame) -> DataFrame:
    """The text of every finding of a view: kind, rule, place in its list, text."""
    m = dashboard_metrics(view)
    lists = {"recommendation": recommendations_from(m), "insight": insights_from(m), "status": business_status(view)}
    parts = [df.select(F.lit(kind).alias("kind"), "rule_id", "seq", "text") for kind, df in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
