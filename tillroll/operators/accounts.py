"""Customer balances, bad-credit text, payment history and year-to-date sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import DATA_LIMIT, DATA_SHOWN, bad_credit_prefix, history_text
from tillroll.operators.scan import recent, running
from tillroll.sources.shop import DELIVERY, OPENING_BALANCE, PAYMENT

CUSTOMER = ["w", "d", "c"]
PAYER = ["c_w", "c_d", "c"]
# a prefix has at least 6 characters, so no more than this many fit into the text
PREFIXES_KEPT = DATA_LIMIT // 6 + 1


def changes(payments: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Signed balance changes: w, d, c, ts, kind, txn, change.

    ``payments``: resolved (c_w, c_d, c, ts, txn, amount); ``deliveries``: w, d, c, ts, txn, total.
    """
    paid = payments.select(
        F.col("c_w").alias("w"), F.col("c_d").alias("d"), "c", "ts", F.lit(PAYMENT).alias("kind"), "txn",
        (-F.col("amount")).cast("decimal(22,2)").alias("change"),
    )
    owed = deliveries.select(
        "w", "d", "c", "ts", F.lit(DELIVERY).alias("kind"), "txn",
        F.col("total").cast("decimal(22,2)").alias("change"),
    )
    return paid.unionByName(owed)


def with_balance(changed: DataFrame, start: DataFrame | None = None, **bounds) -> DataFrame:
    """Add ``balance`` after each change in log order; ``start``: w, d, c, start_balance."""
    out = running(changed, CUSTOMER, ["ts", "kind", "txn"], {"_sum": F.col("change")}, **bounds)
    opening = F.lit(OPENING_BALANCE).cast("decimal(22,2)")
    if start is not None:
        out = out.join(start, CUSTOMER, "left")
        opening = F.coalesce("start_balance", opening)
    return out.withColumn("balance", (opening + F.col("_sum")).cast("decimal(22,2)")).drop("_sum", "start_balance")


def current_balances(changed: DataFrame, start: DataFrame | None = None) -> DataFrame:
    total = changed.groupBy(*CUSTOMER).agg(F.sum("change").alias("_sum"))
    opening = F.lit(OPENING_BALANCE).cast("decimal(22,2)")
    if start is not None:
        total = total.join(start, CUSTOMER, "left")
        opening = F.coalesce("start_balance", opening)
    return total.select(*CUSTOMER, (opening + F.col("_sum")).cast("decimal(22,2)").alias("balance"))


def _numbered_prefixes(payments: DataFrame, customers: DataFrame, **bounds) -> tuple[DataFrame, DataFrame]:
    """Payments of bad-credit customers with number and prefix; those customers."""
    bad = customers.where("credit = 'BC'").select(
        F.col("w").alias("c_w"), F.col("d").alias("c_d"), "c", "opening_data"
    )
    prefix = bad_credit_prefix(*[F.col(x) for x in ("c", "c_d", "c_w", "d", "w", "amount")])
    theirs = payments.join(bad.select(*PAYER), PAYER, "left_semi").withColumn("_prefix", prefix)
    return running(theirs, PAYER, ["ts", "txn"], {"_n": F.lit(1)}, **bounds), bad


def credit_data(payments: DataFrame, customers: DataFrame, **bounds) -> DataFrame:
    """The text kept for each bad-credit customer after each payment.

    Every payment puts its prefix in front and cuts the text to 500 characters, so
    the text is the newest prefixes, then what the customer started with.
    """
    numbered, bad = _numbered_prefixes(payments, customers, **bounds)
    kept = recent(numbered, PAYER, "_n", F.col("_prefix"), PREFIXES_KEPT, "_prefixes")
    text = F.concat(F.array_join(F.reverse("_prefixes"), ""), F.col("opening_data"))
    return (
        kept.join(bad.hint("merge"), PAYER)
        .withColumn("data", F.substring(text, 1, DATA_LIMIT))
        .drop("_n", "_prefix", "_prefixes", "opening_data")
    )


def current_credit_data(payments: DataFrame, customers: DataFrame, **bounds) -> DataFrame:
    """Each paying bad-credit customer's text after the last payment: w, d, c, data.

    Only the newest prefixes that can fit are brought together, a bounded number each.
    """
    numbered, bad = _numbered_prefixes(payments, customers, **bounds)
    counts = payments.groupBy(*PAYER).agg(F.count("*").alias("_all"))
    newest = numbered.join(counts, PAYER).where(F.col("_n") > F.col("_all") - PREFIXES_KEPT)
    texts = newest.groupBy(*PAYER).agg(
        F.sort_array(F.collect_list(F.struct("_n", "_prefix")), asc=False).alias("_newest")
    )
    text = F.concat(F.array_join("_newest._prefix", ""), F.col("opening_data"))
    return texts.join(bad.hint("merge"), PAYER).select(
        F.col("c_w").alias("w"), F.col("c_d").alias("d"), "c", F.substring(text, 1, DATA_LIMIT).alias("data")
    )


def payment_results(
    payments: DataFrame,
    balances: DataFrame,
    texts: DataFrame,
    customers: DataFrame,
    warehouses: DataFrame,
    districts: DataFrame,
) -> DataFrame:
    """What the client gets back: names, addresses, credit, balance, and for
    bad-credit customers the first 200 characters of their text."""
    who = customers.drop("opening_balance", "opening_data").withColumnsRenamed({"w": "c_w", "d": "c_d"})
    return (
        payments.drop("last")
        .join(who, ["c_w", "c_d", "c"])
        .join(balances.where(F.col("kind") == PAYMENT).select("txn", "balance"), "txn")
        .join(texts.select("txn", F.substring("data", 1, DATA_SHOWN).alias("data")), "txn", "left")
        .join(warehouses, "w")
        .join(districts, ["w", "d"])
    )


def year_to_date(payments: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Per customer: paid so far, payments, deliveries."""
    paid = payments.groupBy(F.col("c_w").alias("w"), F.col("c_d").alias("d"), "c").agg(
        F.sum("amount").alias("paid"), F.count("*").alias("payments")
    )
    got = deliveries.groupBy("w", "d", "c").agg(F.count("*").alias("deliveries"))
    return paid.join(got, CUSTOMER, "full").select(
        *CUSTOMER,
        F.coalesce("paid", F.lit(0)).cast("decimal(22,2)").alias("paid"),
        F.coalesce("payments", F.lit(0)).alias("payments"),
        F.coalesce("deliveries", F.lit(0)).alias("deliveries"),
    )


def district_takings(payments: DataFrame) -> DataFrame:
    """Per paying district the amount taken (ytd) and the number of payments (ytd_compat)."""
    return payments.groupBy("w", "d").agg(F.sum("amount").alias("ytd"), F.count("*").alias("ytd_compat"))


def ytd_by_district(payments: DataFrame, compat: bool = False) -> DataFrame:
    """Amount taken by each paying district; ``compat`` counts payments instead."""
    total = F.col("ytd_compat" if compat else "ytd")
    return district_takings(payments).select("w", "d", total.alias("ytd"))


def ytd_by_warehouse(payments: DataFrame, compat: bool = False) -> DataFrame:
    """As above, added up over a warehouse's districts."""
    return ytd_by_district(payments, compat).groupBy("w").agg(F.sum("ytd").alias("ytd"))


def history(payments: DataFrame, warehouses: DataFrame, districts: DataFrame) -> DataFrame:
    named = payments.join(warehouses.select("w", "w_name"), "w").join(
        districts.select("w", "d", "d_name"), ["w", "d"]
    )
    return named.select(
        "txn", "c", "c_d", "c_w", "d", "w", "ts", "amount",
        history_text(F.col("w_name"), F.col("d_name")).alias("data"),
    )
