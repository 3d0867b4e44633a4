"""The order-entry computations over one folder of logs, each as a lazy DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import accounts, customers, modifications, orders, queue, stock, verify, views
from tillroll.session import configure, settle
from tillroll.sources import generate
from tillroll.sources.shop import DISTRICTS, Shop, epoch_ms, initial_stock


# where the log is cut in two runs: 1998-01-01
RESTART_MS = 883612800000


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.shop = Shop(configure(spark), folder)

    # ---- verification and numbering --------------------------------------

    @cached_property
    def approvals(self) -> DataFrame:
        return verify.approve(self.shop.orders, self.shop.plain_lines, self.shop.items)

    @cached_property
    def accepted(self) -> DataFrame:
        return verify.accept(self.shop.orders, self.shop.plain_lines, self.shop.items)

    @cached_property
    def approvals_with_totals(self) -> DataFrame:
        return verify.approve_with_totals(self.shop.orders, self.shop.plain_lines, self.shop.items)

    @cached_property
    def accepted_with_totals(self) -> DataFrame:
        """Accepted orders with n_lines and total."""
        return self.approvals_with_totals.where("approved").drop("approved")

    # ---- bounds on rows and group sizes, for the running sums ---------------

    @cached_property
    def order_bounds(self) -> dict:
        return {"rows": self.shop.rows("orders") + self.polls_at_most, "sizes": self.shop.district_sizes}

    @property
    def polls_at_most(self) -> int:
        """A warehouse has no more deliveries than orders, each with ten polls."""
        return DISTRICTS * self.shop.rows("orders")

    @cached_property
    def stock_bounds(self) -> dict:
        return {"rows": 2 * self.shop.rows("lineitem"), "sizes": self.shop.item_sizes}

    @cached_property
    def name_bounds(self) -> dict:
        return {"rows": self.shop.rows("customer")}

    @cached_property
    def payment_bounds(self) -> dict:
        return {"rows": self.shop.rows("events")}

    @cached_property
    def balance_bounds(self) -> dict:
        return {"rows": self.shop.rows("events", "orders")}

    # ---- numbering ------------------------------------------------------------

    @cached_property
    def numbered(self) -> DataFrame:
        return orders.number_orders(self.accepted, **self.order_bounds)

    # ---- lines --------------------------------------------------------------

    @cached_property
    def lines(self) -> DataFrame:
        """Numbered lines of accepted orders, with their order's header. Rejected orders
        are taken out on the orders' side, so the lines are joined once."""
        return self.shop.with_header(self.shop.request_lines, self.accepted)

    @cached_property
    def unnumbered_lines(self) -> DataFrame:
        lines = self.shop.bare_lines.select("txn", "item", "remote_w", "quantity")
        return self.shop.with_header(lines, self.accepted)

    @cached_property
    def priced(self) -> DataFrame:
        return orders.priced_lines(self.lines, self.shop.items)

    # ---- stock ----------------------------------------------------------------

    @cached_property
    def moved(self) -> DataFrame:
        """Every look at and change of a stock level, with the level after it."""
        return stock.with_levels(stock.movements(self.lines), **self.stock_bounds)

    @cached_property
    def bulk_lines(self) -> DataFrame:
        """The lines in units of 25: up to 250 at once."""
        return self.lines.withColumn("quantity", F.col("quantity") * 25)

    @cached_property
    def levels(self) -> DataFrame:
        return stock.current_levels(stock.movements(self.unnumbered_lines))

    # ---- queue ------------------------------------------------------------------

    @cached_property
    def district_log(self) -> DataFrame:
        """Orders and polls with their order ids. Written once: what is delivered, what is
        pending, balances and views each read it, some of them several times."""
        log = queue.district_log(
            self.accepted_with_totals.select("w", "d", "ts", "txn", "c", "total"),
            self.shop.deliveries,
            **self.order_bounds,
        )
        return settle(log)

    @cached_property
    def log_orders(self) -> DataFrame:
        return queue.numbered_orders(self.district_log)

    @cached_property
    def delivered(self) -> DataFrame:
        return queue.delivered(self.district_log)

    @cached_property
    def delivered_in_two_runs(self) -> DataFrame:
        """As ``delivered``, the log cut in two: the second run starts from the queues and
        pending orders that the first one left."""
        cut = F.col("ts") <= RESTART_MS
        placed = self.accepted_with_totals.select("w", "d", "ts", "txn", "c", "total")
        first = settle(queue.district_log(placed.where(cut), self.shop.deliveries.where(cut), **self.order_bounds))
        start = settle(queue.queues(first))
        done = settle(queue.delivered(first))
        waiting = queue.pending(queue.numbered_orders(first), done)
        second = queue.district_log(
            placed.where(~cut), self.shop.deliveries.where(~cut), start, **self.order_bounds
        )
        return done.unionByName(queue.delivered(settle(second), waiting=waiting))

    @cached_property
    def pending(self) -> DataFrame:
        return queue.pending(self.log_orders, self.delivered)

    @cached_property
    def delivery_times(self) -> DataFrame:
        """txn and result, the time of its delivery, of each delivered order."""
        at = self.delivered.select("w", "d", "order_id", F.col("ts").alias("result"))
        return self.log_orders.select("w", "d", "order_id", "txn").join(at, ["w", "d", "order_id"]).select("txn", "result")

    @cached_property
    def shipping_times(self) -> DataFrame:
        """txn, first and last: when the first and the last line of each order were shipped."""
        at = epoch_ms("l_shipdate")
        return self.shop.table("lineitem").groupBy(F.col("l_orderkey").alias("txn")).agg(
            F.min(at).alias("first"), F.max(at).alias("last")
        )

    # ---- money --------------------------------------------------------------------

    @cached_property
    def payments(self) -> DataFrame:
        return customers.resolve(self.shop.payments, self.shop.customers, **self.name_bounds)

    @cached_property
    def changes(self) -> DataFrame:
        return accounts.changes(self.payments, self.delivered)

    @cached_property
    def balances(self) -> DataFrame:
        return accounts.with_balance(self.changes, **self.balance_bounds)

    @cached_property
    def current_balances(self) -> DataFrame:
        return accounts.current_balances(self.changes)

    @cached_property
    def credit_data(self) -> DataFrame:
        return accounts.credit_data(self.payments, self.shop.customers, **self.payment_bounds)

    # ---- views ----------------------------------------------------------------------

    @cached_property
    def state(self) -> DataFrame:
        return views.customer_state(self.log_orders, self.delivered, self.current_balances)

    @cached_property
    def recent(self) -> DataFrame:
        newest = self.accepted.groupBy("w", "d").agg(F.count("*").alias("newest"))
        return orders.recent_orders(self.numbered, newest=newest)

    @cached_property
    def thresholds(self) -> DataFrame:
        """The level asked about in each district, 10 to 20."""
        return self.shop.districts.select(
            "w", "d", ((F.col("w") * 10 + F.col("d")) % 11 + 10).alias("threshold")
        )

    @cached_property
    def opening_stock(self) -> DataFrame:
        """The stock table: each part in each warehouse. Spark takes it to be as small as its parts and would
        broadcast it, so it asks for joins that shuffle."""
        items = self.shop.table("part").select(F.col("p_partkey").alias("item"))
        stock = generate.stock_keys(items, self.shop.rows("nation")).withColumn("quantity", initial_stock(F.col("item")))
        return stock.hint("merge")

    def with_dist_info(self, lines: DataFrame) -> DataFrame:
        """Lines with their text from the stock table; only its keys are joined."""
        keys = self.opening_stock.select("w", "item")
        return orders.with_dist_info(lines, keys, generate.stock_texts(F.col("supply_w"), F.col("item")))

    # ---- modification log -----------------------------------------------------------

    @cached_property
    def lines_at_home(self) -> DataFrame:
        """Lines with amount, text and the home warehouse's level."""
        return self.with_dist_info(orders.priced_lines(self.moved.where("role <> 'supply'"), self.shop.items))

    @cached_property
    def stock_modifications(self) -> DataFrame:
        return modifications.stock_modifications(self.lines_at_home, self.moved)

    @cached_property
    def modifications(self) -> DataFrame:
        return modifications.modification_log(
            self.log_orders, self.lines_at_home, self.moved, self.balances, self.payments,
            self.credit_data, self.delivered, self.shop.customers,
        )
