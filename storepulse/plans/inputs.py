"""Inputs of the registered queries, derived from the driver tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import split_store_events
from ..operators.prices import current_products
from ..sources import tables

# Fixed parameters of the registered queries (FIXTURES.md section 3).
AS_OF = dt.datetime(2001, 11, 4)
DEAL_MONTHS = 12
DEAL_DISCOUNT = 10.0
# Purchases average 48 in value here, so the bonus thresholds are scaled down.
BONUS_MIN_SHORT = 50.0
BONUS_MIN_LONG = 100.0
PRICE_UPDATE_N = 1000
PRICE_UPDATE_SEED = 7
# Deal requests as the dashboard sends them; the last two are rejected (discount 0, a period without a start).
DEAL_REQUESTS = [
    '{"task_name": "price_monitor_job", "time_window": 12, "discount_percentage": 10}',
    '{"task_name": "price_monitor_job", "time_window": 1, "discount_percentage": 5.5}',
    '{"task_name": "price_monitor_job", "time_window": 48, "discount_percentage": 25}',
    '{"task_name": "price_monitor_job", "time_window": 240, "discount_percentage": 30}',
    '{"task_name": "price_monitor_job", "time_window": 6, "discount_percentage": 0}',
    '{"task_name": "price_monitor_job", "time_window": 100000, "discount_percentage": 10}',
]


@dataclass(eq=False)
class StoreInputs:
    """Lazily built, cached DataFrames of one table directory (each table is
    read once per query, so identical sub-plans share one relation)."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def events(self) -> DataFrame:
        return tables.store_events(self.spark, self.sf_dir)

    @cached_property
    def _split(self) -> dict[str, DataFrame]:
        return split_store_events(self.events)

    @cached_property
    def views(self) -> DataFrame:
        return self._split["view"]

    @cached_property
    def buys(self) -> DataFrame:
        return self._split["buy"]

    @cached_property
    def products_all_versions(self) -> DataFrame:
        return tables.products(self.spark, self.sf_dir)

    @cached_property
    def products(self) -> DataFrame:
        return current_products(self.products_all_versions)

    @cached_property
    def stock(self) -> DataFrame:
        return tables.stock(self.spark, self.sf_dir)

    @cached_property
    def history(self) -> DataFrame:
        return tables.price_history(self.spark, self.sf_dir)

    @cached_property
    def catalog(self) -> DataFrame:
        return tables.catalog(self.spark, self.sf_dir)

    @cached_property
    def purchases(self) -> DataFrame:
        """Purchases with a FLOAT price (the bonus job's typing)."""
        return (self.events.filter(F.col("event_type") == "purchase")
                    .select("user_id", "store_id", "product_id",
                            F.col("value").cast("float").alias("price"), F.col("ts").alias("datetime")))
