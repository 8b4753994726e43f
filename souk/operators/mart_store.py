"""The mart as a maintained table: loads of orders instead of full rebuilds.

A store keeps, per load, the order facts, the mergeable partials (sums per person and month,
traits per person) and the person rows that the load touched, each as Parquet
partitioned by load number. A load

* reduces its own orders to facts and partials; of all others it reads the order ids only,
* finds orders that it replaces (same ``order_id``, new status or dates): minima and maxima
  cannot be taken back, so the persons of replaced orders start anew, from the last version
  of each of their orders, and their older partials no longer count (only then are older
  facts read),
* recomputes the rows of touched persons alone, from their partials of all loads.

The mart reads every person's last row and takes the scores, which depend on all persons, by
selection (``with_tiles``). A load counts once its last file is written; a load that broke
off leaves files that nobody reads and the next attempt overwrites.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.operators import mart
from souk.operators.mart import KEY
from souk.session import stored_table
from souk.sources.loads import Loads


class MartStore(Loads):
    """Loads orders into the tables below ``path``, a folder that all executors share."""

    def load(self, orders: DataFrame, customers: DataFrame, order_items: DataFrame, payments: DataFrame,
             reviews: DataFrame, geolocation: DataFrame) -> int:
        """Add ``orders`` with all their items, payments and reviews; an order that is known
        takes the place of its former version. ``customers`` and ``geolocation`` are whole
        tables; persons without orders are added, too. -> the load's number"""
        n = self.last_load() + 1
        self.write(mart.order_facts(orders, customers, order_items, payments, reviews), "facts", n)
        facts = self.read("facts", n)
        own, older = facts.where(F.col("load") == n), facts.where(F.col("load") < n)
        # who holds or held a replaced order; the first load replaces none
        anew = own.select(KEY).limit(0)
        if n > 1:
            renewed = own.select("order_id").distinct().join(older.select("order_id").distinct(), "order_id", "left_semi")
            anew = facts.join(renewed, "order_id", "left_semi").select(KEY).distinct()
        self.write(anew, "anew", n)
        anew = self.read("anew", n).where(F.col("load") == n).select(KEY)
        counted = own
        if anew.take(1):
            counted = own.join(anew, KEY, "left_anti").unionByName(self._last_versions(facts, anew))
            counted = stored_table(counted, "counted")
        self.write(mart.month_partials(counted), "months", n)
        self.write(mart.trait_partials(counted), "traits", n)
        months, traits = self.read("months", n).drop("load"), self.read("traits", n).drop("load")
        if n > 1:
            new = customers.select(KEY).distinct().join(self.read("persons", n - 1).select(KEY).distinct(), KEY, "left_anti")
            touched = stored_table(own.select(KEY).unionByName(anew).unionByName(new).distinct(), "touched")
            customers = customers.join(touched, KEY, "left_semi")
            months = mart.merged_months(self._partials("months", touched, n))
            # rows of several loads stand side by side, as those of a person with many orders do
            traits = stored_table(self._partials("traits", touched, n), "traits")
        self.write(mart.person_rows(customers, geolocation, months, traits), "persons", n)
        return self.finish(n)

    @staticmethod
    def _last_versions(facts: DataFrame, persons: DataFrame) -> DataFrame:
        """The orders that ``persons`` hold now: last version of each order they ever had."""
        ever = facts.join(persons, KEY, "left_semi").select("order_id").distinct()
        versions = facts.join(ever, "order_id", "left_semi")
        last = versions.groupBy("order_id").agg(F.max("load").alias("load"))
        return versions.join(last, ["order_id", "load"]).join(persons, KEY, "left_semi").select(*facts.columns)

    def _partials(self, table: str, persons: DataFrame, n: int) -> DataFrame:
        """Partials of ``persons`` that count: those since they last started anew."""
        since = self.read("anew", n).groupBy(KEY).agg(F.max("load").alias("__since"))
        own = self.read(table, n).join(persons, KEY, "left_semi").join(since, KEY, "left")
        return own.where(F.col("load") >= F.coalesce("__since", F.lit(0))).drop("load", "__since")

    def persons(self) -> DataFrame:
        """Every person's last row."""
        rows = self.read("persons", self.last_load())
        last = rows.groupBy(KEY).agg(F.max("load").alias("load"))
        return rows.join(last, [KEY, "load"]).drop("load")

    def mart(self, as_of_date: str | _dt.date, churn_days: int = 180) -> DataFrame:
        """The mart as :func:`souk.operators.mart.customer_360` gives it for all loads."""
        return mart.with_scores(stored_table(mart.features(self.persons(), as_of_date, churn_days), "core"))
