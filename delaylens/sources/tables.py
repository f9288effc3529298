"""Container for the seven logical input tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    sellers: DataFrame
    customers: DataFrame
    order_reviews: DataFrame
    geolocation: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register_views(self, prefix: str = "") -> None:
        """Expose every table to ``spark.sql`` under its logical name."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)
