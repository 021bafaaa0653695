"""The set of cleaned tables that the analysis jobs read."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from martlet.config import Definitions

Source = DataFrame | Callable[[], DataFrame]

# The cleaned tables; the name used in files and views differs for item lines.
FIELDS = ["orders", "items", "customers", "products", "sellers", "payments", "reviews", "geolocation"]
TABLE_NAMES = {"items": "order_items"}


class Market:
    """Cleaned tables plus the definitions they are analysed under.

    A table may be given as a frame or as a function that builds it; functions run once, on first
    use, so a job only plans the tables it touches.
    """

    orders: DataFrame
    items: DataFrame
    customers: DataFrame
    products: DataFrame
    sellers: DataFrame
    payments: DataFrame
    reviews: DataFrame
    geolocation: DataFrame

    def __init__(self, sources: Mapping[str, Source], defs: Definitions = Definitions()):
        unknown = set(sources) - set(FIELDS)
        if unknown:
            raise ValueError(f"unknown tables: {', '.join(sorted(unknown))}")
        self._sources = dict(sources)
        self.defs = defs

    def __getattr__(self, name: str) -> DataFrame:
        sources = self.__dict__.get("_sources", {})
        if name not in sources:
            raise AttributeError(name)
        source = sources[name]
        frame = source if isinstance(source, DataFrame) else source()
        self.__dict__[name] = frame
        return frame

    def tables(self) -> dict[str, DataFrame]:
        return {TABLE_NAMES.get(f, f): getattr(self, f) for f in FIELDS if f in self._sources}
