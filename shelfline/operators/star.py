"""The mart with store and product attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def star(mart: DataFrame, store: DataFrame, product: DataFrame) -> DataFrame:
    """Left joins, so no mart row is lost to an incomplete dimension.

    Unhinted: Spark broadcasts a dimension whose size is under its threshold and
    otherwise shuffles, where adaptive execution splits a hot product.
    """
    return mart.join(store, "store_key", "left").join(product, "prod_key", "left")
