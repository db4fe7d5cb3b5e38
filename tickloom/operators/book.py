"""Order-book features on level arrays of (price, quantity), best level first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.scalar import flag


def book_features(bids: str = "bids", asks: str = "asks", depth: int = 5, pip: float = 0.0001) -> dict[str, Column]:
    def total(side):
        return F.aggregate(F.slice(side, 1, depth), F.lit(0.0), lambda a, x: a + x.quantity)

    def wall(side):
        top = F.slice(side, 1, depth)
        mean = total(side) / F.size(top)
        return flag(F.exists(top, lambda x: x.quantity > 3 * mean))

    bd, ad = total(bids), total(asks)
    bid, ask = F.col(bids)[0], F.col(asks)[0]
    return {
        "ob_bid_depth": bd, "ob_ask_depth": ad, "ob_imbalance": (bd - ad) / (bd + ad + 1e-9),
        "ob_spread_pip": (ask["price"] - bid["price"]) / pip,
        "ob_bid_wall": wall(bids), "ob_ask_wall": wall(asks),
        "microprice": (bid["price"] * ask["quantity"] + ask["price"] * bid["quantity"])
                      / (bid["quantity"] + ask["quantity"] + 1e-9),
    }
