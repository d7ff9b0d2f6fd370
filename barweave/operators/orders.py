"""Position sizes and order intents. Nothing is sent anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Magic numbers of buy and sell orders, and the allowed price deviation.
MAGIC_BUY = 1000
MAGIC_SELL = 1001
DEVIATION = 10


def order_intents(orders: DataFrame, quotes: DataFrame, symbol_info: DataFrame) -> DataFrame:
    """orders(order_id, symbol, side, value) sized by the ask: volume = round(value / ask, 2).

    `rejected` marks volumes below the symbol's minimum, and orders that cannot be sized; `reason`
    says why (no quote, no symbol info, below minimum). Every order stays. Quotes and symbol info have one row
    per symbol; Spark broadcasts them when their measured size allows.
    """
    buy = F.col("side") == "buy"
    volume = F.round(F.try_divide(F.col("value"), F.col("ask")), 2)
    reason = (
        F.when(volume.isNull(), "no quote")
        .when(F.col("volume_min").isNull(), "no symbol info")
        .when(volume < F.col("volume_min"), "below minimum")
    )
    return (
        orders.join(quotes, "symbol", "left")
        .join(symbol_info, "symbol", "left")
        .select(
            "order_id",
            "symbol",
            "side",
            F.when(buy, F.col("ask")).otherwise(F.col("bid")).alias("price"),
            volume.alias("volume"),
            F.when(buy, MAGIC_BUY).otherwise(MAGIC_SELL).alias("magic"),
            F.lit(DEVIATION).alias("deviation"),
            reason.isNotNull().alias("rejected"),
            reason.alias("reason"),
        )
    )
