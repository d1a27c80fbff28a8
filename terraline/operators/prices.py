"""From a typed request to its price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraline.functions.text import parse_requests
from terraline.operators import asof


def spot_prices(requests: DataFrame, bars: DataFrame, strict: bool = True, request_id: str = "request_id", raw: str = "raw") -> DataFrame:
    """(request_id, stamp, price, level, status) of typed requests. Strict: the close of the request's own minute, else
    "no bar"; otherwise the finest level with any bar answers, and a NaN close counts as found. Requests that can't be
    read are "invalid"."""
    asked = parse_requests(requests.select(request_id, raw), raw)
    known = asked.where("status = 'ok'").select(F.col(request_id).alias("request_id"), "ticker", F.col("ts_utc").alias("ts"))
    if strict:
        found = asof.exact_minute(known, bars.where("interval = '1m'"), "ticker", "request_id").select("request_id", "price", F.when(F.col("status") == "ok", "1m").alias("level"))
    else:
        found = asof.cascade(known, bars)
    out = asked.join(found.withColumnRenamed("request_id", "_id"), F.col(request_id) == F.col("_id"), "left")
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("level").isNull(), "no bar").otherwise("ok")
    return out.select(request_id, "stamp", "price", "level", status.alias("status"))
