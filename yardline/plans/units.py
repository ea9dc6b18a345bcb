"""Units with their bucket codes and card rate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.functions import buckets

RATE_KEY = ["type_bucket", "usage_category", "length_bucket"]

_BUCKETS = {
    "type_bucket": lambda as_of: buckets.type_bucket(F.col("Type")),
    "usage_category": lambda as_of: buckets.usage_category(F.col("Year"), as_of),
    "length_bucket": lambda as_of: buckets.length_bucket(F.col("Length")),
    "year_range": lambda as_of: buckets.year_range(F.col("Year"), as_of),
}


def with_buckets(trailers: DataFrame, *names: str, as_of: dt.datetime) -> DataFrame:
    """Units with the named bucket columns."""
    return trailers.withColumns({name: _BUCKETS[name](as_of) for name in names})


def enriched_trailers(trailers: DataFrame, *, as_of: dt.datetime) -> DataFrame:
    """The unit master with type, usage, length and model-year buckets."""
    return with_buckets(trailers, *_BUCKETS, as_of=as_of)


def rated_trailers(
    trailers: DataFrame, card_rates: DataFrame, *, as_of: dt.datetime, year_range: bool = True
) -> DataFrame:
    """Bucketed units with ``CardRateMonth``, null where no benchmark exists.

    No join hint: the price list is normally far below Spark's broadcast limit,
    and Catalyst checks its size; beyond the limit the join shuffles.
    """
    names = [*RATE_KEY, "year_range"] if year_range else RATE_KEY
    return with_buckets(trailers, *names, as_of=as_of).join(card_rates, RATE_KEY, "left")
