"""Key texts that a database takes as equal although their bytes differ.

Databases often ignore case and trailing spaces in comparisons. Instead of
comparing so in every query, the tables are brought to one spelling once: a
join under Spark's collations finds the spelling that stands for a text, and
all later joins, filters and groups are plain.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.sources.inputs import Inputs

# Names of Spark's collations.
BINARY = "UTF8_BINARY"
IGNORE_SPACES = "UTF8_BINARY_RTRIM"
IGNORE_CASE = "UTF8_LCASE"
IGNORE_CASE_AND_SPACES = "UTF8_LCASE_RTRIM"

_KEY, _SPELLED = "_key", "_spelled"


def spellings(frame: DataFrame, column: str, collation: str) -> DataFrame:
    """``_key, _spelled``: each text of a column under a collation, and its spelling of least code points."""
    plain = frame.select(F.col(column).alias(_SPELLED)).where(F.col(_SPELLED).isNotNull()).distinct()
    least = plain.groupBy(F.collate(F.col(_SPELLED), collation).alias(_KEY)).agg(F.min(_SPELLED).alias(_SPELLED))
    return least


def respelled(frame: DataFrame, column: str, known: DataFrame, collation: str) -> DataFrame:
    """``frame`` with the texts of ``column`` spelled as in ``known``; texts it does not hold lose their trailing spaces at most."""
    own = F.collate(F.col(column), collation)
    rest = F.rtrim(F.col(column)) if collation.endswith("_RTRIM") else F.col(column)
    joined = frame.join(known, own == F.col(_KEY), "left").withColumn(column, F.coalesce(F.col(_SPELLED), rest))
    return joined.select(*frame.columns)


def collate_keys(inputs: Inputs, collation: str = IGNORE_CASE_AND_SPACES) -> Inputs:
    """All tables with units spelled as in the unit master, and branches in one spelling each."""
    units = spellings(inputs.trailers, "Unit", collation)
    branches = spellings(inputs.trailers, "Fleetcity", collation)
    trailers = respelled(respelled(inputs.trailers, "Unit", units, collation), "Fleetcity", branches, collation)
    others = {"leases": "Unit", "invoice_lines": "UnitNumber", "asset_statuses": "AssetName"}
    found = {name: respelled(getattr(inputs, name), key, units, collation) for name, key in others.items()}
    return dataclasses.replace(inputs, trailers=trailers, **found)
