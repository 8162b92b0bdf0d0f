"""Column sets of the tables that travel between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

# Total order of the rows of a stay. Source order is never relied on.
STAY_ORDER = ("time", "itemid", "value")

MEASURES = T.StructType(
    [
        T.StructField("itemid", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("ind", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.DoubleType()),
    ]
)

KEY = T.StructType([T.StructField("label", T.StringType()), T.StructField("key", T.LongType())])
