"""Code tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the published code lists: code, description, is_sold, is_auction.
SALE_METHODS = [
    ("S", "Property sold", True, True),
    ("SP", "Property sold prior", True, False),
    ("PI", "Property passed in", False, True),
    ("PN", "Sold prior not disclosed", True, False),
    ("SN", "Sold not disclosed", True, True),
    ("NB", "No bid", False, True),
    ("VB", "Vendor bid", False, True),
    ("W", "Withdrawn prior to auction", False, False),
    ("SA", "Sold after auction", True, True),
    ("SS", "Sold after auction price not disclosed", True, True),
]
# Code, description.
PROPERTY_TYPES = [
    ("h", "House / cottage / villa / semi / terrace"),
    ("u", "Unit / duplex"),
    ("t", "Townhouse"),
    ("br", "Bedroom(s)"),
    ("dev site", "Development site"),
    ("o res", "Other residential"),
]


def sale_methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SALE_METHODS, "method_code string, method_description string, is_sold boolean, is_auction boolean")


def property_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROPERTY_TYPES, "type_code string, type_description string")
