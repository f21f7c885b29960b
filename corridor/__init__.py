"""Bilateral flow analytics on Spark.

    from corridor import Params, load_catalog, top_partners
    cat = load_catalog(spark, "/shared/serving")
    top_partners(cat, Params("Kenya", (2010, 2020), unit="usd", prices="constant")).show()
"""

from .params import Params
from .plans.catalog import Catalog, fixture_catalog
from .plans.concurrent import fetch_all
from .plans.jobs import build_serving_tables, load_catalog
from .plans.multi import multi_report, partner_matrix, partner_series
from .plans.single import single_report, top_categories, top_partners, unpersist_report, world_trade

__all__ = [
    "Params", "Catalog", "fixture_catalog", "build_serving_tables", "load_catalog", "fetch_all",
    "top_partners", "top_categories", "world_trade", "single_report", "unpersist_report",
    "partner_series", "partner_matrix", "multi_report",
]
