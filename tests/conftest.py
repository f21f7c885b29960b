from __future__ import annotations

import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# tests get their own shared folder unless the cluster names one
os.environ.setdefault("CORRIDOR_LOCAL_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="corridor-test-ckpt-"))

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from corridor.session import local_session

    s = local_session(shuffle_partitions=8, app="corridor-tests")
    yield s


def D(x) -> Decimal:
    return Decimal(str(x))


# Golden micro-fixture rows (shared with the brute-force checks).
MICRO_FLOWS = [
    (2002, "A", "B", "X", D("10.00")), (2002, "A", "B", "Y", D("5.00")), (2002, "A", "C", "X", D("20.00")),
    (2002, "B", "A", "X", D("3.00")), (2002, "B", "C", "Z", D("7.00")), (2002, "C", "A", "Y", D("4.00")),
    (2002, "C", "B", "X", D("0.00")),
    (2003, "A", "B", "X", D("12.00")), (2003, "A", "C", "Y", D("6.00")), (2003, "C", "A", "X", D("8.00")),
    (2003, "C", "B", "Z", D("1.00")),
]
MICRO_MEMBERSHIP = [("A", "A"), ("B", "B"), ("C", "C"), ("G1", "A"), ("G1", "B"), ("G2", "B"), ("G2", "C")]
MICRO_CURRENT = [(2002, D("1.0000"), D("1.2000"), D("0.5000"), D("0.6000")),
                 (2003, D("1.0000"), D("1.3000"), D("0.8000"), D("0.7000"))]
MICRO_CONSTANT = [(2002, "A", D("2.0000"), D("2.0000"), D("2.0000"), D("2.0000")),
                  (2003, "A", D("2.0000"), D("2.0000"), D("2.0000"), D("2.0000")),
                  (2002, "B", D("1.5000"), D("1.5000"), D("1.5000"), D("1.5000")),
                  (2002, "C", None, D("1.0000"), D("1.0000"), D("1.0000")),
                  (2003, "C", D("1.0000"), D("1.0000"), D("1.0000"), D("1.0000"))]
MICRO_GDP = [(2002, "A", 100.0), (2003, "A", 200.0), (2002, "B", None), (2003, "B", 50.0),
             (2002, "C", 0.0), (2003, "C", 400.0)]


@pytest.fixture(scope="session")
def micro(spark):
    """Golden micro-fixture: A, B, C; G1 = {A, B}, G2 = {B, C}; 2002-2003; X, Y, Z.

    Edge cells: C->B X 2002 rounds to 0.00; B exports nothing in 2003 but
    imports; B has no constant factor row in 2003; C's 2002 constant factor is
    null; B's 2002 GDP is null and C's is zero.
    """
    from corridor.plans.catalog import Catalog

    flows = spark.createDataFrame(
        MICRO_FLOWS, "year int, exporter string, importer string, category string, value decimal(18,2)")
    membership = spark.createDataFrame(MICRO_MEMBERSHIP, "group_name string, country string")
    current = spark.createDataFrame(
        MICRO_CURRENT,
        "year int, usd_current decimal(10,4), cad_current decimal(10,4), eur_current decimal(10,4), "
        "gbp_current decimal(10,4)",
    )
    constant = spark.createDataFrame(
        MICRO_CONSTANT,
        "year int, country string, usd_constant decimal(10,4), cad_constant decimal(10,4), "
        "eur_constant decimal(10,4), gbp_constant decimal(10,4)",
    )
    gdp = spark.createDataFrame(MICRO_GDP, "year int, country string, gdp_constant double")
    return Catalog.from_tables(spark, flows, membership, current, constant, gdp, ["X", "Y", "Z"])


@pytest.fixture(scope="session")
def sf001(spark):
    from corridor.plans.catalog import fixture_catalog

    return fixture_catalog(spark, SF001)
