"""The physical plans keep the properties the scale design relies on."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from corridor.params import Params
from corridor.plans import multi, single

YEARS = (1995, 2001)
GROUPS = ("BLOC_A", "BLOC_B", "AFRICA")

CASES = {
    "q1": (lambda c: single.top_partners(c, Params("EUROPE", YEARS, flow="exports")), 1),
    "q1_imports_group": (lambda c: single.top_partners(
        c, Params("NATION_3", YEARS, prices="constant", flow="imports", group="ASIA")), 1),
    "q2": (lambda c: single.top_categories(c, Params("BLOC_A", YEARS, unit="cad", prices="constant",
                                                     flow="imports")), 1),
    "q3": (lambda c: single.world_trade(c, Params("EUROPE", YEARS, unit="gdp")), 4),
    "q3_fixed": (lambda c: single.world_trade(c, Params("EUROPE", YEARS), fixed=True), 4),
    "q4": (lambda c: multi.partner_series(c, Params("NATION_8", YEARS, unit="eur", prices="constant",
                                                    partners=GROUPS)), 2),
    "q5": (lambda c: multi.partner_matrix(c, Params("NATION_8", YEARS, unit="gdp", partners=GROUPS)), 4),
}


def final_plan(df) -> str:
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text, text.split("\n\n")[0].split("+- == Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(CASES))
def test_plan_shape(sf001, name):
    build, max_shuffles = CASES[name]
    text, tree = final_plan(build(sf001))
    ids = re.findall(r"Scan parquet\s+\((\d+)\)", tree)
    details = {i: re.search(rf"\n\({i}\) Scan parquet.*?\n\n", text, re.S).group(0) for i in ids}
    flows_scans = [i for i, d in details.items() if re.search(r"InMemoryFileIndex[^\n]*/flows\]", d)]
    assert len(flows_scans) == 1, "the fact is scanned exactly once"
    pushed = " ".join(re.findall(r"PushedFilters: \[[^\n]*\]", text))
    assert re.search(r"(In|EqualTo)\((exporter|importer)", pushed), "reporter filter reaches the Parquet reader"
    assert re.search(r"PartitionFilters: \[[^\n]*year", text), "year range prunes partitions"
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortMergeJoin"):
        assert bad not in tree, bad
    shuffles = len(re.findall(r"(?<!Broadcast)Exchange [(]", tree))
    assert shuffles <= max_shuffles, f"{shuffles} shuffles"
    assert "BroadcastHashJoin" in tree


def test_side_explode_is_compiled(sf001):
    text, tree = final_plan(single.world_trade(sf001, Params("EUROPE", YEARS)))
    assert re.search(r"\* Generate", tree)
