"""Write the executed physical plans of the headline queries to docs/PLANS.md.

usage: python scripts/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from corridor.params import Params  # noqa: E402
from corridor.plans import multi, single  # noqa: E402
from corridor.plans.catalog import fixture_catalog, fixture_flows  # noqa: E402
from corridor.session import local_session  # noqa: E402

YEARS = (1995, 2001)
GROUPS = ("BLOC_A", "BLOC_B", "AFRICA")


def plan_text(df) -> str:
    df.collect()  # run this DataFrame's own execution so AQE shows its final plan (results are small)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summary(text: str) -> str:
    final = text.split("\n\n")[0].split("+- == Initial Plan ==")[0]
    ids = re.findall(r"Scan parquet\s+\((\d+)\)", final)
    blocks = [re.search(rf"\n\({i}\) Scan parquet.*?\n\n", text, re.S).group(0) for i in ids]
    scans = [m.group(1) for b in blocks
             for m in [re.search(r"Location: InMemoryFileIndex[^\n]*?/([a-z_]+)(?:\.parquet)?\]", b)] if m]
    pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\n]*\])", text)))
    return "\n".join([
        f"- file scans in final plan: {len(ids)} ({', '.join(sorted(scans))})",
        f"- shuffles (Exchange): {len(re.findall(r'(?<!Broadcast)Exchange [(]', final))}, "
        f"broadcasts: {final.count('BroadcastExchange (') + final.count('ReusedExchange')}",
        f"- sort-merge joins: {final.count('SortMergeJoin')}, broadcast hash joins: {final.count('BroadcastHashJoin')}",
        "- pushed filters: " + "; ".join(p[:160] for p in pushed),
    ])


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    cat = fixture_catalog(spark, sf_dir)
    cases = {
        "Q1 top partners (EUROPE, usd current, exports)": single.top_partners(
            cat, Params("EUROPE", YEARS, unit="usd", flow="exports")),
        "Q2 top categories (BLOC_A, cad constant, imports)": single.top_categories(
            cat, Params("BLOC_A", YEARS, unit="cad", prices="constant", flow="imports")),
        "Q3 world trade (EUROPE, share of GDP)": single.world_trade(cat, Params("EUROPE", YEARS, unit="gdp")),
        "Q4 partner series (NATION_8 vs BLOC_A, BLOC_B, AFRICA, eur constant)": multi.partner_series(
            cat, Params("NATION_8", YEARS, unit="eur", prices="constant", partners=GROUPS)),
        "Q5 partner matrix (NATION_8 vs BLOC_A, BLOC_B, AFRICA, share of GDP)": multi.partner_matrix(
            cat, Params("NATION_8", YEARS, unit="gdp", partners=GROUPS)),
        "T1 flow ETL from the order lines": fixture_flows(spark, sf_dir),
    }
    out = [f"# Physical plans at {sf_dir}\n",
           "Generated by `python scripts/plans.py`; final adaptive plans after one run.\n"]
    for title, df in cases.items():
        text = plan_text(df)
        tree = text.split("\n\n")[0].split("+- == Initial Plan ==")[0].strip()
        out += [f"## {title}\n", summary(text), "", "```", tree, "```", ""]
    with open(__file__.rsplit("/scripts/", 1)[0] + "/docs/PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
