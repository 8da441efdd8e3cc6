"""Write PLANS.md: physical-plan shape of every registered query at a given scale.

Usage: python tools/plans.py [sf_dir]
Counts exchanges (shuffles), join strategies, windows and generators in the
planned (pre-AQE) physical plan, and prints the formatted plan of a few
headline queries, so scans can be checked for PushedFilters / ReadSchema.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.plans.all import QUERIES  # noqa: E402
from panelspark.session import build_session  # noqa: E402

SKIP = {"gbt_regress", "rf_regress", "rf_classify", "model_metrics", "attribution_topn"}
FULL = ["pivot_mean", "panel_dims", "impute_two_level", "psi_columns", "rate_5m"]


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    lines = [
        "# PLANS",
        "",
        f"Planned physical plans (before adaptive re-planning) at `{sf_dir}`, from `tools/plans.py`.",
        "Exchange = shuffle; BHJ = broadcast hash join (static, only for fixed-size or proven-small sides);",
        "SMJ = sort-merge join (adaptive execution may still switch it to a broadcast join at run time",
        "when the materialised side is small). Stream queries and model training are not listed.",
        "",
        "| query | exchanges | BHJ | SMJ | windows | generators | scans with pushed filters |",
        "|---|---|---|---|---|---|---|",
    ]
    full = {}
    for name in sorted(QUERIES):
        if name in SKIP or name.startswith("stream_"):
            continue
        try:
            text = formatted(QUERIES[name](spark, sf_dir))
        except Exception as exc:  # noqa: BLE001
            lines.append(f"| {name} | error: {type(exc).__name__} | | | | | |")
            continue
        head = text.split("\n\n")[0]
        cnt = lambda pat: len(re.findall(pat, head))
        pushed = len(re.findall(r"PushedFilters: \[[^\]]+\]", text))
        lines.append(
            f"| {name} | {cnt(r'Exchange')} | {cnt(r'BroadcastHashJoin')} | {cnt(r'SortMergeJoin')} | "
            f"{cnt(r'Window')} | {cnt(r'Generate')} | {pushed} |"
        )
        if name in FULL:
            full[name] = text
    for name in FULL:
        if name in full:
            lines += ["", f"## {name}", "", "```", full[name].strip(), "```"]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
