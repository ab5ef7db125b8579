"""Summarise the physical plan of registered queries: scans, pushed filters, shuffles, broadcasts.

Usage: python tools/explain_plans.py [sf_dir] [query ...]   (default: the bench headline set)
Prints one block per query from ``explain("formatted")`` plus counts of plan operators.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from flowlens.plans import registry  # noqa: E402
from flowlens.session import get_session  # noqa: E402


def summarise(df) -> dict:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return {
        "read_schema": sorted(set(re.findall(r"ReadSchema: (.*)", text))),
        "pushed_filters": sorted(set(f for f in re.findall(r"PushedFilters: (\[.*\])", text) if f != "[]")),
        "shuffles": len(re.findall(r"\) Exchange", text)),
        "broadcasts": len(re.findall(r"\) BroadcastExchange", text)),
        "windows": len(re.findall(r"\) Window", text)),
        "python": len(re.findall(r"\) (MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython)", text)),
        "sort_merge_joins": len(re.findall(r"\) SortMergeJoin", text)),
        "broadcast_joins": len(re.findall(r"\) BroadcastHashJoin", text)),
    }


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or list(HEADLINE)
    spark = get_session()
    registry.load_all()
    for name in names:
        s = summarise(registry.QUERIES[name](spark, sf_dir))
        print(f"== {name}")
        for k, v in s.items():
            print(f"   {k}: {v}")


if __name__ == "__main__":
    main()
