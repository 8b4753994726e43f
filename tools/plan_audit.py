"""Plan audit: per query, exchanges, single-partition exchanges, broadcasts, scans.

usage: python tools/plan_audit.py [--star] [sf_dir] [name ...]

With ``--star`` the marketplace star schema is materialised first, as bench.py does.

Runs each query once into the noop sink so the adaptive plan is final, then
reads the formatted physical plan.
"""

from __future__ import annotations

import io
import os
import re
import sys
import tempfile
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from souk.plans import registry  # noqa: E402
from souk.session import get_spark  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    star = "--star" in args
    args = [a for a in args if a != "--star"]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    scratch = tempfile.mkdtemp(prefix="souk-audit-")
    spark = get_spark(checkpoint_dir=scratch)
    stored = f"{scratch}/star" if star else None
    if stored:
        from souk.sources import fixtures

        fixtures.materialize_star(spark, sf_dir, stored)
    print("| query | exchanges | single-partition | broadcasts | windows | scans | widest scan (cols) |")
    print("|---|---|---|---|---|---|---|")
    qs = registry.queries(stored)
    for name in names or list(qs):
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        shuffles = len(re.findall(r"^\(\d+\) Exchange", plan, re.M))
        single = len(re.findall(r"SinglePartition", plan))
        bcast = len(re.findall(r"^\(\d+\) BroadcastExchange", plan, re.M))
        windows = len(re.findall(r"^\(\d+\) Window", plan, re.M))
        scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        widest = max((s.count(":") for s in scans), default=0)
        print(f"| {name} | {shuffles} | {single} | {bcast} | {windows} | {len(scans)} | {widest} |", flush=True)


if __name__ == "__main__":
    main()
