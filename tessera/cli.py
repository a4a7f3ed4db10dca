"""Command line: run a registered query, build a panel, validate it, search, inspect a catalog.

    python -m tessera.cli list
    python -m tessera.cli run NAME --data DIR [--out DIR]
    python -m tessera.cli build-dataset --data DIR --out DIR
    python -m tessera.cli validate --data DIR
    python -m tessera.cli search TEXT --data DIR [--lang en] [--top 12]
    python -m tessera.cli corpus-status --data DIR
    python -m tessera.cli features
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.text import query_terms
from .operators import panel, retrieval, validation
from .plans import catalog
from .session import get_session
from .sources import sinks
from .sources.panel import weekly_panel
from .sources.tables import table


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    sub.add_parser("features")
    for name in ("run", "build-dataset", "validate", "search", "corpus-status"):
        s = sub.add_parser(name)
        s.add_argument("--data", required=True)
        if name == "run":
            s.add_argument("name")
            s.add_argument("--out")
        if name == "build-dataset":
            s.add_argument("--out", required=True)
        if name == "search":
            s.add_argument("text")
            s.add_argument("--lang")
            s.add_argument("--top", type=int, default=12)
    a = p.parse_args(argv)
    if a.cmd in ("list", "features"):
        print("\n".join(sorted(catalog.QUERIES if a.cmd == "list" else panel.REGISTRY)))
        return 0
    spark = get_session("tessera-cli")
    if a.cmd == "run":
        out = catalog.QUERIES[a.name](spark, a.data)
        out.write.mode("overwrite").parquet(a.out) if a.out else out.show(20, False)
    elif a.cmd == "build-dataset":
        grid = weekly_panel(spark, a.data)
        features = panel.normalise(panel.compute(grid, panel.V1), panel.V1)
        labels = panel.relative_labels(grid).select("date", "ticker", "fwd_rel_return")
        sinks.write_panel(features, labels, panel.coverage_report(grid), a.out)
    elif a.cmd == "validate":
        summary = catalog.QUERIES["gate_criteria"](spark, a.data).first().asDict()
        print(catalog.QUERIES["ic_summary"](spark, a.data).first().asDict(), summary)
        return 0 if all(summary.values()) else 1
    elif a.cmd == "search":
        asked = spark.createDataFrame([(0, a.text)], "query_id int, q string").select("query_id", query_terms(F.col("q")).alias("terms"))
        docs = retrieval.candidates(table(spark, a.data, "documents"), equals={"lang": [a.lang]} if a.lang else None)
        retrieval.top(retrieval.bm25(docs, asked), a.top).orderBy("rank").show(a.top, False)
    elif a.cmd == "corpus-status":
        catalog.QUERIES["manifest"](spark, a.data).show(truncate=False)
    return 0


__all__ = ["main", "validation"]

if __name__ == "__main__":
    sys.exit(main())
