"""The command line: verbs in groups, each a registered query over a folder of tables; its rows are shown or written.

    python -m siftwork.cli list
    python -m siftwork.cli data audit --data /tables --out /issues
    python -m siftwork.cli run classify_job --data /tables
    python -m siftwork.cli versions
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from siftwork import versions
from siftwork.plans import catalog
from siftwork.session import session

#: Groups of verbs and the query that each runs.
VERBS = {
    "data": {"generate": "template_rows", "label": "labelling_outcomes", "audit": "audit_issues", "clean": "audit_clean", "merge": "merge_sources", "downsample": "diversity_downsample", "split": "split_60_20_20", "build": "v11_build"},
    "eval": {"fields": "field_accuracy", "labels": "label_accuracy", "confusion": "confusion_parse_fail", "errors": "worst_errors"},
    "hybrid": {"score": "hybrid_summary", "regex-baseline": "classify_job", "errors": "hybrid_errors"},
    "results": {"show": "leaderboard_errors_last", "compare": "two_model_comparison", "winners": "category_winners", "trend": "run_delta_lag"},
    "export": {"tests": "test_case_yaml", "report": "report_lines"},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwork")
    groups = p.add_subparsers(dest="group", required=True)
    groups.add_parser("list", help="all queries")
    groups.add_parser("versions", help="versions of the rules and their settings")

    def told(q: argparse.ArgumentParser) -> None:
        q.add_argument("--data", required=True, help="folder of the tables")
        q.add_argument("--out", help="folder to write JSON lines to; it must not exist")
        q.add_argument("--rows", type=int, default=20, help="rows to show without --out")

    run = groups.add_parser("run", help="a query by name")
    run.add_argument("query")
    told(run)
    for name, verbs in VERBS.items():
        own = groups.add_parser(name).add_subparsers(dest="verb", required=True)
        for verb in verbs:
            told(own.add_parser(verb))
    return p


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    catalog.load()
    if a.group == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.group == "versions":
        for name in versions.VERSIONS:
            print(versions.resolved(name))
        return 0
    name = a.query if a.group == "run" else VERBS[a.group][a.verb]
    if name not in catalog.QUERIES:
        print(f"no query {name}")
        return 2
    from siftwork.sources import io

    out = catalog.QUERIES[name](session(), a.data)
    if a.out:
        io.distinct_paths(a.data, a.out)
        io.write_jsonl(out, a.out)
    else:
        out.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
