"""Command line: verify a folder of opinions against a base."""

from __future__ import annotations

import argparse
import sys
import time

from .operators import index, submission
from .operators.guard import failures
from .plans.verify import load_base, verify
from .session import build_session
from .sources.opinions import read_opinions
from .sources.tables import read_csv


def main(argv: list[str] | None = None) -> int:
    """0 if all went well; 1 if the input can't be read, a document failed or the table has problems (it is kept); 2 for wrong use."""
    p = argparse.ArgumentParser(prog="citaforge", description=__doc__)
    p.add_argument("opinions", help="folder of .txt files")
    p.add_argument("--database", help="SQLite base; goes before --tables")
    p.add_argument("--tables", help="base as saved tables")
    p.add_argument("--csv", help="table to write, one row per opinion")
    p.add_argument("--output", help="folder for one JSON per opinion")
    p.add_argument("--source", default="base", help="what the JSON names as the source of ids")
    p.add_argument("--expected", help="CSV with the documento_id that the table must have")
    p.add_argument("--save-tables", help="write the base's tables to this folder")
    args = p.parse_args(argv)
    if not (args.csv or args.output or args.save_tables) or not (args.database or args.tables):
        p.print_usage(sys.stderr)
        return 2
    began = time.time()
    spark = build_session("citaforge")
    try:
        base = load_base(spark, args.database, args.tables)
        opinions = read_opinions(spark, args.opinions)
        if args.save_tables:
            index.save(base, args.save_tables)
        for r in submission.repeated_ids(opinions).collect():
            print(f"warning: {r['n']} files have the id {r['documento_id']}; the last one counts", file=sys.stderr)
        opinions = submission.last_by_path(opinions).persist()
        failed = failures(spark)
        found = verify(opinions, base, failed).persist()
        if args.output:
            submission.write_json(submission.contract_json(opinions, found, args.source), args.output)
        problems = []
        if args.csv:
            submission.write_csv(submission.cells(opinions, found), args.csv)
            expected = read_csv(spark, args.expected, ["documento_id"]) if args.expected else opinions
            problems = submission.submission_problems(read_csv(spark, args.csv, list(submission.HEADER)), expected).orderBy("documento_id", "posicao").collect()
        counts = {r["classificacao"]: r["n"] for r in submission.summary(found).orderBy("classificacao").collect()}
        print(f"{opinions.count()} opinions, {sum(counts.values())} citations {counts}, {time.time() - began:.1f} s")
    except Exception as error:  # noqa: BLE001  a readable message instead of a trace
        print(f"error: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    for document, cause in sorted(failed.value.items()):
        print(f"problem: {document} failed and was left empty: {cause}", file=sys.stderr)
    for r in problems:
        print(f"problem: {r['documento_id']} {r['posicao']} {r['problema']}", file=sys.stderr)
    return int(bool(problems or failed.value))


if __name__ == "__main__":
    sys.exit(main())
