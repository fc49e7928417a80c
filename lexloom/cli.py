"""Command line: ``python -m lexloom.cli --store FOLDER {ingest,ingest-inventory,check,status,eval} ...``"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from lexloom.operators import evaluate
from lexloom.session import build_session
from lexloom.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexloom", description="Ingest documents, retrieve passages, check texts.")
    p.add_argument("--store", default=os.environ.get("LEXLOOM_STORE", "./store"), help="folder of the store")
    p.add_argument("--master", default=None, help="Spark master, by default the session's own")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="one text or PDF file")
    one.add_argument("--path", required=True)
    many = sub.add_parser("ingest-inventory", help="the files of a YAML inventory")
    many.add_argument("--inventory", required=True)
    many.add_argument("--tier", choices=["P0", "P1", "P2"])
    many.add_argument("--force", action="store_true", help="take documents that have a date already")
    many.add_argument("--dry-run", action="store_true", help="list what would be taken")
    check = sub.add_parser("check", help="a consent text against the store")
    check.add_argument("--text", required=True, help="file of the text")
    check.add_argument("--answer", action="append", default=[], help="file of a model's raw answer; repeat for further attempts")
    sub.add_parser("status", help="whether there is anything to retrieve")
    probe = sub.add_parser("eval", help="ingest a file and show what probes retrieve")
    probe.add_argument("--path", required=True)
    probe.add_argument("--queries", help="file with a query a line")
    probe.add_argument("--text", help="file of a text to check as well")
    for q in (one, many, probe):
        q.add_argument("--reset", action="store_true", help="empty the store before")
    for q in (one, check, probe):
        q.add_argument("--category")
    for q in (check, probe):
        q.add_argument("--top-k", type=int, default=8)
    one.add_argument("--jurisdiction")
    check.add_argument("--jurisdiction", action="append", help="repeatable")
    return p


def _report(engine, path: str, answers: list[str], **how) -> dict:
    text = Path(path).read_text(encoding="utf-8", errors="replace")
    spark = engine.spark
    given = spark.createDataFrame([(0, i, Path(a).read_text(encoding="utf-8", errors="replace")) for i, a in enumerate(answers, 1)], "report_id bigint, attempt int, raw string")
    return engine.check(spark.createDataFrame([(0, text)], "report_id bigint, text string"), given, max_attempts=max(2, len(answers)), **how).drop("report_id").first().asDict(True)


def main(argv: list[str] | None = None, engine=None, out=None) -> int:
    """Run a command; its result goes to ``out`` as JSON. 1 if a document could not be taken."""
    from lexloom.engine import Engine

    args = parser().parse_args(argv)
    out = out or sys.stdout
    if engine is None:
        engine = Engine(build_session("lexloom", args.master), str(Path(args.store).absolute()) if "://" not in args.store else args.store)
    say = lambda x: print(files.json_text(x), file=out)
    if args.command in ("ingest", "eval"):
        try:
            n = engine.ingest(args.path, category=args.category, reset=args.reset, **({"jurisdiction": args.jurisdiction} if args.command == "ingest" else {}))
        except (FileNotFoundError, ValueError) as e:
            print(e, file=sys.stderr)
            return 1
        if args.command == "ingest":
            say({"path": args.path, "chunks": n})
            return 0
        queries = files.query_lines(engine.spark, args.queries)
        shown = evaluate.probe_rows(engine.retrieve(queries, top_k=args.top_k, category=args.category))
        rows = queries.join(shown, "query_id", "left").orderBy("query_id").toLocalIterator()
        found = {"path": args.path, "store": engine.at.path, "retrieval": [{"query": r["text"], "hit_count": r["hit_count"] or 0, "top_ids": r["top_ids"] or [], "snippets": r["snippets"] or []} for r in rows]}
        if args.text:
            found["report"] = _report(engine, args.text, [], top_k=args.top_k, category=args.category)
        say(found)
    elif args.command == "ingest-inventory":
        done = engine.ingest_inventory(args.inventory, tier=args.tier, force=args.force, reset=args.reset, dry_run=args.dry_run)
        say(done)
        return 1 if done["errors"] else 0
    elif args.command == "check":
        say(_report(engine, args.text, args.answer, top_k=args.top_k, category=args.category, jurisdictions=args.jurisdiction))
    else:
        say({"store": engine.at.path, "ready": engine.ready()})
    return 0


if __name__ == "__main__":
    sys.exit(main())
