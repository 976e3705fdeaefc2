"""Command line: import, export, search, concordance, info."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="bitextra")
    p.add_argument("-d", "--database", default="memory.store", help="folder of the memory")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("import", "export"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--format")
        s.add_argument("--source-lang", default="en")
        s.add_argument("--target-lang", default="ja")
        if name == "import":
            s.add_argument("--source-col", type=int, help="column of the source, from 1 (spreadsheets)")
            s.add_argument("--target-col", type=int, help="column of the target, from 1 (spreadsheets)")
            s.add_argument("--header-row", type=int, help="row of the header (spreadsheets)")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-m", "--min-score", type=float, default=0.5)
    s.add_argument("-n", "--max-results", type=int, default=10)
    s.add_argument("--type", default="fuzzy", choices=["fuzzy", "exact", "reverse", "glossary", "concordance"])
    s = sub.add_parser("concordance")
    s.add_argument("query")
    s.add_argument("--field", default="source", choices=["source", "target", "context"])
    sub.add_parser("info")
    a = p.parse_args(args)

    from pyspark.sql import SparkSession

    from bitextra.api import Engine
    from bitextra.operators.lookup import phrase_concordance

    engine = Engine(SparkSession.builder.appName("bitextra").getOrCreate(), a.database)
    try:
        if a.command == "import":
            place = {"sourceCol": a.source_col, "targetCol": a.target_col, "headerRow": a.header_row}
            options = {k: str(v) for k, v in place.items() if v is not None}
            print(f"{engine.import_file(a.path, a.format, sourceLang=a.source_lang, targetLang=a.target_lang, **options)} records imported")
        elif a.command == "export":
            print(f"{engine.export_file(a.path, a.format, sourceLang=a.source_lang, targetLang=a.target_lang)} records exported")
        elif a.command == "info":
            row = engine.statistics().first()
            print(f"{row['name']}: {row['records']} records, {row['source_lang']} to {row['target_lang']}")
        else:
            if a.command == "concordance":
                found = phrase_concordance(engine.store.memory, a.query, a.field).toLocalIterator()
            else:
                found = engine.search(a.query, a.type, a.min_score).limit(a.max_results).collect()
            for r in found:
                row = r.asDict()
                print(f"{int(row.get('score', 1.0) * 100)}%  {row.get('source') or row.get('term')}  ->  {row.get('target') or row.get('translation')}")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
