"""Command line: ``python -m staylens --build | --query TEXT [--hyde] | --interactive | --serve PORT`` over a data folder."""

from __future__ import annotations

import argparse
import sys

from .plans.build import Stores, build
from .plans.engine import HybridSearch, formatted
from .serve import server
from .session import local_session
from .sources import tables as S


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("staylens")
    p.add_argument("--build", action="store_true", help="build the stores from the files in the data folder")
    p.add_argument("--query", help="answer one question")
    p.add_argument("--hyde", action="store_true", help="search with a hypothetical answer too")
    p.add_argument("--interactive", action="store_true", help="answer questions until q, quit or exit")
    p.add_argument("--serve", type=int, metavar="PORT", help="answer questions over HTTP on this machine")
    p.add_argument("--data-dir", default="data")
    o = p.parse_args(args)
    if not (o.build or o.query or o.interactive or o.serve):
        p.print_help()
        return 0
    spark, d = local_session(), o.data_dir
    if o.build:
        counts = build(spark, f"{d}/stores", S.read_comments_csv(spark, f"{d}/comments.csv"), S.read_reverse_csv(spark, f"{d}/reverse_queries.csv"), S.read_summaries_json(spark, f"{d}/summaries.json"), S.read_stop_words(spark, f"{d}/stop_words.txt"))
        print(counts)
        return 0
    engine = HybridSearch(spark, Stores(spark, f"{d}/stores"))
    if o.query:
        print(formatted(engine.query(o.query, o.hyde)))
        return 0
    if o.serve:
        server(engine, o.serve).serve_forever()
        return 0
    for line in sys.stdin:
        text = line.strip()
        if text.lower() in ("q", "quit", "exit"):
            break
        if text:
            print(formatted(engine.query(text, o.hyde)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
