"""``python -m lumberline [--port N] [--secret TEXT] [--settings FOLDER] [LOG ...]``: the tools on standard input and output, or
over HTTP on a port of this machine."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .session import Session, Store
from .transport import http_server, serve


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumberline", description=__doc__)
    parser.add_argument("--port", type=int, help="serve HTTP on this port instead of standard input and output")
    parser.add_argument("--secret", help="the first part of all HTTP paths")
    parser.add_argument("--settings", help="folder of saved filters, date formats and settings")
    parser.add_argument("logs", nargs="*", help="logs to open first")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session = Session(spark, store=Store(given.settings) if given.settings else None)
    for path in given.logs:
        session.load_log(path)
    if given.port is None:
        serve(session, sys.stdin, sys.stdout)
    else:
        http_server(session, given.port, secret=given.secret).serve_forever()


if __name__ == "__main__":
    main()
