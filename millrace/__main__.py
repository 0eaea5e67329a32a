"""Command line: load files as tables, run SQL and print the result; without --sql, a prompt.

    python -m millrace --load-csv t=path --load-parquet u=path --sql "SELECT ..." [--format table|csv|json]
    python -m millrace --config millrace.toml
"""

from __future__ import annotations

import argparse
import sys

from .config import Config
from .errors import ConfigError, EngineError
from .plans.statements import run
from .session import get_session
from .sources.tables import TPCDS_TABLES, load_directory, register_csv, register_parquet


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("--config", metavar="PATH", help="a TOML file; what is given here goes before it")
    parser.add_argument("--master", help="Spark master; the cluster's own setting otherwise")
    parser.add_argument("--load-csv", action="append", default=[], metavar="NAME=PATH")
    parser.add_argument("--load-parquet", action="append", default=[], metavar="NAME=PATH")
    parser.add_argument("--load-directory", metavar="PATH", help="a folder with NAME.csv or NAME.dat for the names given by --tables")
    parser.add_argument("--tables", default="", help="comma-separated names; the TPC-DS tables otherwise")
    parser.add_argument("--delimiter", default=",")
    parser.add_argument("--sql", help="statements parted by semicolons; the last one's result is printed")
    parser.add_argument("--format", choices=("table", "csv", "json"))
    a = parser.parse_args(args)
    try:
        config = Config.load(a.config) if a.config else Config()
    except ConfigError as e:
        parser.error(str(e))
    spark = get_session(config.app, a.master or config.master, **config.spark_settings())
    for load, given in (
        (lambda n, p: register_csv(spark, n, p, delimiter=a.delimiter), config.csv | dict(x.split("=", 1) for x in a.load_csv)),
        (lambda n, p: register_parquet(spark, n, p), config.parquet | dict(x.split("=", 1) for x in a.load_parquet)),
    ):
        for name, path in given.items():
            load(name, path)
    if a.load_directory:
        load_directory(spark, a.load_directory, [n for n in a.tables.split(",") if n] or TPCDS_TABLES, a.delimiter)
    style = a.format or config.format
    if a.sql is None:
        return prompt(spark, style)
    show(run(spark, a.sql), style)
    return 0


def show(result, style: str) -> None:
    if style == "table":
        result.show(truncate=False)
    elif style == "json":
        for line in result.toJSON().toLocalIterator():
            print(line)
    else:
        import csv

        out = csv.writer(sys.stdout)
        out.writerow(result.columns)
        for row in result.toLocalIterator():
            out.writerow(row)


def prompt(spark, style: str, lines=None) -> int:
    """Reads statements that end with a semicolon until ``exit`` or the end of input; an error ends no session."""
    held = ""
    for line in lines if lines is not None else iter(lambda: _ask("millrace> " if not held else "      -> "), None):
        if not held and line.strip().rstrip(";").lower() in ("exit", "quit", r"\q"):
            break
        held += line + "\n"
        if not line.rstrip().endswith(";"):
            continue
        text, held = held, ""
        try:
            result = run(spark, text)
            if result.columns:
                show(result, style)
            else:
                print("done")
        except EngineError as e:
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
        except Exception as e:  # noqa: BLE001 - a plan that fails while it runs is reported like the rest
            print(f"ExecutionError: {e}", file=sys.stderr)
    return 0


def _ask(text: str) -> str | None:
    try:
        return input(text)
    except EOFError:
        return None


if __name__ == "__main__":
    sys.exit(main())
