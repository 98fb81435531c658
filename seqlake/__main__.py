"""python -m seqlake put|get|del|scan|compact DB [KEY [VALUE]]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .db import Database, Options
from .errors import EngineError, NotFound, describe


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seqlake", description="An ordered, versioned key-value engine on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, given, says in (("put", ["key", "value"], "store a value"), ("get", ["key"], "print a value"), ("del", ["key"], "delete a key"), ("scan", [], "print all pairs in order"), ("compact", [], "compact everything")):
        sub = commands.add_parser(name, help=says)
        for x in ["db", *given]:
            sub.add_argument(x)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        with Database.open(spark, a.db, Options(create_if_missing=True)) as db:
            if a.command == "put":
                db.put(a.key.encode(), a.value.encode())
            elif a.command == "get":
                print(db.get(a.key.encode()).decode())
            elif a.command == "del":
                db.delete(a.key.encode())
            elif a.command == "scan":
                for row in db.scan().toLocalIterator():
                    print(f"{bytes(row['k']).decode()} => {bytes(row['v']).decode()}")
            else:
                db.compact_range()
                print("compaction complete", file=sys.stderr)
    except NotFound:
        print("not found", file=sys.stderr)
    except EngineError as e:
        print(describe(e), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
