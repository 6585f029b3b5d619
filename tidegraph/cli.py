"""analyze and slice a written edge stream: python -m tidegraph.cli analyze PATH [--fraction F] | slice PATH OUT --start D --end D"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.ordering import numbered
from tidegraph.operators import report, selection
from tidegraph.sources import tables


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--fraction", type=float, default=0.1)
    s = sub.add_parser("slice")
    s.add_argument("path")
    s.add_argument("out")
    s.add_argument("--start", required=True)
    s.add_argument("--end", required=True)
    given = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    edges = tables.open_stream(spark, given.path)
    if given.what == "analyze":
        exact = numbered(edges.withColumn("sat", F.round(F.col("btc") * 1e8).cast("long")), ["timestamp", "src_idx", "dst_idx", "usd", "btc"])
        print(report.format_report(report.stream_report(selection.prefix(exact, given.fraction)).first()))
    else:
        tables.write_stream(selection.date_range(edges, given.start, given.end), given.out)


if __name__ == "__main__":
    main()
