"""python -m keelson -e ENV: runs the queries of an environment file."""

from __future__ import annotations

import argparse
import csv
import logging
import resource
import time

from pyspark.sql import SparkSession

from .session import Session
from .sources.csv import write_csv


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="keelson", description=__doc__)
    p.add_argument("-e", "--env", required=True, help="environment file")
    p.add_argument("-m", "--max", type=int, default=10, help="last instant")
    p.add_argument("-l", "--logfile", help="log file")
    p.add_argument("-D", "--debug", action="store_true", help="log plans")
    p.add_argument("-o", "--outcomparisons", help="folder for statistics of sequence preferences")
    p.add_argument("-d", "--details", help="file for seconds and memory by query")
    p.add_argument("-r", "--delimiter", default=",", help="field delimiter")
    for short, name in (("-p", "--pref"), ("-t", "--tpref"), ("-s", "--subseq")):
        p.add_argument(short, name, help="accepted for compatibility: one plan serves all algorithms")
    a = p.parse_args(argv)
    logging.basicConfig(filename=a.logfile, level=logging.DEBUG if a.debug else logging.INFO)
    spark = SparkSession.builder.appName("keelson").getOrCreate()
    session = Session(spark, a.max, a.delimiter)
    session.load(a.env)
    rows = []
    for name, (path, changed) in session.outputs.items():
        began = time.perf_counter()
        result = session.changes(name) if changed else session.results[name]
        if a.debug:
            logging.debug("%s\n%s", name, result._jdf.queryExecution().toString())
        write_csv(result, path, a.delimiter)
        rows.append((name, round(time.perf_counter() - began, 3), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024))
    if a.details:
        with open(a.details, "w", newline="") as f:
            csv.writer(f).writerows([("query", "seconds", "rss_mb"), *rows])
    if a.outcomparisons:
        for name, text in session.texts.items():
            try:
                write_csv(session.statistics(text), f"{a.outcomparisons}/{name}", a.delimiter)
            except ValueError as e:
                logging.info("%s: %s", name, e)


if __name__ == "__main__":
    main()
