"""Command line: `python -m textindex.cli lz77 INPUT FOLDER` writes factor files, `... profile INPUT` compares two suffix arrays.

INPUT is a file, folder or glob that Spark reads; FOLDER is one that driver and executors share.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import local, suffix
from .plans.metrics import Stages
from .sources.corpus import from_files
from .sources.sinks import write_factor_files


def lz77(spark: SparkSession, source: str, folder: str) -> int:
    """Write a factor file for each input file; returns the phrases of all."""
    coded = local.lz_encoded(from_files(spark, source))
    written = write_factor_files(coded, folder)
    return int((written.agg(F.sum("n_bytes")).first()[0] or 0) // 16)


def profile(spark: SparkSession, source: str) -> tuple[bool, Stages]:
    """Whether the distributed and the in-task suffix arrays of all files are equal, and the time of each step."""
    from .plans.store import shared_table

    clock = Stages()
    corpus = from_files(spark, source).select("doc_id", "bytes")
    with clock.stage("in tasks"):
        a = shared_table(local.sa_isa(corpus), "profile")
    with clock.stage("distributed"):
        b = shared_table(suffix.fast(corpus), "profile")
    with clock.stage("compare"):
        same = suffix.compare(a, b).where("not match").isEmpty()
    return same, clock


def main(args: list[str]) -> int:
    if not (len(args) == 3 and args[0] == "lz77" or len(args) == 2 and args[0] == "profile"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("textindex").getOrCreate()
    if args[0] == "lz77":
        print(f"{lz77(spark, *args[1:])} phrases")
        return 0
    same, clock = profile(spark, args[1])
    clock.table(spark).show(truncate=False)
    clock.executors(spark).show(truncate=False)
    print("equal" if same else "NOT EQUAL")
    return 0 if same else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
