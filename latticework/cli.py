"""Command line: read a Matrix Market file, scale it, write the result. ``spark-submit -m latticework.cli -i in.mtx -o out.mtx -m bilinear -r 100 -c 100``."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession

from .errors import MatrixError
from .operators import analysis
from .operators.resample import METHODS, scale
from .sources.mtx import read_mtx, write_mtx

log = logging.getLogger("latticework")
#: Execution policies that are accepted and left to Spark's planner.
POLICIES = ("auto", "seq", "par", "par-unseq", "cuda", "mpi")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latticework", description=__doc__)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("-m", "--method", choices=sorted(METHODS), default="bilinear")
    p.add_argument("-r", "--rows", type=int, required=True)
    p.add_argument("-c", "--cols", type=int)
    p.add_argument("-p", "--policy", default="auto", help="advisory; Spark plans the execution")
    p.add_argument("--collision", choices=("sum", "avg", "max", "min", "last"), default="sum")
    p.add_argument("-t", "--threads", type=int, help="local threads, where no master is set")
    p.add_argument("-d", "--device", help="accepted, without effect")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-s", "--stats", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-b", "--benchmark", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.ERROR if args.quiet else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    if args.policy not in POLICIES:
        log.warning("unknown policy %s: auto", args.policy)
    builder = SparkSession.builder.appName("latticework")
    spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
    try:
        m = read_mtx(spark, args.input)
        options = {"policy": args.collision} if args.method in ("nearest", "wavelet") else {}
        began = time.time()
        out = scale(m, args.method, args.rows, args.cols or args.rows, **options)
        if args.stats:
            print(analysis.describe(m))
            print(analysis.describe(out))
        if args.benchmark:
            n = out.nnz()
            print(f"{n} entries in {time.time() - began:.3f} s")
        if args.output:
            write_mtx(out, args.output)
    except MatrixError as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
