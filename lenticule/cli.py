"""Command line: scans in, looping animations out."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import SparkSession

from .plans.batch import BatchRequest, run_batch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lenticule", description=__doc__)
    p.add_argument("-i", "--input", required=True, help="an image or a folder of images")
    p.add_argument("-o", "--output", required=True, help="folder for results")
    p.add_argument("--debug", action="store_true", help="write overlays too")
    p.add_argument("--gif-delay", type=int, default=100, metavar="MS")
    p.add_argument("--no-dither", action="store_true")
    p.add_argument("--enable-mp4", action="store_true", help="write MP4 instead of GIF")
    p.add_argument("--enable-nvenc", action="store_true", help="not available: there is no GPU encoder")
    p.add_argument("--mp4-loops", type=int, default=4)
    p.add_argument("--mp4-crf", type=int, default=18)
    p.add_argument("--no-progress", action="store_true")
    p.add_argument("--log-file")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="count", default=0)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.enable_nvenc:
        print("there is no GPU encoder here", file=sys.stderr)
        return 2
    level = logging.ERROR if a.quiet else (logging.INFO, logging.DEBUG)[min(a.verbose, 1)]
    logging.basicConfig(level=level, filename=a.log_file)
    spark = SparkSession.builder.appName("lenticule").config("spark.ui.showConsoleProgress", str(not (a.no_progress or a.quiet)).lower()).getOrCreate()
    began = time.time()
    counts = run_batch(spark, a.input, a.output, BatchRequest(gif_delay=a.gif_delay, dither=not a.no_dither, mp4=a.enable_mp4, mp4_loops=a.mp4_loops, mp4_crf=a.mp4_crf, debug=a.debug))
    if not a.quiet:
        print(f"{counts['total']} images, {counts['succeeded']} done, {counts['failed']} failed, {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
