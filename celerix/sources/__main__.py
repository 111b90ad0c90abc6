"""python -m celerix.sources IN OUT [--block-rows N]: make a store of a long table."""

import argparse

from pyspark.sql import SparkSession

from celerix.sources.store import convert

parser = argparse.ArgumentParser(prog="celerix.sources")
parser.add_argument("source")
parser.add_argument("target")
parser.add_argument("--block-rows", type=int, default=20_000)
args = parser.parse_args()
convert(SparkSession.builder.getOrCreate(), args.source, args.target, args.block_rows)
