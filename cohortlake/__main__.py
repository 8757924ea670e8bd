"""python -m cohortlake --config FILE [--cells PATH] [--bind HOST:PORT]: checks a document, and serves a store."""

from __future__ import annotations

import argparse
import os
import sys

from cohortlake.plans.config import ConfigError, IndexConfig


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortlake")
    parser.add_argument("-c", "--config", default=os.environ.get("COHORTLAKE_CONFIG"))
    parser.add_argument("--cells", help="root of a store to serve")
    parser.add_argument("--bind")
    args = parser.parse_args(argv)
    if not args.config:
        parser.error("--config is needed")
    try:
        cfg = IndexConfig.load(args.config)
    except ConfigError as e:
        print("\n".join(e.errors), file=sys.stderr)
        return 2
    print(f"{cfg.metadata.name}: {len(cfg.fields)} fields, {len(cfg.dimensions)} dimensions, {len(cfg.metrics)} metrics")
    if args.cells:
        from pyspark.sql import SparkSession

        from cohortlake.sources.api import serve
        from cohortlake.sources.store import Store

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        serve(Store(spark, cfg, args.cells).engine(), args.bind).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
