"""``python -m braidwin --alg FK-MERG-L3 --dataset synth-1``: makes the streams, joins them, prints the figures as JSON."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from braidwin.plans import metrics, registry
from braidwin.plans.config import JoinConfig
from braidwin.plans.sources import streams


def main(argv: list[str]) -> None:
    config = JoinConfig.from_args(argv)
    registry.resolve(config)
    spark = SparkSession.builder.appName("braidwin").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    r, s = streams(spark, config)
    row = metrics.measured(r, s, config).first().asDict()
    print(",".join(map(str, row.values())) if config.csv else json.dumps(row))


if __name__ == "__main__":
    main(sys.argv[1:])
