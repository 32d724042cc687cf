"""The streams that settings name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwin.plans.config import JoinConfig
from braidwin.sources import generators, tables


def streams(spark: SparkSession, config: JoinConfig) -> tuple[DataFrame, DataFrame | None]:
    """R and S: from their files; else unique and foreign keys for ``fk_join`` (with a skew: Zipf foreign keys); else uniform or Zipf keys."""
    if config.r_path:
        r = tables.read_keys(spark, config.r_path, config.r_rate, config.r_seed)
    elif config.fk_join:
        r = generators.unique_keys(spark, config.r_size, config.r_rate, config.r_seed)
    elif config.skew > 0:
        r = generators.zipf_keys(spark, config.r_size, config.r_size, config.skew, config.r_rate, config.r_seed)
    else:
        r = generators.uniform_keys(spark, config.r_size, config.r_size, config.r_rate, config.r_seed)
    if config.self_join:
        return r, None
    if config.s_path:
        s = tables.read_keys(spark, config.s_path, config.s_rate, config.s_seed)
    elif config.skew > 0:
        s = generators.zipf_keys(spark, config.s_size, config.r_size, config.skew, config.s_rate, config.s_seed)
    elif config.fk_join:
        s = generators.foreign_keys(spark, config.s_size, config.r_size, config.s_rate, config.s_seed)
    else:
        s = generators.uniform_keys(spark, config.s_size, config.r_size, config.s_rate, config.s_seed)
    return r, s
