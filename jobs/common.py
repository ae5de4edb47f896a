"""What the jobs share: a logger, the command line, settings that are put back."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def described(df: DataFrame, what: str, path: str) -> DataFrame:
    """Logs the rows of a stored table; Parquet counts them from its footers."""
    log.info("%s: %d rows, %s", what, df.count(), path)
    return df


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold inside and are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def command_line(name: str, paths: list[str], config: str, work: Callable[..., object]) -> None:
    """Parses a path for each of `paths` and a config file, and does the work in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", default=config)
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    with open(given.pop("config")) as f:
        chosen = json.load(f)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, **given, config=chosen)
    finally:
        spark.stop()
