"""A Spark session with what this library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: The environment variables that users set, and what holds where they are unset.
FROM_ENVIRONMENT = {
    "spark.master": ("SPARK_MASTER", "local[*]"),
    "spark.driver.memory": ("SPARK_DRIVER_MEM", "4g"),
}
#: Times are compared with SQL in UTC; plans count on being adapted at run time.
OWN = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def session(name: str = "glyphmill", master: str | None = None, driver_memory: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; arguments go before the environment, ``conf`` before both."""
    told = {"spark.master": master, "spark.driver.memory": driver_memory}
    settings = {key: told[key] or os.environ.get(*source) for key, source in FROM_ENVIRONMENT.items()} | OWN | conf
    return SparkSession.builder.config(map=settings).appName(name).getOrCreate()
