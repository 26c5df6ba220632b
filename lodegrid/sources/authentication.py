"""Access to protected stores: credentials go into Spark's Hadoop configuration, never into plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

_HOSTS: dict[str, tuple[str, str]] = {}


def set_credentials(hostname: str, username: str, password: str) -> None:
    """Remember a login for this process."""
    _HOSTS[hostname] = (username, password)


def credentials(hostname: str) -> tuple[str, str] | None:
    return _HOSTS.get(hostname)


def set_s3(spark: SparkSession, key: str | None = None, secret: str | None = None, region: str | None = None, requester_pays: bool = False, anonymous: bool = False) -> None:
    """Access to s3a:// paths for this session."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, v in (("access.key", key), ("secret.key", secret), ("endpoint.region", region)):
        if v:
            conf.set(f"fs.s3a.{name}", v)
    if requester_pays:
        conf.set("fs.s3a.requester.pays.enabled", "true")
    if anonymous:
        conf.set("fs.s3a.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")
