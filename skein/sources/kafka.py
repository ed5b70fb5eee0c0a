"""Options for Spark's Kafka source and sink. The connector is a package that the cluster has to
bring; records then go through ``decode_records`` like any others."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How much and how long a poll takes at least, and the name of what is trusted.
POLL = {"kafka.fetch.min.bytes": "1000000", "kafka.fetch.max.wait.ms": "500", "maxOffsetsPerTrigger": "1000000"}


def security(user: str = "", password: str = "") -> dict[str, str]:
    """SASL over TLS where there is a user, nothing otherwise."""
    if not user.strip():
        return {}
    quoted = [x.replace("\\", "\\\\").replace('"', '\\"') for x in (user, password)]
    login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{quoted[0]}" password="{quoted[1]}";'
    return {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login}


def registry(url: str, user: str = "", password: str = "") -> dict[str, str]:
    """Where schemas are, with basic authentication where there is a user."""
    login = {"basic.auth.credentials.source": "USER_INFO", "basic.auth.user.info": f"{user}:{password}"} if user.strip() else {}
    return {"schema.registry.url": url, **login}


def stream_options(servers: str, topics: Sequence[str], since_ms: int | None, user: str = "", password: str = "") -> dict[str, str]:
    """All partitions of ``topics`` from a time on; partitions without a later record start at their end."""
    if not topics:
        raise ValueError("no topic")
    start = {} if since_ms is None else {"startingTimestamp": str(since_ms), "startingOffsetsByTimestampStrategy": "latest"}
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(sorted(set(topics))), "includeHeaders": "true", "failOnDataLoss": "false", **POLL, **start, **security(user, password)}


def point_options(servers: str, topic: str, partition: int, offset: int, **login: str) -> dict[str, str]:
    """Exactly one record, for a batch read."""
    at = lambda n: json.dumps({topic: {str(partition): n}})
    return {"kafka.bootstrap.servers": servers, "assign": json.dumps({topic: [partition]}), "startingOffsets": at(offset), "endingOffsets": at(offset + 1), "includeHeaders": "true", **security(**login)}


def start_of(now_ms: int, days: int) -> int:
    """``days`` (0 at least) before now, in whole seconds."""
    return (now_ms // 1000 - max(0, days) * 86_400) * 1000


def stream(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()


def publish(rows: DataFrame, servers: str, topic: str, **login: str) -> None:
    """Write (key, value) rows to a topic."""
    rows.select(F.col("key").cast("string"), F.col("value").cast("string")).write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, **security(**login)}).save()


def avro_text(value: Column, schema: str) -> Column:
    """A registry-framed Avro value as JSON text, null where it isn't one. Needs the spark-avro package."""
    from pyspark.sql.avro.functions import from_avro

    return F.to_json(from_avro(F.substring(value, 6, 1 << 30), schema, {"mode": "PERMISSIVE"}))


def topics(offsets: DataFrame) -> DataFrame:
    """(topic) in order."""
    return offsets.select("topic").distinct().orderBy("topic")
