"""Physical plans of the network report: what is read and shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from tallywire.checks.frames import synth_frames
from tallywire.plans.health import stream_windows
from tallywire.plans.network import media_packets
from tallywire.plans.packets import CHUNK, ORDER, STREAM_KEY, kind_tables, packets_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packets") / "p")
    table = packets_table(synth_frames(spark, SF))
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def formatted(df) -> list[str]:
    """The nodes of the plan with their details."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.split(r"\n\n+", text[text.index("\n(1)") :])


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_packets_are_shuffled_once(spark, stored, threshold):
    """From the packets table to stream metrics: one exchange of packets, with announcements broadcast or not, and no payload."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        nodes = formatted(stream_windows(media_packets(stored, kind_tables(stored)), STREAM_KEY, ORDER, chunk=CHUNK))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    exchanges = [n for n in nodes if re.match(r"\(\d+\) Exchange", n)]
    assert len([n for n in exchanges if "rtp_seq" in n or "_c_seq" in n]) == 1
    assert not any("payload#" in n for n in exchanges)
    scans = [n for n in nodes if "Scan parquet" in n and "rtp_seq" in n]
    assert len(scans) == 1 and "payload:" not in scans[0]


def test_decoding_methods_are_compiled(spark):
    """No method of the generated code is longer than the 8000 bytes up to which the JVM compiles one."""
    frame = F.to_binary(F.col("id").cast("string"), F.lit("utf-8"))
    frames = spark.range(3).select(F.lit("c").alias("capture_id"), F.col("id").alias("frame_no"), F.timestamp_micros("id").alias("ts"), F.length(frame).alias("wire_len"), frame.alias("frame"))
    df = packets_table(frames)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))
    assert sizes and max(map(int, sizes)) <= 8000
