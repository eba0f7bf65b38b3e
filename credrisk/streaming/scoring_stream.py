"""Streaming scoring (W2): client files arriving in a folder are scored with
the same feature, model and tier code as the batch path.

``readStream`` (declared schema) → rows delivered before are dropped → ingest → features →
score → tier → file sink, run with ``availableNow`` so that every file present is
processed exactly once and the query stops; the sink and its checkpoint live in
the shared folder named by ``spark.checkpoint.dir``.

Files are delivered again under other names after upstream retries.  Spark's file source only
knows names, so the rows are remembered: state holds a digest of each row for ``remember`` after
its arrival (``dropDuplicatesWithinWatermark`` on the arrival time, which no row can be late
for), and it survives restarts in the checkpoint.  A changed record of a client is another row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import with_features
from ..operators.ingest import ingest
from ..operators.scoring import factor_analysis, with_tier
from ..schema import CLIENT_RAW
from ..session import ensure_checkpoint_dir


def scoring_frame(raw: DataFrame, score: Callable[[DataFrame], DataFrame], factors: bool = False) -> DataFrame:
    """Raw client rows (batch or stream) → (ID, score, pct, tier, verdict), and with ``factors``
    one row for each of the five explanation factors of a client."""
    scored = with_tier(score(with_features(ingest(raw), "train")))
    if not factors:
        return scored.select("ID", "score", "pct", "tier", "verdict")
    packed = scored.withColumn("ID", F.struct("ID", "score", "pct", "tier", "verdict"))
    return factor_analysis(packed, key="ID").select("ID.*", "factor_ord", "factor", "risk_value", "bar_pct", "level", "display")


def first_deliveries(raw: DataFrame, remember: str) -> DataFrame:
    """A stream without the rows that it delivered already, all columns equal, in the time ``remember``."""
    columns = [F.col(f"`{c}`") for c in raw.columns]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    marked = raw.withColumn("_arrived", F.current_timestamp()).withColumn("_digest", digest)
    return marked.withWatermark("_arrived", remember).dropDuplicatesWithinWatermark(["_digest"]).select(*columns)


def run_file_stream(spark: SparkSession, source_dir: str, score: Callable[[DataFrame], DataFrame],
                    sink_dir: str | None = None, max_files_per_trigger: int | None = None,
                    factors: bool = False, checkpoint_dir: str | None = None, remember: str = "7 days") -> DataFrame:
    """Score every client file in ``source_dir`` as a stream; return the sink
    contents as a batch DataFrame.  With the same ``sink_dir`` and ``checkpoint_dir`` a later
    run goes on where this one ended."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex[:12]
    sink_dir = sink_dir or f"{base}/stream-scores-{run}"
    reader = spark.readStream.schema(CLIENT_RAW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = scoring_frame(first_deliveries(reader.parquet(source_dir), remember), score, factors)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir or f"{base}/stream-ckpt-{run}")
         .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
    return spark.read.parquet(sink_dir)
