"""K4: the analysis as transactions arrive, with Structured Streaming.

Request bodies (JSON, one per line) land in a folder; each micro-batch is
validated, analysed with fixed models and written out. The query is
stateless (append mode, no watermark, no state store): every transaction is
independent.

A micro-batch is read, parsed and analysed in one pass that writes accepted
and rejected rows side by side, into a folder of that attempt alone. Then one
small file, the batch's manifest, names the folder and its counts; it appears
by a rename. Readers (``read_sink``) open only what manifests name. A crash
before the rename shows neither side of the batch, and the repeated batch
writes a folder of its own; a batch that has its manifest is not done again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.analyze import Models, analyze
from ..schema import FEATURES, RAW_REQUEST, REQUEST, RESPONSE
from ..sources.readers import csv_columns, has_files, parse_json_requests
from ..sources.validate import validate


#: Files in one micro-batch unless the caller says otherwise: a backlog becomes many bounded batches.
MAX_FILES_PER_TRIGGER = 1000


def read_requests(spark: SparkSession, source_dir: str, source_format: str = "text", max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """The request stream with every field as text (``text``: one JSON body per
    line, with key presence; ``json``/``csv``: the request fields as text;
    ``parquet``: the typed request schema)."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if source_format == "text":
        return parse_json_requests(reader.format("text").load(source_dir), "value")
    if source_format == "json":
        return reader.schema(RAW_REQUEST).json(source_dir)
    if source_format == "csv":
        # by name: the header of the files that are there, every field as text; a folder
        # that is still empty takes files whose header is the request's fields in order
        names = csv_columns(spark, source_dir) if has_files(spark, source_dir) else RAW_REQUEST.names
        text = T.StructType([T.StructField(c, T.StringType()) for c in names])
        return reader.schema(text).option("header", True).option("enforceSchema", False).csv(source_dir)
    if source_format == "parquet":
        return reader.schema(REQUEST).parquet(source_dir)
    raise ValueError("source_format must be 'text', 'json', 'csv' or 'parquet'")


#: Columns of the written rows: an accepted row has the response's, a rejected one the request's and the reason.
SINK = T.StructType([*REQUEST.fields, T.StructField("reject_reason", T.StringType()), *[f for f in RESPONSE.fields if f.name not in REQUEST.names]])
MANIFEST = "batch long, folder string, accepted long, rejected long"


def batch_rows(validated: DataFrame, models: Models) -> DataFrame:
    """Accepted and rejected rows of a validated table in one narrow pass: ``SINK`` and ``outcome``.

    Rejected rows go through the models with zeros, so that one pass serves
    both; none of what comes out for them is kept.
    """
    ok = F.col("reject_reason").isNull()
    request = F.struct(*[F.col(f.name) for f in REQUEST.fields]).alias("_request")
    safe = validated.select("*", request).withColumns({f: F.when(ok, F.col(f)).otherwise(F.lit(0).cast(REQUEST[f].dataType)) for f in FEATURES})
    rows = analyze(safe, models, keep=("_request", "reject_reason"))
    out = [F.col(f"_request.{f.name}").alias(f.name) for f in REQUEST.fields]
    out += ["reject_reason", *[F.when(ok, F.col(f.name)).alias(f.name) for f in RESPONSE.fields if f.name not in REQUEST.names]]
    return rows.select(*out, F.when(ok, "accepted").otherwise("rejected").alias("outcome"))


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def commit_manifest(spark: SparkSession, sink_dir: str, entry: dict) -> None:
    """The manifest of a batch, whole or not at all: written beside its place, then renamed."""
    folder = f"{sink_dir}/manifest"
    hidden, fs = _file_system(spark, f"{folder}/.{entry['batch']}-{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(bytearray((json.dumps(entry) + "\n").encode()))
    out.close()
    target, _ = _file_system(spark, f"{folder}/{entry['batch']}.json")
    if not fs.rename(hidden, target):
        raise RuntimeError(f"the manifest of batch {entry['batch']} could not be put in place")


def is_committed(spark: SparkSession, sink_dir: str, batch_id: int) -> bool:
    path, fs = _file_system(spark, f"{sink_dir}/manifest/{batch_id}.json")
    return fs.exists(path)


def write_batch(rows: DataFrame, batch_id: int, sink_dir: str) -> None:
    """One pass over the rows of a batch (``batch_rows``), then the manifest; a committed batch is left as it is."""
    spark = rows.sparkSession
    if is_committed(spark, sink_dir, batch_id):
        return
    folder = f"data/batch={batch_id}/attempt=a{uuid.uuid4().hex}"
    seen = Observation()
    counts = [F.coalesce(F.sum((F.col("outcome") == o).cast("long")), F.lit(0)).alias(o) for o in ("accepted", "rejected")]
    rows.observe(seen, *counts).write.partitionBy("outcome").parquet(f"{sink_dir}/{folder}")
    commit_manifest(spark, sink_dir, {"batch": batch_id, "folder": folder, **{k: int(v) for k, v in seen.get.items()}})


def analyze_stream(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    models: Models,
    strict_domain: bool = False,
    available_now: bool = True,
    max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER,
    source_format: str = "text",
    processing_time: str = "10 seconds",
) -> StreamingQuery:
    """Start the stream into ``sink_dir`` (Parquet and manifests; ``read_sink`` reads it).

    ``available_now`` processes what is there and stops (backfills, tests);
    otherwise a micro-batch runs every ``processing_time``.
    """
    validated = validate(read_requests(spark, source_dir, source_format, max_files_per_trigger), strict_domain=strict_domain)

    writer = validated.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch_rows(batch, models), batch_id, sink_dir)).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def read_sink(spark: SparkSession, sink_dir: str, part: str = "accepted") -> DataFrame:
    """The accepted or rejected rows of all committed batches, with their batch number; none before the first.

    Manifests are one small row a batch; folders that none of them names
    (of attempts that failed) are not read.
    """
    names = RESPONSE.names if part == "accepted" else [*REQUEST.names, "reject_reason"]
    schema = T.StructType([*SINK.fields, T.StructField("batch", T.IntegerType()), T.StructField("attempt", T.StringType()), T.StructField("outcome", T.StringType())])
    path, fs = _file_system(spark, f"{sink_dir}/manifest")
    committed = spark.read.schema(MANIFEST).json(f"{sink_dir}/manifest").filter(F.col(part) > 0).select("folder").collect() if fs.exists(path) else []
    if not committed:
        return spark.createDataFrame([], schema).select(*names, "batch")
    paths = [f"{sink_dir}/{r.folder}/outcome={part}" for r in committed]
    return spark.read.schema(schema).option("basePath", f"{sink_dir}/data").parquet(*paths).select(*names, "batch")
