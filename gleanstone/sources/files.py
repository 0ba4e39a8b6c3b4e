"""Readers and writers of the stores: JSON documents, CSV sheets, JSON lines, binary signals."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanstone.session import checkpoint_folder

POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
FRAMES = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("frames", T.ArrayType(T.StructType([T.StructField("timestamp", T.DoubleType()), T.StructField("face", T.ArrayType(POINT))]))),
])
EVIDENCE = "key STRING, total_events INT, evidence ARRAY<STRUCT<category:STRING,type:STRING,start:DOUBLE,end:DOUBLE,duration:DOUBLE,value:STRING>>, _corrupt STRING"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which all executors see."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, suffix: str = "") -> DataFrame:
    """One row for each JSON document of a folder, with its ``stem``; corrupt ones have nulls and ``_corrupt`` if the schema asks."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreMissingFiles", True).json(path)
    stem = F.regexp_extract(F.input_file_name(), rf"([^/]+?){suffix}\.json$", 1)
    return df.withColumn("stem", stem)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_sheet(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV sheet with a header; a byte order mark before it doesn't count."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str) -> DataFrame:
    """Label sheets of several splits in one table, columns that are missing filled with nulls."""
    out = None
    for name, path in paths.items():
        one = csv_sheet(spark, path, schema).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def wav_seconds(content: bytes | None) -> float | None:
    """Duration by the header of a PCM file; None where there is no such header."""
    if not content or len(content) < 44 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, rate, size = 12, None, None
    while at + 8 <= len(content):
        name, n = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            rate = struct.unpack("<I", content[at + 16 : at + 20])[0]
        elif name == b"data":
            size = n
            break
        at += 8 + n + n % 2
    return size / rate if rate and size is not None else None


def audio_durations(spark: SparkSession, path: str) -> DataFrame:
    """path, seconds of the audio files of a folder."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "seconds": [wav_seconds(c) for c in pdf["content"]]}, columns=["path", "seconds"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, "path string, seconds double")


def new_only(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet, so that a batch can be taken up again."""
    return df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write to ``path``, or to ``path``_new where something is there already; returns the place."""
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    place = path if not fs.exists(p) else path + "_new"
    df.write.mode("errorifexists" if place == path else "overwrite").format(fmt).save(place)
    return place


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def chat_lines(df: DataFrame, prompt: str, answer: str) -> DataFrame:
    """One JSON line of a chat for each row: user and assistant turns."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.withColumn("value", F.to_json(F.struct(F.array(turn("user", prompt), turn("assistant", answer)).alias("messages"))))
