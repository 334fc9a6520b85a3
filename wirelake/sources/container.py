"""Containers: one message with a name, the name of a message type, and a list of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import string_field
from ..operators.codec import decode
from ..schema import FieldDef, FileDef, MessageDef, Pool, build

CONTAINER = build(FileDef("wirelake/container.proto", "wirelake", [MessageDef("Container", [FieldDef("name", 1, "string"), FieldDef("message_name", 2, "string"), FieldDef("payload", 3, "bytes", repeated=True)])]))


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """(name, message_name, index, payload) of all containers among the files at a path, one container a file."""
    files = spark.read.format("binaryFile").load(path).select("content")
    opened = files.select(decode("content", Pool(CONTAINER), "wirelake.Container").alias("c"))
    return opened.select("c.name", "c.message_name", F.posexplode("c.payload").alias("index", "payload"))


def containers(df: DataFrame, name: str, message_name: str, payload: str = "payload") -> DataFrame:
    """A container of one payload per row, as (payload); containers one after another are one container, as merging has it."""
    return df.select(F.concat(string_field(1, F.lit(name)), string_field(2, F.lit(message_name)), string_field(3, F.col(payload))).alias("payload"))


def write_containers(df: DataFrame, path: str, name: str, message_name: str, payload: str = "payload") -> None:
    """Such containers in files of length-delimited messages."""
    containers(df, name, message_name, payload).write.format("delimited").mode("append").save(path)
