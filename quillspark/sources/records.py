"""Record sources and sinks: JSON lines, transcripts of three shapes, text formats, headers.

Bad lines are skipped or refused as the caller says; nothing is inferred from a sample.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line, record VARIANT) of the lines that are JSON objects; ``line`` counts from 0 and
    counts skipped lines too. Blank, malformed and non-object lines are left out."""
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    t = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    v = t.select("file", F.col("line").cast("long").alias("line"), F.try_parse_json("text").alias("record"))
    return v.filter(F.col("record").isNotNull() & F.schema_of_variant("record").startswith("OBJECT"))


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a fixed schema; any bad line is an error when the rows are read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(record VARIANT) from a JSON array, an object with ``episodes``, an object, or JSON lines."""
    whole = spark.read.text(path, wholetext=True).select("value", F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    some = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(F.try_variant_get("v", "$.episodes", "array<variant>").isNotNull(), F.try_variant_get("v", "$.episodes", "array<variant>")).when(F.col("v").isNotNull(), F.array("v"))
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())
    return whole.select(F.explode(F.coalesce(some, lines)).alias("record"))


def _s(path: str, record: str = "record"):
    return F.try_variant_get(record, path, "string")


def claude_events(lines: DataFrame) -> DataFrame:
    """Events of transcripts whose lines hold a message with content blocks."""
    text = _s("$.message.content")
    blocks = F.coalesce(F.try_variant_get("record", "$.message.content", "array<variant>"), F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), text.alias("text")))))
    e = lines.filter(_s("$.type").isin("user", "assistant")).select("file", "line", _s("$.message.role").alias("role"), _s("$.timestamp").alias("timestamp"), F.coalesce(F.try_variant_get("record", "$.isSidechain", "boolean"), F.lit(False)).alias("sidechain"),
                                                                    _s("$.uuid").alias("uuid"), _s("$.parentUuid").alias("parent"), F.posexplode(blocks).alias("block", "b"))
    kind = _s("$.type", "b")
    return e.select("file", "line", "block", "timestamp", "sidechain", "uuid", "parent",
                    F.when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result").when(kind == "thinking", "reasoning").otherwise(F.col("role")).alias("type"),
                    F.coalesce(_s("$.text", "b"), _s("$.thinking", "b"), _s("$.content", "b")).alias("text"), F.coalesce(_s("$.id", "b"), _s("$.tool_use_id", "b")).alias("call_id"), _s("$.name", "b").alias("tool"),
                    F.when(kind == "tool_result", F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False))).alias("is_error"))


def codex_events(lines: DataFrame) -> DataFrame:
    """Events of rollouts whose lines hold a typed payload."""
    kind = _s("$.payload.type")
    typ = F.when(kind.isin("function_call", "custom_tool_call"), "tool_call").when(kind.isin("function_call_output", "custom_tool_call_output"), "tool_result").when(kind == "reasoning", "reasoning").when(kind == "message", _s("$.payload.role"))
    out = _s("$.payload.output")
    head = F.lower(F.substring(F.trim(out), 1, 200))
    e = lines.select("file", "line", F.lit(0).alias("block"), _s("$.timestamp").alias("timestamp"), F.lit(False).alias("sidechain"), F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("string").alias("parent"), typ.alias("type"),
                     F.coalesce(out, _s("$.payload.content")).alias("text"), _s("$.payload.call_id").alias("call_id"), _s("$.payload.name").alias("tool"), F.when(out.isNotNull(), head.startswith("error") | head.startswith('{"error')).alias("is_error"))
    return e.filter("type is not null")


def pi_events(lines: DataFrame) -> DataFrame:
    """Events of session files whose message lines hold a role and blocks."""
    blocks = F.coalesce(F.try_variant_get("record", "$.message.content", "array<variant>"), F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), _s("$.message.content").alias("text")))))
    e = lines.filter(_s("$.type") == "message").select("file", "line", _s("$.timestamp").alias("timestamp"), _s("$.message.role").alias("role"), _s("$.message.toolCallId").alias("result_id"), _s("$.message.toolName").alias("result_tool"),
                                                        F.try_variant_get("record", "$.message.isError", "boolean").alias("err"), _s("$.id").alias("uuid"), _s("$.parentId").alias("parent"), F.posexplode(blocks).alias("block", "b"))
    kind = _s("$.type", "b")
    return e.select("file", "line", "block", "timestamp", F.lit(False).alias("sidechain"), "uuid", "parent", F.when(kind == "toolCall", "tool_call").when(F.col("role") == "toolResult", "tool_result").when(kind == "thinking", "reasoning").otherwise(F.col("role")).alias("type"),
                    F.coalesce(_s("$.text", "b"), _s("$.thinking", "b")).alias("text"), F.coalesce(F.when(kind == "toolCall", _s("$.id", "b")), "result_id").alias("call_id"), F.coalesce(F.when(kind == "toolCall", _s("$.name", "b")), "result_tool").alias("tool"), F.col("err").alias("is_error"))


#: Parsers by source; a caller may add its own.
PARSERS = {"claude": claude_events, "codex": codex_events, "pi": pi_events, "omp": pi_events}


def transcripts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Events of all sources, with ``source`` and ``seq`` in each file."""
    out = None
    for source, path in sorted(paths.items()):
        e = PARSERS[source](jsonl(spark, path, "*.jsonl")).withColumn("source", F.lit(source))
        out = e if out is None else out.unionByName(e)
    return out.withColumn("seq", (F.row_number().over(Window.partitionBy("file").orderBy("line", "block")) - 1).cast("long"))


def prometheus(text: DataFrame, prefix: str = "") -> DataFrame:
    """(metric, value) of the two-token lines of a ``value`` column."""
    p = text.select(F.split(F.trim("value"), r"\s+").alias("t")).filter(F.size("t") == 2)
    return p.select(F.col("t")[0].alias("metric"), F.col("t")[1].try_cast("double").alias("value")).filter(F.col("metric").startswith(prefix) & F.col("value").isNotNull())


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            if len(content) < 8:
                raise ValueError(f"{path}: no header")
            (n,) = struct.unpack("<Q", content[:8])
            if n > len(content) - 8:
                raise ValueError(f"{path}: the header is longer than the file")
            end = 0
            for name, x in sorted(json.loads(content[8 : 8 + n]).items(), key=lambda i: i[1].get("data_offsets", [0])[0]):
                if name == "__metadata__":
                    continue
                a, b = x["data_offsets"]
                if a != end or b < a:
                    raise ValueError(f"{path}: {name} leaves a gap or overlaps")
                end = b
                out.append((path, name, x["dtype"], [int(v) for v in x["shape"]], b - a))
            if end != len(content) - 8 - n:
                raise ValueError(f"{path}: offsets do not cover the data")
        yield pd.DataFrame(out, columns=["path", "name", "dtype", "shape", "bytes"])


def tensor_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape, bytes) of tensors in files with a length, a JSON header and data."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_headers, "path string, name string, dtype string, shape array<long>, bytes long")


def verified_write(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet and read it back; rows that differ either way are an error."""
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    if not df.exceptAll(back).isEmpty() or not back.exceptAll(df).isEmpty():
        raise ValueError(f"{path}: what was read back differs from what was written")
    return back
