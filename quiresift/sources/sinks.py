"""Lists for people: CSV with a byte order mark, action logs, settings."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresift.functions.text import basename, human_size

#: Columns of the list of duplicates. Fixed values.
LIST_HEADER = ["组号", "建议保留", "单行本名称", "载体", "格式", "文件大小(字节)", "文件大小", "图片总页数", "抽样页数", "组内相似度", "成链页数", "命中率", "关系", "完整路径"]
LOG_HEADER = ["时间", "操作", "对象", "结果", "说明"]
KEEP_MARK, FOLDER, ARCHIVE = "★保留", "文件夹", "压缩包"
MARK = "﻿"


def duplicate_list(rows: DataFrame) -> DataFrame:
    """LIST_HEADER from (gid, kept, path, kind, fmt, size, pages, sampled, score, matched, ratio, relation, place)."""
    columns = [
        F.col("gid"),
        F.when(F.col("kept"), KEEP_MARK).otherwise(""),
        basename(F.col("path")),
        F.when(F.col("kind") == "folder", FOLDER).otherwise(ARCHIVE),
        F.col("fmt"),
        F.col("size"),
        human_size(F.col("size")),
        F.col("pages"),
        F.col("sampled"),
        F.format_number("score", 3),
        F.col("matched"),
        F.format_number("ratio", 2),
        F.col("relation"),
        F.col("path"),
    ]
    return rows.orderBy("gid", "place").select(*[c.alias(n) for c, n in zip(columns, LIST_HEADER, strict=True)])


def write_csv(df: DataFrame, folder: str) -> None:
    """``df`` as CSV files with header and byte order mark, rows in order over the files."""
    first = df.columns[0]
    df.withColumnRenamed(first, MARK + first).write.option("header", "true").option("encoding", "UTF-8").csv(folder)


def append_log(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Adds (time, action, subject, result, note) to a log folder."""
    rows.toDF(*LOG_HEADER).write.mode("append").option("header", "true").csv(folder)


def save_settings(spark: SparkSession, settings: Mapping[str, object], folder: str) -> None:
    spark.createDataFrame([(json.dumps(settings, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def load_settings(spark: SparkSession, folder: str) -> dict[str, object]:
    return json.loads("\n".join(r.value for r in spark.read.text(folder).collect()))
