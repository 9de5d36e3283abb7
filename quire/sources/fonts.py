"""An index of font faces, read from font files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The layout of font files, all numbers big-endian.
DIRECTORY = np.dtype([("tag", "S4"), ("sum", ">u4"), ("at", ">u4"), ("size", ">u4")])
NAMES = np.dtype([("platform", ">u2"), ("encoding", ">u2"), ("language", ">u2"), ("kind", ">u2"), ("size", ">u2"), ("at", ">u2")])
COLLECTION, FAMILY, WINDOWS, ENGLISH, STYLE_AT = b"ttcf", 1, 3, 0x409, 44


def _numbers(data: bytes, at: int, kind: str, count: int = 1) -> list[int]:
    return np.frombuffer(data, kind, count, at).tolist()


def face(data: bytes) -> tuple[str | None, bool, bool]:
    """(family, bold, italic) of a font file, the first face of a collection; no family if it can't be read.

    Style bits are used rather than style names, which may be in any language. Of the family's names the English one for
    Windows counts first, then any for Windows, then any, the first of equals.
    """
    bold = italic = False
    try:
        start = _numbers(data, 12, ">u4")[0] if data[:4] == COLLECTION else 0
        tables = np.frombuffer(data, DIRECTORY, _numbers(data, start + 4, ">u2")[0], start + 12)
        at = {row["tag"]: int(row["at"]) for row in tables}
        if b"head" in at and at[b"head"] + STYLE_AT + 2 <= len(data):
            style = _numbers(data, at[b"head"] + STYLE_AT, ">u2")[0]
            bold, italic = bool(style & 1), bool(style & 2)
        names = at[b"name"]
        count, strings = _numbers(data, names + 2, ">u2", 2)
        records = np.frombuffer(data, NAMES, min(count, (len(data) - names - 6) // NAMES.itemsize), names + 6)
    except (ValueError, KeyError):
        return None, bold, italic
    found: list[tuple[int, str]] = []
    for row in records[records["kind"] == FAMILY]:
        begin = names + strings + int(row["at"])
        windows = row["platform"] == WINDOWS
        text = data[begin : begin + int(row["size"])].decode("utf-16-be" if windows else "latin-1", "ignore").strip()
        if text:
            found.append((int(windows) + int(windows and row["language"] == ENGLISH), text))
    return max(found, key=lambda f: f[0], default=(0, None))[1], bold, italic


def font_index(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(family in lower case, bold, italic, path) of the folders' font files, one path for each.

    An earlier folder goes before a later one, in a folder TrueType before OpenType files, then the smaller path. Files
    that can't be read have no row. A file's bytes don't leave the task that reads it.
    """
    if not folders:
        return spark.createDataFrame([], "family string, bold boolean, italic boolean, path string")

    def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                family, bold, italic = face(content.as_py())
                if family:
                    yield pa.RecordBatch.from_pylist([{"family": family.lower(), "bold": bold, "italic": italic, "path": path.as_py()}])

    def files(place: int, folder: str, pattern: str, kind: int) -> DataFrame:
        read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        return read.select("path", "content").mapInArrow(faces, "family string, bold boolean, italic boolean, path string").withColumn("rank", F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind"), "path"))

    rows = None
    for place, folder in enumerate(folders):
        for kind, pattern in enumerate(("*.tt*", "*.otf")):
            part = files(place, folder, pattern, kind)
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("family", "bold", "italic").agg(F.min_by("path", "rank").alias("path"))
