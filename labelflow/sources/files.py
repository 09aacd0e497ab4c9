"""File listings and file hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content of larger files is read in pieces inside the task that hashes them.
WHOLE_FILE_BYTES = 16 << 20
PIECE_BYTES = 1 << 20


# Hadoop's names of stores that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a file that Spark listed, and the file's name in it."""
    scheme, colon, rest = uri.partition(":")
    if scheme == "file" or not colon:
        return fs.LocalFileSystem(), "/" + unquote(rest or scheme).lstrip("/")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def one_slash(path: Column) -> Column:
    """The same spelling of local paths in listings and in scan metadata."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def literal_path(uri: str) -> str:
    """A path Spark reads as that one file, whatever characters its name holds."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def file_name(path: Column) -> Column:
    encoded = F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file_no, file_path)`` in the order of ``paths``, files of a folder by name.

    Only names pass through the driver, as they do in any Spark file scan.
    """
    given = {_bare(path): i for i, path in reversed(list(enumerate(paths)))}

    def position(uri: str) -> tuple[int, str]:
        path = _bare(unquote(uri))
        while path and path not in given:
            path = path.rpartition("/")[0]
        return given.get(path, len(paths)), uri

    found = sorted(spark.read.text(paths).inputFiles(), key=position)
    files = spark.createDataFrame(list(enumerate(found)), "file_no long, file_path string")
    return files.withColumn("file_path", one_slash(F.col("file_path")))


def _bare(path: str) -> str:
    """The path without scheme, host and trailing slash."""
    scheme, colon, rest = path.partition(":")
    path = rest if colon and "/" not in scheme else path
    if path.startswith("//"):
        path = "/" + path[2:].partition("/")[2]
    return path.rstrip("/")


def file_hashes(spark: SparkSession, paths: list[str], whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """``(file_path, file_hash)``: SHA-256 of the bytes of each file."""
    uri = one_slash(F.col("_metadata.file_path")).alias("file_path")
    files = spark.read.format("binaryFile").load(paths)
    whole = files.filter(F.col("length") <= whole_bytes).select(uri, F.sha2("content", 256).alias("file_hash"))
    large = files.filter(F.col("length") > whole_bytes).select(uri)
    return whole.unionByName(large.mapInPandas(_hash_in_pieces, "file_path string, file_hash string"))


def _hash_in_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashes = []
        for uri in batch["file_path"]:
            system, name = file_system(uri)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
            hashes.append(digest.hexdigest())
        yield batch.assign(file_hash=hashes)
