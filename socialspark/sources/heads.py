"""What files say of themselves: the header of a delimited file, the footer of a Parquet file.

A Python data source deals the files of a folder out in groups and opens each one in a
task. Of a delimited file only the first record is parsed, of a Parquet file only the footer,
so the cost follows the number of files, not their size. Files are opened with
``pyarrow.fs``: local, HDFS, S3 and GCS addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_TASK = 64
HEAD_SCHEMA = "file_name string, path string, columns array<string>, types array<string>, error string, cause string"


def _source() -> type:
    """The data source; a local class travels to the workers by value."""
    import bz2
    import csv
    import fnmatch
    import gzip
    import io
    import lzma
    import re

    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    declared = HEAD_SCHEMA  # by value: workers may lack the package
    openers = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}

    def locate(address: str):
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", address):
            return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", address))
        return fs.LocalFileSystem(), address

    def header(stream, name: str):
        """The first record; line breaks inside quotes belong to it."""
        suffix = name[name.rfind(".") :]
        raw = openers[suffix](stream, "rb") if suffix in openers else stream
        lines = io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="")
        record = next(csv.reader(lines), None)
        if record is None:
            raise ValueError("the file is empty")
        return record, None

    def footer(stream, name: str):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        names, types = [], []
        for field in pq.read_schema(stream):
            kind = getattr(field.type, "value_type", field.type) if str(field.type).startswith("dictionary") else field.type
            names.append(field.name)
            try:
                types.append(from_arrow_type(kind).simpleString())
            except Exception:  # a type that Spark does not know keeps its own name
                types.append(str(kind))
        return names, types

    class Group(InputPartition):
        def __init__(self, paths):
            self.paths = paths

    class HeadReader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            found, root = locate(self.options["path"])
            # Like Spark's own listing: names that begin with a dot or an underscore are hidden.
            paths = sorted(
                info.path for info in found.get_file_info(fs.FileSelector(root))
                if info.type == fs.FileType.File and info.base_name[0] not in "._"
                and fnmatch.fnmatchcase(info.base_name, self.options["glob"])
            )
            size = int(self.options["filespertask"])
            return [Group(paths[i : i + size]) for i in range(0, len(paths), size)] or [Group([])]

        def read(self, partition):
            found, _ = locate(self.options["path"])
            parse = footer if self.options["kind"] == "parquet" else header
            for path in partition.paths:
                name = path.rsplit("/", 1)[-1]
                try:
                    with found.open_input_file(path) as stream:
                        columns, types = parse(stream, name)
                    yield name, path, columns, types, None, None
                except Exception as problem:
                    yield name, path, None, None, "unreadable or empty", f"{type(problem).__name__}: {problem}"

    class HeadSource(DataSource):
        @classmethod
        def name(cls):
            return "file_heads"

        def schema(self):
            return declared

        def reader(self, schema):
            return HeadReader(dict(self.options))

    return HeadSource


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme Spark reads it by, taken from the path of one of its files."""
    file = spark.read.format("binaryFile").load(folder).select("path").first()
    return folder if file is None else file.path.rsplit("/", 1)[0]


def _read(spark: SparkSession, folder: str, glob: str, kind: str, files_per_task: int) -> DataFrame:
    spark.dataSource.register(_source())
    return (
        spark.read.format("file_heads")
        .options(glob=glob, kind=kind, filespertask=files_per_task)
        .load(_qualified(spark, folder))
    )


def read_headers(
    spark: SparkSession, folder: str, glob: str = "*.csv.gz", files_per_task: int = FILES_PER_TASK
) -> DataFrame:
    """``(file_name, columns, error, cause)``: the first record of every delimited file in ``folder``.

    Files may be plain or compressed (``.gz``, ``.bz2``, ``.xz``); what follows the header is not
    looked at, so a damaged tail does no harm. A file that cannot be read, or is empty, is kept
    with null ``columns``, an ``error``, and the text of the exception as its ``cause``. A header
    with a cell of more than 131,072 characters counts as unreadable: a quote was left open.
    """
    return _read(spark, folder, glob, "csv", files_per_task).select("file_name", "columns", "error", "cause")


def read_footers(
    spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_task: int = FILES_PER_TASK
) -> DataFrame:
    """``(file_name, columns, types, error, cause)`` of every Parquet file in ``folder``, by its footer alone.

    ``types`` are Spark's names of the types, in the order of ``columns``.
    """
    return _read(spark, folder, glob, "parquet", files_per_task).select(
        "file_name", "columns", "types", "error", "cause"
    )


def shapes(footers: DataFrame) -> DataFrame:
    """``(columns, types, n_files)``: the different shapes among readable footers."""
    return footers.where("error is null").groupBy("columns", "types").agg(F.count(F.lit(1)).alias("n_files"))
