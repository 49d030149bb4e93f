"""Writers of extraction records. Every writer is a distributed Spark write into a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folders import exists, removed

NO_VALUE = "no information"


def title(key: str) -> str:
    return key.strip("_").replace("_", " ").title()


def write_records(records: DataFrame, path: str, fmt: str, labels: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Write wide records as ``json``, ``csv`` or ``markdown``.

    CSV columns have the labels, in their order, then the metadata keys in
    title case, and nulls are empty. Appending needs the same columns in the
    same order, which the folder's header gives. JSON keeps nulls out of
    nothing and every character as it is. Markdown has one text per record.
    """
    labels = labels or {c: c for c in records.columns if not c.startswith("_")}
    keys = [*labels, *(c for c in records.columns if c.startswith("_"))]
    if fmt == "json":
        records.select(*keys).write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif fmt == "csv":
        text = records.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(labels.get(k) or title(k)) for k in keys))
        if mode == "append":
            spark = records.sparkSession
            if exists(spark, path) and (header := spark.read.option("header", True).csv(path).columns) != text.columns:
                raise ValueError(f"the folder has columns {header}")
        text.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)
    elif fmt == "markdown":
        records.select(records_markdown(keys, labels).alias("value")).write.mode(mode).text(path, lineSep="\n\n")
    else:
        raise ValueError(f"unknown format {fmt}")


def write_csv_file(records: DataFrame, path: str, labels: dict[str, str] | None = None) -> None:
    """Write wide records as one CSV file in UTF-8 with a byte-order mark, which spreadsheets look for.

    Columns and nulls are as in ``write_records``. If the file is there the
    records are added behind its own, under its header, which has to be the
    same. The rows are written by all tasks; their files are then put together
    through a small buffer, in the order of the partitions.
    """
    spark = records.sparkSession
    labels = labels or {c: c for c in records.columns if not c.startswith("_")}
    keys = [*labels, *(c for c in records.columns if c.startswith("_"))]
    names = [labels.get(k) or title(k) for k in keys]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    parts, made = f"{path}.parts-{uuid.uuid4()}", f"{path}.new-{uuid.uuid4()}"
    system = at(path).getFileSystem(conf)
    head = ",".join('"' + n.replace('"', '""') + '"' if any(c in n for c in '",\n\r') else n for n in names) + "\n"
    there = system.exists(at(path))
    if there:
        with_mark = spark.read.text(path).first()[0].removeprefix("\ufeff")
        if with_mark != head[:-1]:
            raise ValueError(f"the file has columns {with_mark}")
    text = records.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"c{i}") for i, k in enumerate(keys)))
    text.write.option("header", False).option("emptyValue", "").option("escape", '"').csv(parts)
    out = system.create(at(made), True)
    try:
        if not there:
            out.write(bytearray(b"\xef\xbb\xbf" + head.encode()))
        files = sorted(f.getPath().toString() for f in system.listStatus(at(parts)) if f.getPath().getName().startswith("part-"))
        for f in [*([path] if there else []), *files]:
            part = system.open(at(f))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            part.close()
    finally:
        out.close()
        removed(spark, parts)
    if there:
        system.delete(at(path), False)
    system.rename(at(made), at(path))


def records_markdown(keys: list[str], labels: dict[str, str]):
    """A record as lines of ``**label**: value``."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"**{labels.get(k) or title(k)}**: "), F.coalesce(F.col(k).cast("string"), F.lit(NO_VALUE))) for k in keys))


def read_binary_manifest(spark, path: str) -> DataFrame:
    """Paths and sizes of the files of a folder, without their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
