"""File sources and sinks: partition trees, JSON, archives and LaTeX members."""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import latex
from marlstone.functions.dates import months_between
from marlstone.session import delete, exists, filesystem, materialise, names, new_table_path

#: Names of main files, the best first, and extensions of other text files.
MAIN_NAMES = ("main.tex", "paper.tex", "article.tex", "manuscript.tex")
TEXT_EXTENSIONS = (".txt", ".text", ".latex")


def partition_path(root: str, parent: Column, topic: Column, year: Column, month: Column, stage: str) -> Column:
    """``root/[parent/]topic/YYYY/MM/stage``; no parent level where the topic is itself a main one or has none."""
    level = F.when(parent != topic, parent)
    return F.concat_ws("/", F.lit(root), level, topic, year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit(stage))


def path_metadata(df: DataFrame, path: str) -> DataFrame:
    """``df`` with topic, year and month from the fourth to second last part of a path; null for shorter ones."""
    parts = F.split(F.col(path), "/")
    return df.withColumns({name: F.try_element_at(parts, F.lit(-k)) for name, k in (("topic", 4), ("year", 3), ("month", 2))})


def read_json(spark: SparkSession, path: str, schema: str, array_per_file: bool = True) -> DataFrame:
    """A JSON source with a declared schema: an array of objects per file, or one object a line."""
    return spark.read.schema(schema).option("multiLine", array_per_file).json(path)


def save(df: DataFrame, path: str, *, append: bool = False, by: list[str] | None = None) -> None:
    """Write or append Parquet; with ``by``, overwriting replaces only the partitions that ``df`` has."""
    w = df.write.mode("append" if append else "overwrite")
    if by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    w.parquet(path)


def save_metrics(df: DataFrame, path: str, run: str, **flags: str) -> None:
    """Metrics as JSON lines with the run and its flags as columns."""
    df.withColumns({"run": F.lit(run), **{k: F.lit(v) for k, v in flags.items()}}).write.mode("append").json(path)


def save_by_model(df: DataFrame, path: str) -> None:
    df.repartition("model").write.mode("overwrite").partitionBy("model").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Put ``df`` in the place of the table at ``path``, which is complete before it gets there; where the last step fails the old table is put back."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    delete(spark, new)
    df.write.parquet(new)
    fs, there = filesystem(spark, path)
    moved = filesystem(spark, old)[1]
    if exists(spark, path):
        delete(spark, old)
        fs.rename(there, moved)
    if not fs.rename(filesystem(spark, new)[1], there):
        if exists(spark, old):
            fs.rename(moved, there)
        raise OSError(f"could not put the new table at {path}")
    delete(spark, old)


def is_dataset(spark: SparkSession, path: str, every: bool = True) -> bool:
    """Whether a written table is at ``path``: with ``every``, finished and with data files of rows; else any of its files."""
    have = names(spark, path)
    finished, data = "_SUCCESS" in have, [n for n in have if n.endswith(".parquet") or "=" in n]
    if not every:
        return finished or bool(data)
    return finished and bool(data) and bool(spark.read.parquet(path).take(1))


#: Columns that hold a problem's date, the first one there counts.
DATE_COLUMNS = ("question_date", "date", "created_at")


def load_problems(spark: SparkSession, path: str, first: str = "2023-05-01", last: str = "2024-02-29") -> DataFrame:
    """Problems (JSON lines) of a range of dates, all where none is in it; the generated sample where they cannot be loaded. Unreadable dates are in the range, missing ones are not."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return sample_problems(spark)
    told = next((c for c in DATE_COLUMNS if c in found.columns), None)
    if told is None:
        return found if found.columns else sample_problems(spark)
    day = F.try_to_date(F.substring(told, 1, 10), "yyyy-MM-dd")
    kept = found.where((F.coalesce(told, F.lit("")) != "") & (day.isNull() | day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    return kept if kept.take(1) else found


def to_arrow(df: DataFrame) -> DataFrame:
    """(data): the rows as whole Arrow streams, one for each batch."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.binary())], names=["data"])

    return df.mapInArrow(run, "data binary")


def from_arrow(saved: DataFrame, data: str, schema: str) -> DataFrame:
    """The rows of Arrow files or streams, e.g. of ``binaryFile``, by the columns of ``schema``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                raw = x.as_buffer()
                reader = pa.ipc.open_file(raw) if raw[:6] == b"ARROW1" else pa.ipc.open_stream(raw)
                whole = reader.read_all().select(target.names).cast(target)
                yield from whole.to_batches()

    return saved.select(data).mapInArrow(run, schema)


def count_or_zero(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, 0 where there is none; a table that cannot be read is an error."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def sample_problems(spark: SparkSession, first: str = "2023-05-01", last: str = "2024-02-01", each: int = 3) -> DataFrame:
    """The generated benchmark that stands in where none can be loaded."""
    months = spark.range(1).select(F.explode(months_between(first, last)).alias("m")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    case = '[{"input": "1 2", "output": "3", "testtype": "stdin"}]'
    return months.select(
        F.concat(F.lit("sample_"), F.date_format("m", "yyyy-MM"), F.lit("_"), F.col("i")).alias("question_id"), F.date_format("m", "yyyy-MM-dd").alias("question_date"), F.concat(F.lit("Sample problem "), F.col("i") + 1).alias("question_title"),
        F.lit("Add two numbers.").alias("question_content"), F.lit("").alias("starter_code"), F.lit(case).alias("public_test_cases"), F.lit(case).alias("private_test_cases"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.col("i") % 3 + 1).alias("difficulty"), F.lit("{}").alias("metadata"),
    )


def unpack(data: bytes) -> Iterator[tuple[str, str]]:
    """(member, text) of an archive: tar (also compressed) before plain gzip, zip, else the bytes as one file if they look like LaTeX. Broken archives have no members."""
    def text(b: bytes) -> str:
        return b.decode("utf-8", errors="replace")

    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for m in t:
                if m.isfile():
                    yield m.name, text(t.extractfile(m).read())
            return
    except (tarfile.TarError, EOFError, OSError):
        pass
    try:
        if data[:2] == b"\x1f\x8b":
            yield "extracted.tex", text(gzip.decompress(data))
        elif data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in z.namelist():
                    if not name.endswith("/"):
                        yield name, text(z.read(name))
        elif b"\\documentclass" in data[:1000] or b"\\begin" in data[:1000]:
            yield "raw.tex", text(data)
    except (OSError, EOFError, zipfile.BadZipFile):
        return


#: Bytes of content that one archive holds, about.
ARCHIVE_BYTES = 32 << 20


def pack(members: DataFrame) -> DataFrame:
    """(archive, data): (member, content) rows as gzipped tar archives. Rows of bytes, so any file system that Spark writes to holds them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, bytes]] = []
        size = 0

        def close() -> pd.DataFrame:
            sink = io.BytesIO()
            with tarfile.open(fileobj=sink, mode="w:gz") as t:
                for member, data in held:
                    info = tarfile.TarInfo(member)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
            # named after its first member, so that a repeated task gives the same archive
            return pd.DataFrame({"archive": [f"{uuid.uuid5(uuid.NAMESPACE_URL, held[0][0]).hex}.tar.gz"], "data": [sink.getvalue()]})

        for f in frames:
            for member, content in zip(f["member"], f["content"]):
                held.append((member, content.encode()))
                size += len(held[-1][1])
                if size > ARCHIVE_BYTES:
                    yield close()
                    held.clear()
                    size = 0
        if held:
            yield close()

    return members.select("member", "content").repartition("member").sortWithinPartitions("member").mapInPandas(run, "archive string, data binary")


def archive_members(archives: DataFrame, archive: str = "archive", data: str = "data") -> DataFrame:
    """(archive, member, content) of archives given as rows of bytes; files under a path are read by ``spark.read.format("binaryFile")`` (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, packed in zip(f["archive"], f["data"]):
                yield pd.DataFrame([(name, m, t) for m, t in unpack(bytes(packed))], columns=["archive", "member", "content"])

    return archives.select(F.col(archive).alias("archive"), F.col(data).alias("data")).mapInPandas(run, "archive string, member string, content string")


def tex_members(members: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``.tex`` members, and other text members whose first 1000 characters hold a document marker."""
    name = F.col(path)
    other = F.lit(False)
    for e in TEXT_EXTENSIONS:
        other |= name.endswith(e)
    other |= name.rlike(r"/[^./]+$")
    return members.where(name.endswith(".tex") | (other & latex.has_document_marker(F.substring(content, 1, 1000))))


def main_files(members: DataFrame, paper: str, order: str, path: str = "path", content: str = "content") -> DataFrame:
    """One member per paper: a usual name, else a document marker, else the largest; then by path."""
    base_name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    rank = F.lit(len(MAIN_NAMES) + 1)
    rank = F.when(latex.has_document_marker(F.col(content)), len(MAIN_NAMES)).otherwise(rank)
    for i, n in reversed(list(enumerate(MAIN_NAMES))):
        rank = F.when(base_name == n, i).otherwise(rank)
    w = Window.partitionBy(paper).orderBy(rank, F.length(content).desc(), path, order)
    return members.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def include_order(edges: DataFrame, roots: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(root, path, place): files in the order of a depth-first walk along (source, target, position) includes, then those of ``files`` (root, path) that no include reaches, by path.

    A place is the row of positions on the way from the root; the walk's order is that of the
    least places. Each round carries on the files whose place got smaller, one place a file, until
    there are none; so there is no limit of depth, and a way back to a file never makes its place
    smaller. Rounds are written to the shared folder so that none is worked out twice.
    """
    spark = edges.sparkSession
    level = roots.select(F.col("root"), F.col("root").alias("path"), F.array(F.lit(0)).alias("place")).distinct()
    path = new_table_path(spark, "includes")
    while True:
        level.write.mode("append").parquet(path)
        known = spark.read.schema(level.schema).parquet(path).groupBy("root", "path").agg(F.min("place").alias("least"))
        steps = level.join(edges, F.col("path") == F.col("source")).groupBy("root", F.col("target").alias("path")).agg(F.min(F.concat("place", F.array(F.col("position").cast("int")))).alias("place"))
        level = materialise(steps.join(known, ["root", "path"], "left").where("least is null or place < least").select("root", "path", "place"), "level")
        if not level.take(1):
            break
    reached = known.withColumnRenamed("least", "at")
    if files is not None:
        rest = files.select("root", "path").where("root is not null and path is not null").distinct().join(reached, ["root", "path"], "left_anti")
        reached = reached.unionByName(rest.withColumn("at", F.lit(None).cast("array<int>")))
    return reached.select("root", "path", F.row_number().over(Window.partitionBy("root").orderBy(F.col("at").asc_nulls_last(), "path")).alias("place"))


def include_edges(members: DataFrame, paper: str = "paper", path: str = "path", content: str = "content") -> DataFrame:
    """(paper, source, target, position): the ``\\input`` and then ``\\include`` references of a paper's files that name one of its files.

    A name without ``.tex`` gets it. It is looked for beside the file that names it, else by its last part
    anywhere in the paper, the first by path.
    """
    refs = members.select(F.col(paper).alias("paper"), F.col(path).alias("source"), F.posexplode(latex.includes(F.col(content))).alias("position", "ref"))
    named = refs.withColumn("ref", F.when(F.col("ref").endswith(".tex"), F.col("ref")).otherwise(F.concat("ref", F.lit(".tex"))))
    named = named.withColumn("beside", F.concat(F.regexp_extract("source", r"(?s)^(.*/)?", 0), F.regexp_replace("ref", r"^(\./)+", ""))).withColumn("last", F.element_at(F.split("ref", "/"), -1))
    have = members.select(F.col(paper).alias("paper"), F.col(path).alias("target")).distinct()
    anywhere = have.groupBy("paper", F.element_at(F.split("target", "/"), -1).alias("last")).agg(F.min("target").alias("other"))
    found = named.join(have.withColumnRenamed("target", "beside").withColumn("exact", F.col("beside")), ["paper", "beside"], "left").join(anywhere, ["paper", "last"], "left")
    return found.withColumn("target", F.coalesce("exact", "other")).where("target is not null").select("paper", "source", "target", "position")


def file_order(members: DataFrame, paper: str = "paper", order: str = "path", path: str = "path", content: str = "content") -> DataFrame:
    """(paper, path, place): all files of each paper, from the main one along its includes, then those that are not referenced."""
    whole = lambda p, f: F.struct(p.alias("paper"), f.alias("path"))
    p = F.col(paper)
    edges = include_edges(members, paper, path, content).select(whole(F.col("paper"), F.col("source")).alias("source"), whole(F.col("paper"), F.col("target")).alias("target"), "position")
    first = main_files(members, paper, order, path, content).select(whole(p, F.col(path)).alias("root"), p.alias("paper"))
    every = members.select(p.alias("paper"), whole(p, F.col(path)).alias("path")).join(first, "paper").select("root", "path")
    return include_order(edges, first.select("root"), every).select(F.col("path.paper").alias("paper"), F.col("path.path").alias("path"), "place")
