"""A Spark data source for story files (S2): reads and writes folders of
``.story`` files, many documents a task, on any storage that Arrow's file
systems reach (local, ``hdfs://``, ``s3://``, ``gs://``)."""

from __future__ import annotations

import fnmatch
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .stories import MARKER, parse_story

GLOB = "*.story"
#: Bytes of a read task, and what opening one more file counts for.
TASK_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
#: Files are dealt over so many folders, so that none lists all of them.
FOLDERS = 256


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class StoryReader(DataSourceReader):
    def __init__(self, path: str, glob: str, task_bytes: int):
        self.path, self.glob, self.task_bytes = path, glob, task_bytes

    def partitions(self):
        fs, base = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        tasks, paths, size = [], [], 0
        for f in sorted((f for f in found if f.is_file and fnmatch.fnmatchcase(f.base_name, self.glob)), key=lambda f: f.path):
            if paths and size + f.size + OPEN_BYTES > self.task_bytes:
                tasks.append(Files(tuple(paths)))
                paths, size = [], 0
            paths.append(f.path)
            size += f.size + OPEN_BYTES
        return tasks + [Files(tuple(paths))]

    def read(self, partition):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                yield path, f.read().decode("utf-8", "replace")


class StoryWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches):
        """A file for each row.  It is written under a name of its own and then
        moved, so a task that runs twice leaves the same files."""
        fs, base = pafs.FileSystem.from_uri(self.path)
        made = set()
        for b in batches:
            for name, value in zip(b.column("name").to_pylist(), b.column("value").to_pylist()):
                folder = f"{base}/{zlib.crc32(name.encode()) % FOLDERS:03d}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(value.encode())
                fs.move(part, f"{folder}/{quote(name, safe='')}.story")
        return WriterCommitMessage()


class StorySource(DataSource):
    """``spark.read.format("stories").load(folder)`` gives ``(path, value)``;
    rows ``(name, value)`` are written with mode ``append``.  Options:
    ``pathGlobFilter`` and ``taskBytes``."""

    @classmethod
    def name(cls):
        return "stories"

    def schema(self):
        return "path string, value string"

    def reader(self, schema):
        return StoryReader(self.options["path"], self.options.get("pathGlobFilter", GLOB),
                           int(self.options.get("taskBytes", TASK_BYTES)))

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("story files are only added: write with mode append")
        return StoryWriter(self.options["path"])


def story_text(article, highlights) -> Column:
    """The text of a story file: the article, then each highlight after a marker."""
    mark = F.lit(f"\n\n{MARKER}\n\n")
    shown = F.transform(F.coalesce(highlights, F.array().cast("array<string>")), lambda h: F.concat(mark, F.coalesce(h, F.lit(""))))
    return F.concat(F.coalesce(article, F.lit("")), F.array_join(shown, ""))


def write_stories(stories: DataFrame, path: str, key: str = "doc_id", article: str = "article",
                  highlights: str = "highlights") -> None:
    """A ``.story`` file for each row, named by its key (percent-encoded).

    Null texts are empty ones.  Keys must be distinct and not null, as a file
    has one name; this is checked first, on the keys alone.  Texts are not
    shuffled.  An empty table writes nothing.
    """
    name = F.col(key).cast("string")
    if not stories.groupBy(name.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null").isEmpty():
        raise ValueError(f"{key} must be distinct and not null to name files")
    write_story_files(stories.select(name.alias("name"), story_text(F.col(article), F.col(highlights)).alias("value")), path)


def write_story_files(files: DataFrame, path: str) -> None:
    """A ``.story`` file for each row ``(name, value)``; names must be distinct."""
    files.sparkSession.dataSource.register(StorySource)
    files.select("name", "value").write.format("stories").mode("append").save(path)


def load_stories(spark: SparkSession, path: str, glob: str = GLOB) -> DataFrame:
    """``(key, article, highlights)`` of every matching file below ``path``;
    ``key`` is the file's name without its ending, decoded."""
    spark.dataSource.register(StorySource)
    raw = spark.read.format("stories").option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return raw.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("key"), parse_story("value").alias("s")) \
        .select("key", "s.article", "s.highlights")
