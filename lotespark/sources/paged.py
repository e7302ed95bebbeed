"""`spark.read.format("pages")` and `df.write.format("survey_reports")`.

*pages* reads what a paged service gave, as an acquisition job landed it: a folder with
`manifest.jsonl`, a line `{"start": 0, "file": "p0.json"}` per page in any order, and
the pages, JSON documents with a list of features. A page is a partition and its
features are rows. The feed ends at the first page that holds fewer features than
`batch` (an empty one too); pages after it aren't read. A page that is missing before
the end, in the manifest or in the folder, is an error, as is a feed whose last page is
full and not followed by another: its end was never seen.

*survey_reports* writes a file per survey: a byte-order mark, then the lines in the
order that they come. Rows are (key, line), those of one key together in one task, as
`exports.write_csv_reports` sends them. Files are written beside their place and moved
there when all tasks have ended well; a task that fails or is repeated leaves nothing.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..runtime import ready

BATCH = 500
#: Files moved to their place at once.
MOVES = 16


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def text_of(store: fs.FileSystem, path: str) -> str:
    with store.open_input_stream(path) as f:
        return f.read().decode("utf-8")


class Page(InputPartition):
    def __init__(self, start: int, path: str):
        super().__init__(None)
        self.start, self.path = start, path


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.batch, self.member = options["path"], int(options.get("batch", BATCH)), options.get("features", "features")

    def features(self, store: fs.FileSystem, path: str) -> list:
        found = json.loads(text_of(store, path)).get(self.member) or []
        if not isinstance(found, list):
            raise ValueError(f"{path}: {self.member} is no list")
        return found

    def partitions(self) -> list[Page]:
        """The pages up to the feed's end. Full pages aren't opened here if the manifest has their counts."""
        store, at = store_of(self.path)
        known = [json.loads(line) for line in text_of(store, posixpath.join(at, "manifest.jsonl")).splitlines() if line.strip()]
        by_start = {p["start"]: p for p in known}
        pages, start = [], 0
        while True:
            page = by_start.get(start)
            if page is None:
                raise ValueError(f"page with start {start} is missing: {len(pages)} pages before it are full")
            path = posixpath.join(at, page["file"])
            if store.get_file_info(path).type != fs.FileType.File:
                raise FileNotFoundError(f"page with start {start} is missing: no file {page['file']}")
            n = page["count"] if "count" in page else len(self.features(store, path))
            if n:
                pages.append(Page(start, path))
            if n < self.batch:
                return pages
            start += self.batch

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # a feed without pages
            return
        store, _ = store_of(self.path)
        found = self.features(store, partition.path)
        for k, feature in enumerate(found):
            yield partition.start + k, json.dumps(feature, ensure_ascii=False)


class Pages(DataSource):
    """Options: path; batch (features of a full page, 500); features (name of the list, `features`)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "pos bigint, text string"

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """The names of the files that a task wrote, and the folder that they wait in. Names only, since all of them go to the driver."""

    folder: str
    names: list[str]


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.prefix, self.overwrite = options["path"], options.get("prefix", "relevamiento"), overwrite
        self.job = uuid.uuid4().hex

    def staging(self, at: str) -> str:
        return posixpath.join(at, f".staging-{self.job}")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, at = store_of(self.path)
        mine = posixpath.join(self.staging(at), uuid.uuid4().hex)
        store.create_dir(mine)
        names: dict[str, None] = {}
        key, lines = None, []

        def close() -> None:
            name = f"{self.prefix}_{re.sub(r'[^0-9A-Za-z_-]', '_', str(key))}.csv"
            if name in names:
                raise ValueError(f"the rows of {key} don't come together")
            names[name] = None
            with store.open_output_stream(posixpath.join(mine, name)) as out:
                out.write(("\ufeff" + "".join(lines)).encode("utf-8"))

        for r in iterator:
            if lines and r[0] != key:
                close()
                lines = []
            key = r[0]
            lines.append((r[1] or "") + "\r\n")
        if lines:
            close()
        return Written(mine, list(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        files = [(m.folder, name) for m in messages if m for name in m.names]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two tasks have rows of one survey")
        if self.overwrite:
            for i in store.get_file_info(fs.FileSelector(at)):
                if i.type == fs.FileType.File and i.base_name.startswith(self.prefix + "_"):
                    store.delete_file(i.path)
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda f: store.move(posixpath.join(*f), posixpath.join(at, f[1])), files, chunksize=100):
                pass
        store.delete_dir(self.staging(at))

    def abort(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        if store.get_file_info(self.staging(at)).type == fs.FileType.Directory:
            store.delete_dir(self.staging(at))


def report_lines(keys: DataFrame, path: str, by: str, prefix: str = "relevamiento") -> DataFrame:
    """(by, line) of the reports of all keys: each task opens the files of its keys by name, so nothing lists the folder. A report that is missing is an error; the mark is taken off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = store_of(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                found, text = [], []
                for key in batch.column(0).slice(low, 500).to_pylist():
                    name = f"{prefix}_{re.sub(r'[^0-9A-Za-z_-]', '_', str(key))}.csv"
                    lines = re.split("\r\n|\r|\n", text_of(store, posixpath.join(at, name)).removeprefix("\ufeff"))
                    lines = lines[:-1] if lines[-1] == "" else lines
                    found += [key] * len(lines)
                    text += lines
                yield pa.RecordBatch.from_arrays([pa.array(found, batch.column(0).type), pa.array(text, pa.string())], names=[by, "line"])

    tasks = 4 * keys.sparkSession.sparkContext.defaultParallelism
    kind = keys.schema[by].dataType.simpleString()
    return keys.select(by).distinct().repartition(tasks, by).transform(ready).mapInArrow(run, f"{by} {kind}, line string")


class SurveyReports(DataSource):
    """Options: path; prefix of the files' names. Columns: key, line."""

    @classmethod
    def name(cls) -> str:
        return "survey_reports"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
    spark.dataSource.register(SurveyReports)
