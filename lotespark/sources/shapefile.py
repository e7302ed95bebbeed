"""`spark.read.format("shapefile")`: census and street archives as tables.

    sources.shapefile.register(spark)
    spark.read.format("shapefile").option("path", "zip or folder or .shp").option("match", "5108402*").load()

A partition is a layer of an archive (a `.shp` with its `.dbf`), or a range of RANGE
records of a bare file. Attributes are decoded in batches from their fixed-width
records, only those named in the option `columns` if it is given. `geometry` is an array
of parts; a part is a polygon (its rings, the outer first), or one line or point in an
array. Layers whose `.prj` names a transverse Mercator projection come out in degrees.
Deleted records are left out; a null shape is a null geometry. `layer` and `row` tell
where a record stands. Paths may be anything that Arrow's file systems open, from every
executor.
"""

from __future__ import annotations

import datetime
import fnmatch
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RANGE, BATCH = 200_000, 8192
GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
ARROW_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_GEOMETRY = pa.list_(pa.list_(pa.list_(ARROW_POINT)))


class Field(NamedTuple):
    name: str
    kind: str
    size: int
    decimals: int

    @property
    def type(self) -> pa.DataType:
        if self.kind == "N" and not self.decimals and self.size <= 18:
            return pa.int64()
        return {"N": pa.float64(), "F": pa.float64(), "D": pa.date32(), "L": pa.bool_()}.get(self.kind, pa.string())


SPARK_TYPE = {pa.int64(): "bigint", pa.float64(): "double", pa.date32(): "date", pa.bool_(): "boolean", pa.string(): "string"}


# Attributes


def fields_of(head: bytes) -> tuple[list[Field], int, int, int]:
    """(fields, records, length of the heading, length of a record) of a .dbf."""
    records, start, width = int.from_bytes(head[4:8], "little"), int.from_bytes(head[8:10], "little"), int.from_bytes(head[10:12], "little")
    out = []
    for at in range(32, start - 1, 32):
        if head[at] == 0x0D:
            break
        out.append(Field(head[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(head[at + 11]), head[at + 16], head[at + 17]))
    return out, records, start, width


def _day(t: str) -> datetime.date | None:
    try:
        return datetime.datetime.strptime(t, "%Y%m%d").date() if len(t) == 8 else None
    except ValueError:
        return None


def attribute(raw: np.ndarray, f: Field, encoding: str) -> pa.Array:
    """A column from the bytes of its field in every record; blank, starred and unreadable values are null."""
    text = np.char.strip(np.char.decode(raw, encoding, "replace"), " \0")
    if f.type == pa.string():
        return pa.array([t or None for t in text.tolist()], pa.string())
    if f.type == pa.bool_():
        return pa.array([None if t in ("", "?") else t in "TtYy" for t in text.tolist()], pa.bool_())
    if f.type == pa.date32():
        return pa.array([_day(t) for t in text.tolist()], pa.date32())
    number = [float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t) else None for t in text.tolist()]
    if f.type == pa.int64():  # figures alone are read as they stand: a double would round long codes
        return pa.array([int(t) if re.fullmatch(r"[+-]?\d+", t) else None if v is None else int(v) for t, v in zip(text.tolist(), number)], pa.int64())
    return pa.array(number, pa.float64())


# Shapes


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) / 2


def inside(p: np.ndarray, ring: np.ndarray) -> bool:
    (x0, y0), (x1, y1) = ring[:-1].T, ring[1:].T
    crosses = (y0 > p[1]) != (y1 > p[1])
    return bool(np.count_nonzero(x0[crosses] + (p[1] - y0[crosses]) * (x1[crosses] - x0[crosses]) / (y1[crosses] - y0[crosses]) > p[0]) % 2)


def as_polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings that run with the clock are shells; the others are holes of the least shell around them."""
    rings = [r for r in rings if len(r) >= 4]
    areas = [signed_area(r) for r in rings]
    shells = [[r] for r, a in zip(rings, areas) if a <= 0]
    for hole in (r for r, a in zip(rings, areas) if a > 0):
        around = [s for s in shells if inside((hole[0] + hole[1]) / 2, s[0])]
        if around:
            min(around, key=lambda s: abs(signed_area(s[0]))).append(hole)
        else:  # a shell drawn the wrong way round
            shells.append([hole])
    return shells


def parts_of(content: bytes) -> list[list[np.ndarray]] | None:
    """The parts of one record's shape; heights and measures are left out."""
    kind = int.from_bytes(content[:4], "little") % 10
    if kind == 1:
        return [[np.frombuffer(content, "<f8", 2, 4).reshape(1, 2)]]
    if kind == 8:
        n = int.from_bytes(content[36:40], "little")
        return [[p.reshape(1, 2)] for p in np.frombuffer(content, "<f8", 2 * n, 40).reshape(n, 2)]
    if kind in (3, 5):
        parts, points = np.frombuffer(content, "<i4", 2, 36).tolist()
        first = np.frombuffer(content, "<i4", parts, 44).tolist()
        xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(points, 2)
        runs = [xy[a:b] for a, b in zip(first, [*first[1:], points])]
        return as_polygons(runs) if kind == 5 else [[r] for r in runs]
    return None


class Projection(NamedTuple):
    """Transverse Mercator, by the numbers of a .prj."""

    axis: float
    flattening: float
    meridian: float
    latitude: float
    scale: float
    east: float
    north: float

    def degrees(self, xy: np.ndarray) -> np.ndarray:
        """Longitude and latitude of eastings and northings, by the inverse of Krüger's series to the third power of the third flattening."""
        n = self.flattening / (2 - self.flattening)
        a = self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
        xi, eta = (xy[:, 1] - self.north) / (self.scale * a), (xy[:, 0] - self.east) / (self.scale * a)
        xi0, eta0 = xi.copy(), eta.copy()
        for j, b in enumerate(beta, 1):
            xi = xi - b * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0)
            eta = eta - b * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0)
        chi = np.arcsin(np.sin(xi) / np.cosh(eta))
        lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(delta, 1))
        return np.column_stack([self.meridian + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(lat)])


def projection(prj: str) -> Projection | None:
    """The projection that a .prj text names; None for degrees."""
    if not prj.lstrip().upper().startswith("PROJCS"):
        return None
    if "transverse_mercator" not in prj.lower():
        raise ValueError(f"no reader for this projection: {prj[:80]}")
    number = lambda name, usual: float(m[1]) if (m := re.search(rf'"{name}"\s*,\s*(-?[\d.]+)', prj, re.I)) else usual
    ball = re.search(r'SPHEROID\s*\[\s*"[^"]*"\s*,\s*([\d.]+)\s*,\s*([\d.]+)', prj, re.I)
    axis, inverse = (float(ball[1]), float(ball[2])) if ball else (6378137.0, 298.257223563)
    if number("latitude_of_origin", 0.0):
        raise ValueError("a projection whose origin is off the equator isn't read")
    return Projection(axis, 1 / inverse, number("central_meridian", 0.0), 0.0, number("scale_factor", 1.0), number("false_easting", 0.0), number("false_northing", 0.0))


# Layers


class Layer(InputPartition):
    """Records first to last (excluded; None: all) of a layer: a file, and its member if the file is an archive."""

    def __init__(self, path: str, member: str | None, first: int = 0, last: int | None = None):
        super().__init__(None)
        self.path, self.member, self.first, self.last = path, member, first, last

    @property
    def name(self) -> str:
        return posixpath.splitext(posixpath.basename(self.member or self.path))[0]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sibling(store: fs.FileSystem, layer: Layer, archive: zipfile.ZipFile | None, ending: str) -> io.IOBase | None:
    """A file of the layer by its ending, in either case, opened; None if there is none."""
    stem = posixpath.splitext(layer.member or layer.path)[0]
    for name in (stem + ending, stem + ending.upper()):
        if archive:
            if name in archive.namelist():
                return archive.open(name)
        elif store.get_file_info(name).type == fs.FileType.File:
            return store.open_input_file(name)
    return None


def _skip(f: io.IOBase, n: int) -> None:
    while n > 0 and (got := len(f.read(min(n, 1 << 20)))):
        n -= got


def layers(path: str, match: str = "*") -> list[Layer]:
    """The layers of an archive, a file, or all of both in a folder, whose names match; a layer of an archive is one partition."""
    store, at = _store(path)
    info = store.get_file_info(at)
    files = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    out = []
    for i in sorted(files, key=lambda i: i.path):
        kind = posixpath.splitext(i.path)[1].lower()
        if kind == ".shp":
            layer = Layer(prefix + i.path, None)
            index = _sibling(store, layer, None, ".shx")
            n = (index.size() - 100) // 8 if index and fnmatch.fnmatch(layer.name, match) else 0
            ranges = [(a, min(a + RANGE, n)) for a in range(0, n, RANGE)] or [(0, None)]
            out += [Layer(layer.path, None, a, b) for a, b in ranges]
        elif kind == ".zip":
            with store.open_input_file(i.path) as f, zipfile.ZipFile(f) as z:
                out += [Layer(prefix + i.path, m) for m in sorted(z.namelist()) if m.lower().endswith(".shp")]
    return [x for x in out if fnmatch.fnmatch(x.name, match)]


def shapes(f: io.IOBase, first: int, last: int | None, index: io.IOBase | None) -> Iterator[bytes]:
    """The contents of records first to last; the index, where there is one, says where the first begins."""
    if first and index:
        _skip(index, 100 + 8 * first)
        f.seek(2 * int.from_bytes(index.read(8)[:4], "big"))
    else:
        _skip(f, 100)
        for _ in range(first):
            _skip(f, 2 * int.from_bytes(f.read(8)[4:8], "big"))
    n = first
    while (last is None or n < last) and len(head := f.read(8)) == 8:
        yield f.read(2 * int.from_bytes(head[4:8], "big"))
        n += 1


def geometry(contents: list[bytes], to: Projection | None) -> pa.Array:
    rows = []
    for c in contents:
        parts = parts_of(c)
        rows.append(None if parts is None else [[(to.degrees(r) if to else r) for r in part] for part in parts])
    # flat points with offsets: no Python object for a point
    flat = [r for row in rows if row for part in row for r in part]
    points = np.concatenate(flat) if flat else np.zeros((0, 2))
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    xy = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], fields=list(ARROW_POINT))
    rings = pa.ListArray.from_arrays(ends([len(r) for r in flat]), xy)
    parts = pa.ListArray.from_arrays(ends([len(part) for row in rows if row for part in row]), rings)
    return pa.ListArray.from_arrays(ends([len(row or ()) for row in rows]), parts, mask=pa.array([row is None for row in rows]))


def read_layer(layer: Layer, columns: list[str]) -> Iterator[tuple[list, int]]:
    """Batches of a layer: the asked columns in their order, None for one that the layer doesn't have, and the count of rows."""
    store, at = _store(layer.path)
    here = Layer(at, layer.member)
    archive = zipfile.ZipFile(store.open_input_file(at)) if layer.member else None
    open_ = lambda ending: _sibling(store, here, archive, ending)
    text = lambda ending: f.read().decode("latin-1") if (f := open_(ending)) else ""
    to = projection(text(".prj"))
    page = text(".cpg").strip().lower().replace("ansi ", "cp") or "latin-1"
    encoding = f"cp{page}" if page.isdigit() else page
    table, shape = open_(".dbf"), open_(".shp") if "geometry" in columns else None
    if table is None:
        raise FileNotFoundError(f"{layer.path} {layer.member or ''}: no .dbf")
    head = table.read(32)
    head += table.read(int.from_bytes(head[8:10], "little") - 32)
    known, records, _, width = fields_of(head)
    at_byte = dict(zip((f.name for f in known), np.cumsum([1, *(f.size for f in known)])[:-1].tolist()))
    wanted = {f.name: f for f in known}
    last = records if layer.last is None else min(layer.last, records)
    if layer.first and not layer.member:
        table.seek(len(head) + layer.first * width)
    else:
        _skip(table, layer.first * width)
    contents = shapes(shape, layer.first, last, open_(".shx")) if shape else None
    for first in range(layer.first, last, BATCH):
        n = min(BATCH, last - first)
        raw = np.frombuffer(table.read(n * width), np.uint8).reshape(-1, width)
        kept = np.flatnonzero(raw[:, 0] != ord("*"))
        some = [next(contents, b"\0\0\0\0") for _ in range(len(raw))] if contents else []
        out = []
        for c in columns:
            if c == "geometry":
                out.append(geometry([some[k] for k in kept.tolist()], to))
            elif c == "layer":
                out.append(pa.array([layer.name] * len(kept), pa.string()))
            elif c == "row":
                out.append(pa.array(first + kept, pa.int64()))
            elif c in wanted:
                f = wanted[c]
                cell = np.ascontiguousarray(raw[kept, at_byte[c] : at_byte[c] + f.size]).view(f"S{f.size}").reshape(-1)
                out.append(attribute(cell, f, encoding))
            else:  # another layer has it
                out.append(None)
        yield out, len(kept)


class ShapefileReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Layer]:
        found = layers(self.options["path"], self.options.get("match", "*"))
        if not found:
            raise FileNotFoundError(f"no layer matches {self.options.get('match', '*')} in {self.options['path']}")
        return found

    def read(self, partition: Layer) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        for columns, n in read_layer(partition, self.schema.names):
            full = [pa.nulls(n, kinds.field(k).type) if c is None else c.cast(kinds.field(k).type) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(full, schema=kinds)


class Shapefile(DataSource):
    """Options: path; match (pattern of layer names); columns (comma-separated; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        first = next(iter(layers(self.options["path"], self.options.get("match", "*"))), None)
        if first is None:
            raise FileNotFoundError(f"no layer matches {self.options.get('match', '*')} in {self.options['path']}")
        store, at = _store(first.path)
        with zipfile.ZipFile(store.open_input_file(at)) if first.member else store.open_input_file(at) as z:
            table = _sibling(store, Layer(at, first.member), z if first.member else None, ".dbf")
            head = table.read(32)
            head += table.read(int.from_bytes(head[8:10], "little") - 32)
        kinds = {"layer": "string", "row": "bigint"} | {f.name: SPARK_TYPE[f.type] for f in fields_of(head)[0]} | {"geometry": GEOMETRY}
        asked = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else list(kinds)
        return ", ".join(f"`{c}` {kinds[c]}" for c in asked)

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Shapefile)
