"""Python data sources for what Spark's file formats lack: archives by member, GeoPackage layers by row range, services by page.

Paths are opened where they lie, by Arrow's file systems, and streamed. No file stands in a cell of a table.
"""

from __future__ import annotations

import contextlib
import json
import shutil
import sqlite3
import tempfile
import time
import urllib.parse
import urllib.request
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from waymark.sources.geoblobs import from_blob, to_blob
from waymark.sources.xmlobjects import elements, texts_in

#: Compressed bytes of an archive's members that a task reads, unless one member alone has more.
BUNDLE_BYTES = 32 << 20


def file_system(path: str):
    """The Arrow file system of a path or address, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(path).path)
    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def opened(path: str):
    where, name = file_system(path)
    with where.open_input_file(name) as stream:
        yield stream


@dataclass
class Members(InputPartition):
    """Some members of an archive; none for a file that is no archive."""

    path: str
    names: tuple[str, ...]


class RegisterObjects(DataSource):
    """Objects of zipped XML; see ``files.register_objects`` for its options."""

    @classmethod
    def name(cls) -> str:
        return "waymark_objects"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return RegisterReader(json.loads(self.options["plan"]))


class RegisterReader(DataSourceReader):
    """A task for each bundle of neighbouring members; a member is one stream, so it isn't cut."""

    def __init__(self, plan: dict):
        self.plan = plan

    def partitions(self) -> list[Members]:
        out = []
        for path in self.plan["paths"]:
            with opened(path) as stream:
                if not zipfile.is_zipfile(stream):
                    out.append(Members(path, ()))
                    continue
                found = sorted((i for i in zipfile.ZipFile(stream).infolist() if i.filename.lower().endswith(".xml")), key=lambda i: i.filename)
            bundle, held = [], 0
            for info in found[: self.plan["most"]]:
                if bundle and held + info.compress_size > self.plan["bundle"]:
                    out.append(Members(path, tuple(bundle)))
                    bundle, held = [], 0
                bundle.append(info.filename)
                held += info.compress_size
            if bundle:
                out.append(Members(path, tuple(bundle)))
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        file = partition.path.rsplit("/", 1)[-1]
        with opened(partition.path) as stream:
            if not partition.names:
                yield from self._rows(stream, file, file)
                return
            with zipfile.ZipFile(stream) as archive:
                for name in partition.names:
                    with archive.open(name) as member:
                        yield from self._rows(member, file, name)

    def _rows(self, stream, file: str, member: str) -> Iterator[tuple]:
        where = (file, member) if self.plan["origin"] else ()
        many = set(self.plan["lists"])
        for found in elements(stream, self.plan["name"]):
            yield (*where, *[list(texts_in(found, tag)) if c in many else next(texts_in(found, tag), None) for c, tag in self.plan["fields"].items()])


@dataclass
class RowRange(InputPartition):
    """Rows of a layer with ``low <= rowid < high``; all of them without bounds."""

    path: str
    low: int | None
    high: int | None


class GeoPackage(DataSource):
    """A layer of GeoPackage files; see ``files.geopackage`` and ``sinks.geopackage``."""

    @classmethod
    def name(cls) -> str:
        return "waymark_geopackage"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return GeoPackageReader(json.loads(self.options["plan"]))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return GeoPackageWriter(json.loads(self.options["plan"]), [(f.name, f.dataType.typeName()) for f in schema.fields])


@contextlib.contextmanager
def database(path: str):
    """A GeoPackage to read: in its place on a mounted file system, else a local copy made a megabyte at a time."""
    from pyarrow import fs

    where, name = file_system(path)
    with tempfile.TemporaryDirectory() as folder:
        if not isinstance(where, fs.LocalFileSystem):
            with where.open_input_stream(name) as source, open(f"{folder}/copy.gpkg", "wb") as copy:
                shutil.copyfileobj(source, copy, 1 << 20)
            name = f"{folder}/copy.gpkg"
        db = sqlite3.connect(f"{Path(name).absolute().as_uri()}?mode=ro&immutable=1", uri=True)
        try:
            yield db
        finally:
            db.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class GeoPackageReader(DataSourceReader):
    """Ranges of row numbers are tasks of their own where the file can be opened in place; a file elsewhere is one task."""

    def __init__(self, plan: dict):
        self.plan = plan

    def _layer(self, db) -> tuple[str, str]:
        layers = [r[0] for r in db.execute("select table_name from gpkg_contents where data_type = 'features'")]
        wanted = self.plan["layer"]
        if (wanted is None and len(layers) != 1) or (wanted is not None and wanted not in layers):
            raise ValueError(f"layers: {', '.join(layers)}")
        layer = wanted or layers[0]
        return layer, db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()[0]

    def partitions(self) -> list[RowRange]:
        from pyarrow import fs

        out = []
        for path in self.plan["paths"]:
            if not isinstance(file_system(path)[0], fs.LocalFileSystem):
                out.append(RowRange(path, None, None))
                continue
            with database(path) as db:
                layer, _ = self._layer(db)
                low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(layer)}").fetchone()  # noqa: S608
            if low is not None:
                out += [RowRange(path, at, at + self.plan["rows"]) for at in range(low, high + 1, self.plan["rows"])]
        return out or [RowRange("", 0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        if not partition.path:
            return
        with database(partition.path) as db:
            layer, shape = self._layer(db)
            there = {r[1].lower() for r in db.execute(f"pragma table_info({quoted(layer)})")}
            # a quoted name that isn't there would be taken for a text
            if lacking := [c for c in self.plan["columns"] if c.lower() not in there and c not in self.plan["optional"]]:
                raise ValueError(f"{partition.path}: missing columns {', '.join(lacking)}")
            chosen = ", ".join(quoted(c) if c.lower() in there else "null" for c in (*self.plan["columns"], shape))
            bounds = "" if partition.low is None else f" where rowid >= {int(partition.low)} and rowid < {int(partition.high)}"
            for *values, blob in db.execute(f"select {chosen} from {quoted(layer)}{bounds}"):  # noqa: S608
                if blob is not None:
                    yield from ((*values, k, *g) for k, g in enumerate(from_blob(bytes(blob))))


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has written, and its rows."""

    name: str
    rows: int


#: What a GeoPackage must hold, and the column types of Spark's types in it.
GPKG_APPLICATION, GPKG_VERSION = 0x47504B47, 10300
GPKG_TABLES = (
    "create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer not null primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text)",
    "create table gpkg_contents (table_name text not null primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x double, min_y double, max_x double, max_y double, srs_id integer)",
    "create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name))",
    "insert into gpkg_spatial_ref_sys values ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', null), ('Undefined geographic', 0, 'NONE', 0, 'undefined', null), ('WGS 84', 4326, 'EPSG', 4326, 'undefined', null)",
)
GPKG_TYPES = {"byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "boolean": "boolean", "float": "double", "double": "double"}
SHAPE = ("kind", "x", "y", "line", "polygon")


class GeoPackageWriter(DataSourceWriter):
    """Each task makes one file on its own disk and puts it under the staged folder; the commit keeps only files of tasks that count."""

    def __init__(self, plan: dict, fields: list[tuple[str, str]]):
        self.plan = plan
        self.names = [n for n, _ in fields]
        self.columns = [(n, GPKG_TYPES.get(t, "text")) for n, t in fields if n not in SHAPE]

    def write(self, iterator) -> Part:
        layer, srs = self.plan["layer"], self.plan["srs"]
        at = {n: k for k, n in enumerate(self.names)}
        name = f"part-{uuid.uuid4().hex}.gpkg"
        with tempfile.TemporaryDirectory() as folder:
            db = sqlite3.connect(f"{folder}/{name}")
            db.execute(f"pragma application_id = {GPKG_APPLICATION}")
            db.execute(f"pragma user_version = {GPKG_VERSION}")
            for statement in GPKG_TABLES:
                db.execute(statement)
            if srs not in (-1, 0, 4326):
                db.execute("insert into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{srs}", srs, srs))
            db.execute(f"create table {quoted(layer)} (fid integer primary key autoincrement, geom geometry, {', '.join(f'{quoted(n)} {t}' for n, t in self.columns)})" if self.columns else f"create table {quoted(layer)} (fid integer primary key autoincrement, geom geometry)")
            insert = f"insert into {quoted(layer)} values ({', '.join('?' * (2 + len(self.columns)))})"  # noqa: S608
            box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
            rows = 0

            def values() -> Iterator[tuple]:
                nonlocal rows
                for row in iterator:
                    rows += 1
                    blob = to_blob(row[at["kind"]], *(row[at[c]] if c in at else None for c in SHAPE[1:]), srs=srs, box=box)
                    yield (None, blob, *(v if v is None or isinstance(v, (int, float, str)) else str(v) for v in (row[at[n]] for n, _ in self.columns)))

            db.executemany(insert, values())
            bounds = box if box[0] <= box[2] else [None] * 4
            db.execute("insert into gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) values (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, *bounds, srs))
            db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs))
            db.commit()
            db.close()
            where, staged = file_system(self.plan["staged"])
            where.create_dir(staged, recursive=True)
            with open(f"{folder}/{name}", "rb") as source, where.open_output_stream(f"{staged}/{name}") as target:
                shutil.copyfileobj(source, target, 1 << 20)
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        where, staged = file_system(self.plan["staged"])
        kept = {m.name for m in messages if m is not None}
        for info in where.get_file_info(fs.FileSelector(staged)):
            if info.base_name not in kept:
                where.delete_file(info.path)

    def abort(self, messages: list[Part | None]) -> None:
        where, staged = file_system(self.plan["staged"])
        with contextlib.suppress(OSError):
            where.delete_dir(staged)


@dataclass
class Stride(InputPartition):
    """Every ``step``-th page from ``first`` on, until one isn't full."""

    first: int
    step: int


class Pages(DataSource):
    """Records of a paged JSON service, a row of text for each; see ``files.paged``."""

    @classmethod
    def name(cls) -> str:
        return "waymark_pages"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(json.loads(self.options["plan"]))


class PagesReader(DataSourceReader):
    """As many tasks as readers share the pages in turn, so no count has to be known and each ends by itself."""

    def __init__(self, plan: dict):
        self.plan = plan

    def partitions(self) -> list[Stride]:
        n = self.plan["readers"] if self.plan["size"] else 1
        return [Stride(k, n) for k in range(n)]

    def read(self, partition: Stride) -> Iterator[tuple]:
        size, page = self.plan["size"], partition.first
        while True:
            records = self._records(page * size if size else None)
            for r in records:
                yield (json.dumps(r, ensure_ascii=False),)
            if not size or len(records) != size:
                break
            page += partition.step
        # a service that gives fewer rows than asked for, though there are more, would leave gaps between pages
        if size and (len(records) > size or records and self._records(page * size + len(records))):
            raise ValueError(f"{self.plan['urls'][0]}: pages of {len(records)} rows where {size} were asked for")

    def _records(self, offset: int | None) -> list:
        answer = self._answer(offset)
        for key in self.plan["records"]:
            answer = answer.get(key) if isinstance(answer, dict) else None
        if not isinstance(answer, list):
            raise ValueError(f"{self.plan['urls'][0]}: no list of records in the answer")
        return answer

    def _answer(self, offset: int | None):
        """The JSON of the first address that gives one; all are asked again after each wait."""
        query = dict(self.plan["query"])
        if offset is not None:
            query |= {self.plan["offset"]: offset, self.plan["limit"]: self.plan["size"]}
        errors = []
        for wait in (0, *self.plan["waits"]):
            time.sleep(wait)
            for url in self.plan["urls"]:
                full = url + ("&" if "?" in url else "?") + urllib.parse.urlencode(query) if query else url
                request = urllib.request.Request(full, headers={"User-Agent": "waymark"})  # noqa: S310
                try:
                    with urllib.request.urlopen(request, timeout=self.plan["timeout"]) as response:  # noqa: S310
                        return json.loads(response.read())
                except (OSError, ValueError) as error:
                    errors.append(f"{url}: {error}")
        raise ConnectionError("; ".join(errors))
