"""Files of gridded fields as Spark data sources: raw daily grids, classic NetCDF, packed messages.

Each source lists its files on the driver, reads no more than headers there, and hands Spark one
partition for a file and a range of its records or messages; a task reads its own bytes and decodes them
with NumPy into Arrow batches. Paths are folders or files of any store that pyarrow opens. Register
them once a session (`register`), then `spark.read.format("raincask_raw").option(...).load(path)`.
Values that stand for missing are null.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


class GridError(ValueError):
    """A file is not what its format or its options say."""


def _store(path: str):
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*://", path) else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder but hidden ones, by path."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise GridError(f"no such path: {path}")
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    prefix = path[: len(path) - len(at)] if path.endswith(at) and "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in found)


def read_bytes(path: str, offset: int, length: int) -> bytes:
    store, at = _store(path)
    with store.open_input_file(at) as f:
        return f.read_at(length, offset)


@dataclass
class Part(InputPartition):
    """A range of the records of a file."""

    path: str
    first: int
    stop: int


def _ranges(path: str, records: int, most: int) -> list[Part]:
    return [Part(path, k, min(k + most, records)) for k in range(0, records, most)]


def _batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for (_, t), c in zip(schema, columns)], [n for n, _ in schema])


def _masked(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.float64), pa.float64(), mask=missing | ~np.isfinite(values))


class _Spool:
    """Rows of a file on their way into it, in an unnamed temporary file: a task holds one record and one batch. Rows in the order of records are read once or twice."""

    def __init__(self, kind: np.dtype, key: str):
        self.kind, self.key, self.parts, self.last = kind, key, [], -1
        self.disk = tempfile.TemporaryFile()

    def add(self, rows: np.ndarray, last: int = -1) -> None:
        self.last = max(self.last, last)
        if len(rows):
            self.parts.append((self.disk.tell(), len(rows), rows[self.key].min(), rows[self.key].max()))
            self.disk.write(rows.tobytes())

    def rows(self, key) -> Iterator[np.ndarray]:
        for offset, n, low, high in self.parts:
            if low <= key <= high:
                self.disk.seek(offset)
                rows = np.frombuffer(self.disk.read(n * self.kind.itemsize), self.kind)
                yield rows[rows[self.key] == key]


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    for batch in batches:
        for name in batch["file"].unique().to_pylist() if batch.num_rows else []:
            yield name, batch.filter(pc.equal(batch["file"], name))


# ---------------------------------------------------------------- raw daily grids
RAW = [("file", pa.string()), ("record", pa.int32()), ("iy", pa.int32()), ("ix", pa.int32()), ("value", pa.float64())]
RAW_SCHEMA = "file string, record int, iy int, ix int, value double"


class RawGrids(DataSource):
    """Fields of ny x nx little-endian 32-bit floats, one after another, a record a field.

    Options: ny, nx; fill (values at or below it are missing, -998 by default); records (a task, 64 by
    default). A file whose size fits no whole number of fields is an error. Writing takes rows of
    (file, record, iy, ix, value), all rows of a file in one partition and best in the order of records, and gives missing cells -999.
    """

    @classmethod
    def name(cls) -> str:
        return "raincask_raw"

    def schema(self) -> str:
        return RAW_SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.ny, self.nx = options["path"], int(options["ny"]), int(options["nx"])
        self.fill, self.records = float(options.get("fill", "-998")), int(options.get("records", "64"))

    def partitions(self) -> list[Part]:
        size, out = 4 * self.ny * self.nx, []
        for path, length in list_files(self.path):
            if length % size:
                raise GridError(f"{path}: {length} bytes are no whole number of {self.ny} x {self.nx} fields")
            out += _ranges(path, length // size, self.records)
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        cells = self.ny * self.nx
        iy, ix = np.divmod(np.arange(cells, dtype=np.int32), np.int32(self.nx))
        for record in range(part.first, part.stop):
            values = np.frombuffer(read_bytes(part.path, 4 * cells * record, 4 * cells), "<f4")
            yield _batch(RAW, [pa.repeat(part.path.rsplit("/", 1)[-1], cells), np.full(cells, record, np.int32), iy, ix, _masked(values, values <= self.fill)])


class RawWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.ny, self.nx = options["path"], int(options["ny"]), int(options["nx"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        kind = np.dtype([("record", "<i8"), ("iy", "<i4"), ("ix", "<i4"), ("value", "<f4")])
        files: dict[str, _Spool] = {}
        for name, batch in _by_file(iterator):
            there = batch["value"].is_valid().to_numpy(zero_copy_only=False)
            rows = np.empty(len(there), kind)
            for c in kind.names:
                rows[c] = batch[c].to_numpy(zero_copy_only=False)
            files.setdefault(name, _Spool(kind, "record")).add(rows[there], int(rows["record"].max()))
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        for name, spool in sorted(files.items()):
            # Written aside and moved, so that a task that runs twice leaves one whole file.
            aside = f"{at}/.{name}-{np.random.default_rng().integers(1 << 62)}"
            with store.open_output_stream(aside) as out:
                for r in range(spool.last + 1):
                    field = np.full((self.ny, self.nx), -999.0, "<f4")
                    for rows in spool.rows(r):
                        field[rows["iy"], rows["ix"]] = rows["value"]
                    out.write(field.tobytes())
            store.move(aside, f"{at}/{name}")
        return WriterCommitMessage()


def raw_sizes(path: str, ny: int, nx: int) -> list[dict]:
    """What sizes alone say of the files under a path: whole fields, bytes left over, and whether the fields are the days of a year."""
    size, out = 4 * ny * nx, []
    for name, length in list_files(path):
        fields, rest = divmod(length, size)
        out.append({"file": name.rsplit("/", 1)[-1], "bytes": length, "fields": fields, "left_over": rest, "whole_year": not rest and fields in (365, 366)})
    return out


# ---------------------------------------------------------------- classic NetCDF
_KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: str
    begin: int
    size: int


@dataclass
class Header:
    """Of a classic file: dimensions (name, length), the record dimension if any, records, attributes, variables, bytes of a record."""

    dims: list[tuple[str, int]]
    record_dim: int | None
    records: int
    attributes: dict
    variables: dict[str, Variable]
    record_bytes: int

    def shape(self, v: Variable) -> list[int]:
        return [self.records if d == self.record_dim else self.dims[d][1] for d in v.dims]


class _Cursor:
    def __init__(self, data: bytes, wide: bool):
        self.data, self.at, self.wide = data, 4, wide

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def place(self) -> int:
        return struct.unpack(">q" if self.wide else ">i", self.take(8 if self.wide else 4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode("utf-8")

    def entries(self, tag: int) -> range:
        found, n = self.number(), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise GridError("a list of the header has another tag than it should")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.entries(_ATTRIBUTE):
            name, kind, n = self.name(), self.number(), self.number()
            raw = self.padded(n * np.dtype(_KINDS[kind]).itemsize)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, _KINDS[kind]).astype(float).tolist()
        return out


def parse_header(data: bytes, length: int) -> Header:
    """The header of a classic file (version 1, or 2 with 64-bit offsets), from its first bytes; EOFError if they are too few."""
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise GridError("not a classic NetCDF file")
    c = _Cursor(data, data[3] == 2)
    records = c.number()
    dims = [(c.name(), c.number()) for _ in c.entries(_DIMENSION)]
    record_dim = next((k for k, (_, n) in enumerate(dims) if n == 0), None)
    attributes, variables = c.attributes(), {}
    for _ in c.entries(_VARIABLE):
        name = c.name()
        ids = [c.number() for _ in range(c.number())]
        own = c.attributes()
        kind, size, begin = _KINDS[c.number()], c.number(), c.place()
        variables[name] = Variable(name, ids, own, kind, begin, size)
    moving = [v for v in variables.values() if v.dims[:1] == [record_dim] and record_dim is not None]
    for v in moving:
        v.size = math.prod(dims[d][1] for d in v.dims[1:]) * np.dtype(v.kind).itemsize
    record_bytes = moving[0].size if len(moving) == 1 else sum(v.size + -v.size % 4 for v in moving)
    if records < 0 and record_bytes:  # a stream: as many as fit
        records = (length - min(v.begin for v in moving)) // record_bytes
    return Header(dims, record_dim, records, attributes, variables, record_bytes)


def read_header(path: str, length: int) -> Header:
    size = 1 << 14
    while True:
        try:
            return parse_header(read_bytes(path, 0, min(size, length)), length)
        except EOFError:
            if size >= length:
                raise GridError(f"{path}: the header is cut off") from None
            size *= 4


def slab(path: str, header: Header, v: Variable, first: int, stop: int) -> np.ndarray:
    """Values of a variable for a range of its first dimension."""
    shape = header.shape(v)
    each = math.prod(shape[1:]) * np.dtype(v.kind).itemsize
    if header.record_dim is not None and v.dims[:1] == [header.record_dim]:
        raw = b"".join(read_bytes(path, v.begin + k * header.record_bytes, each) for k in range(first, stop))
    else:
        raw = read_bytes(path, v.begin + first * each, (stop - first) * each)
    if len(raw) != each * (stop - first):
        raise GridError(f"{path}: {v.name} is cut off")
    return np.frombuffer(raw, v.kind).reshape([stop - first, *shape[1:]])


def unpacked(v: Variable, raw: np.ndarray) -> pa.Array:
    """Scale and offset applied; _FillValue, missing_value and NaN are null."""
    missing = np.zeros(raw.shape, bool)
    for name in ("_FillValue", "missing_value"):
        for fill in v.attributes.get(name, []) if not isinstance(v.attributes.get(name), str) else []:
            missing |= raw == np.array(fill).astype(raw.dtype)
    scale, offset = (v.attributes.get(n, [d])[0] for n, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
    return _masked((raw.astype(np.float64) * scale + offset).ravel(), missing.ravel())


class NetcdfFields(DataSource):
    """A variable of three dimensions (time, y, x) of classic NetCDF files, a row for each value, with its coordinates.

    Options: variable; records (a task, 64 by default). A coordinate is the variable of its dimension's
    name, or the position where there is none. `time` is a number in the units of the file (`time_units`).
    Writing takes the same rows, all rows of a file in one partition and best in the order of time, and makes files of version 2.
    """

    @classmethod
    def name(cls) -> str:
        return "raincask_netcdf"

    def schema(self) -> str:
        return "file string, record int, time double, time_units string, y double, x double, value double"

    def reader(self, schema) -> NetcdfReader:
        return NetcdfReader(self.options)

    def writer(self, schema, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(self.options)


class NetcdfReader(DataSourceReader):
    FIELDS = [("file", pa.string()), ("record", pa.int32()), ("time", pa.float64()), ("time_units", pa.string()), ("y", pa.float64()), ("x", pa.float64()), ("value", pa.float64())]

    def __init__(self, options):
        self.path, self.variable, self.records = options["path"], options["variable"], int(options.get("records", "64"))

    def partitions(self) -> list[Part]:
        out = []
        for path, length in list_files(self.path):
            header = read_header(path, length)
            v = header.variables.get(self.variable)
            if v is None or len(v.dims) != 3:
                raise GridError(f"{path}: no variable {self.variable} of three dimensions")
            out += _ranges(path, header.shape(v)[0], self.records)
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.stop <= part.first:
            return
        header = read_header(part.path, dict(list_files(part.path))[part.path])
        v = header.variables[self.variable]
        axes = []
        for d, n in zip(v.dims, header.shape(v)):
            own = header.variables.get(header.dims[d][0])
            axes.append(slab(part.path, header, own, 0, n).astype(np.float64) if own is not None and own.dims == [d] else np.arange(n, dtype=np.float64))
        of_time = header.variables.get(header.dims[v.dims[0]][0])
        units = of_time.attributes.get("units") if of_time else None
        y, x = (a.ravel() for a in np.meshgrid(axes[1], axes[2], indexing="ij"))
        for record in range(part.first, part.stop):
            n = len(y)
            yield _batch(self.FIELDS, [pa.repeat(part.path.rsplit("/", 1)[-1], n), np.full(n, record, np.int32), np.full(n, axes[0][record]), pa.repeat(pa.scalar(units, pa.string()), n), y, x, unpacked(v, slab(part.path, header, v, record, record + 1))])


def classic_file(variable: str, units: str, time: np.ndarray, y: np.ndarray, x: np.ndarray, values: np.ndarray, attributes: dict[str, str] | None = None) -> bytes:
    """A version-2 classic file of one variable (time, y, x) in doubles, NaN stored as the fill value -999, time being the record dimension."""
    return _classic_head(variable, units, len(time), y, x, attributes) + b"".join(_classic_record(t, v) for t, v in zip(time, values))


def _classic_record(time: float, values: np.ndarray) -> bytes:
    return np.array([time], ">f8").tobytes() + np.where(np.isnan(values), -999.0, values).astype(">f8").tobytes()


def _classic_head(variable: str, units: str, records: int, y: np.ndarray, x: np.ndarray, attributes: dict[str, str] | None = None) -> bytes:
    """All of a classic file that comes before its records."""
    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def listed(tag: int, entries: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if entries else 0, len(entries)) + b"".join(entries)

    def words(name: str, value: str) -> bytes:
        raw = value.encode()
        return text(name) + struct.pack(">ii", 2, len(raw)) + raw + b"\0" * (-len(raw) % 4)

    fill = text("_FillValue") + struct.pack(">iid", 6, 1, -999.0)
    dims = listed(_DIMENSION, [text("time") + struct.pack(">i", 0), text("y") + struct.pack(">i", len(y)), text("x") + struct.pack(">i", len(x))])
    own = [("y", [1], [], 8 * len(y)), ("x", [2], [], 8 * len(x)), ("time", [0], [words("units", units)], 8), (variable, [0, 1, 2], [fill], 8 * len(y) * len(x))]

    def header(begins: list[int]) -> bytes:
        of = [text(name) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + listed(_ATTRIBUTE, own_attributes) + struct.pack(">iiq", 6, size, begin) for (name, ids, own_attributes, size), begin in zip(own, begins)]
        return b"CDF\x02" + struct.pack(">i", records) + dims + listed(_ATTRIBUTE, [words(k, v) for k, v in (attributes or {}).items()]) + listed(_VARIABLE, of)

    start = len(header([0] * 4))
    begins = [start, start + 8 * len(y), start + 8 * (len(y) + len(x)), start + 8 * (len(y) + len(x) + 1)]
    return header(begins) + y.astype(">f8").tobytes() + x.astype(">f8").tobytes()


class NetcdfWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.variable = options["path"], options["variable"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        kind = np.dtype([("time", "<f8"), ("y", "<f8"), ("x", "<f8"), ("value", "<f8")])
        files: dict[str, tuple[_Spool, str, dict]] = {}
        for name, batch in _by_file(iterator):
            rows = np.empty(batch.num_rows, kind)
            for c in kind.names:
                rows[c] = batch[c].cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
            if name not in files:
                files[name] = _Spool(kind, "time"), batch["time_units"][0].as_py() or "", {c: set() for c in kind.names[:3]}
            files[name][0].add(rows)
            for c, found in files[name][2].items():
                found.update(np.unique(rows[c]).tolist())
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        for name, (spool, units, found) in files.items():
            time, y, x = (np.array(sorted(f)) for f in found.values())
            aside = f"{at}/.{name}-{np.random.default_rng().integers(1 << 62)}"
            with store.open_output_stream(aside) as out:
                out.write(_classic_head(self.variable, units, len(time), y, x))
                for t in time:
                    field = np.full((len(y), len(x)), np.nan)
                    for rows in spool.rows(t):
                        field[np.searchsorted(y, rows["y"]), np.searchsorted(x, rows["x"])] = rows["value"]
                    out.write(_classic_record(t, field))
            store.move(aside, f"{at}/{name}")
        return WriterCommitMessage()


def netcdf_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, name, text): all attributes and shapes of the classic files under a path, for `text_evidence`; only headers are read."""
    rows = []
    for at, length in list_files(path):
        header, file = read_header(at, length), at.rsplit("/", 1)[-1]
        for place, values in (("file", header.attributes), *((v.name, v.attributes) for v in header.variables.values())):
            rows += [(file, place, name, text if isinstance(text, str) else " ".join(f"{x:g}" for x in text)) for name, text in values.items()]
        rows += [(file, v.name, "shape", " ".join(f"{header.dims[d][0]}={n}" for d, n in zip(v.dims, header.shape(v)))) for v in header.variables.values()]
    return spark.createDataFrame(rows, "file string, place string, name string, text string")


# ---------------------------------------------------------------- packed messages
#: Hours of a time unit, by its code (fixed values): minute, hour, day, three, six and twelve hours, second.
UNIT_HOURS = {0: 1 / 60, 1: 1.0, 2: 24.0, 10: 3.0, 11: 6.0, 12: 12.0, 13: 1 / 3600}


def _signed(raw: bytes) -> int:
    """A sign bit and a magnitude."""
    n = int.from_bytes(raw, "big")
    top = 1 << (8 * len(raw) - 1)
    return -(n - top) if n >= top else n


def _hours(unit: int, n: int) -> int:
    hours = UNIT_HOURS.get(unit, math.nan) * n
    if not hours == round(hours):
        raise GridError(f"{n} units of code {unit} are no whole hours")
    return round(hours)


@dataclass
class Message:
    """What a message says of itself, and where its sections lie (number -> offset, length; offsets within the message)."""

    offset: int
    length: int
    sections: dict[int, tuple[int, int]]
    discipline: int


def index_messages(data: bytes, path: str = "") -> list[Message]:
    """The edition-2 messages of a file, by their own lengths; what lies between messages is skipped, a message that is cut off is an error."""
    out, at = [], data.find(b"GRIB")
    while at >= 0:
        if len(data) < at + 16 or data[at + 7] != 2:
            raise GridError(f"{path}: not an edition-2 message at {at}")
        length = struct.unpack_from(">Q", data, at + 8)[0]
        if at + length > len(data) or data[at + length - 4 : at + length] != b"7777":
            raise GridError(f"{path}: the message at {at} is cut off")
        sections, k = {}, 16
        while k < length - 4:
            size, number = struct.unpack_from(">IB", data, at + k)
            if size < 5 or k + size > length - 4 or number in sections:
                raise GridError(f"{path}: the message at {at} has a section of a wrong size, or twice")
            sections[number] = (k, size)
            k += size
        out.append(Message(at, length, sections, data[at + 6]))
        at = data.find(b"GRIB", at + length)
    return out


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    """n unsigned numbers of `bits` bits each, the first bit first."""
    if bits == 0:
        return np.zeros(n, np.int64)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    return flat.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def decode(data: bytes, m: Message) -> dict:
    """Numbers, times, grid and values of a message on a latitude-longitude grid in simple packing."""
    at = lambda section, byte, size: data[m.offset + m.sections[section][0] + byte - 1 :][:size]  # noqa: E731  bytes count from 1, as in the format's tables
    number = lambda section, byte, size: int.from_bytes(at(section, byte, size), "big")
    missing = {1, 3, 4, 5, 6, 7} - set(m.sections)
    if missing:
        raise GridError(f"a message lacks sections {sorted(missing)}")
    if number(3, 13, 2) != 0 or number(5, 10, 2) != 0:
        raise GridError("only latitude-longitude grids in simple packing are read")
    y, mo, d, h, mi, s = (number(1, 13, 2), *(number(1, k, 1) for k in (15, 16, 17, 18, 19)))
    reference = dt.datetime(y, mo, d, h, mi, s)
    product = number(4, 8, 2)
    start = end = _hours(number(4, 18, 1), number(4, 19, 4))
    if product == 8:  # an interval: its length is in the message, and so is its end, which has to agree
        end = start + _hours(number(4, 49, 1), number(4, 50, 4))
        told = dt.datetime(number(4, 35, 2), *(number(4, k, 1) for k in (37, 38, 39, 40, 41)))
        if told != reference + dt.timedelta(hours=end):
            raise GridError("a message's end of interval is not its start and length")
    nx, ny = number(3, 31, 4), number(3, 35, 4)
    lat1, lon1, lat2, lon2 = (_signed(at(3, k, 4)) / 1e6 for k in (47, 51, 56, 60))
    flags = number(3, 72, 1)
    if flags & 0b0011_0000:
        raise GridError("only grids that scan by rows, each in the same direction, are read")
    lat = np.linspace(lat1, lat2, ny) if ny > 1 else np.array([lat1])
    lon = np.linspace(lon1, lon2 + (360 if lon2 < lon1 and not flags & 128 else 0), nx) if nx > 1 else np.array([lon1])
    reference_value = struct.unpack(">f", at(5, 12, 4))[0]
    scale, decimals, bits = _signed(at(5, 16, 2)), _signed(at(5, 18, 2)), number(5, 20, 1)
    there = np.ones(nx * ny, bool)
    if number(6, 6, 1) == 0:
        there = np.unpackbits(np.frombuffer(at(6, 7, m.sections[6][1] - 6), np.uint8), count=nx * ny).astype(bool)
    elif number(6, 6, 1) != 255:
        raise GridError("only bit maps of the message itself are read")
    values = np.zeros(nx * ny)
    packed = unpack_bits(at(7, 6, m.sections[7][1] - 5), bits, int(there.sum()))
    if number(5, 6, 4) != there.sum():
        raise GridError("a message has another number of values than its bit map")
    values[there] = (reference_value + packed * 2.0**scale) / 10.0**decimals
    return {
        "discipline": m.discipline, "category": number(4, 10, 1), "number": number(4, 11, 1), "level_type": number(4, 23, 1), "reference": reference, "start_hour": start, "end_hour": end,
        "product": product, "process": number(4, 47, 1) if product == 8 else None, "lat": np.repeat(lat, nx), "lon": np.tile(lon, ny), "values": values, "there": there,
    }


MESSAGE_SCHEMA = "file string, message int, discipline int, category int, number int, level_type int, process int, reference timestamp_ntz, start_hour int, end_hour int, lat double, lon double, value double"


class PackedMessages(DataSource):
    """Edition-2 messages on latitude-longitude grids in simple packing, a row for each grid point.

    Options: keep (`discipline/category/number`, all by default), messages (a task, 16 by default). The
    interval a field covers comes from the message and never from a file's name.
    """

    @classmethod
    def name(cls) -> str:
        return "raincask_messages"

    def schema(self) -> str:
        return MESSAGE_SCHEMA

    def reader(self, schema) -> MessageReader:
        return MessageReader(self.options)


class MessageReader(DataSourceReader):
    FIELDS = [("file", pa.string()), *((c, pa.int32()) for c in ("message", "discipline", "category", "number", "level_type", "process")), ("reference", pa.timestamp("us")), ("start_hour", pa.int32()), ("end_hour", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("value", pa.float64())]

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("messages", "16"))
        self.keep = tuple(int(x) for x in options["keep"].split("/")) if options.get("keep") else None

    def partitions(self) -> list[Part]:
        out = []
        for path, length in list_files(self.path):
            at, count = 0, 0
            while at + 16 <= length:  # from message to message, sixteen bytes each
                head = read_bytes(path, at, 16)
                if head[:4] != b"GRIB":
                    raise GridError(f"{path}: no message at {at}")
                at, count = at + struct.unpack(">Q", head[8:])[0], count + 1
            out += _ranges(path, count, self.most)
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.stop <= part.first:
            return
        at = 0
        for k in range(part.stop):
            head = read_bytes(part.path, at, 16)
            length = struct.unpack(">Q", head[8:])[0]
            if k >= part.first:
                data = read_bytes(part.path, at, length)
                (m,) = index_messages(data, part.path)
                got = decode(data, m)
                if self.keep in (None, (got["discipline"], got["category"], got["number"])):
                    n = len(got["values"])
                    same = [np.full(n, got[c] if got[c] is not None else -1, np.int32) for c in ("discipline", "category", "number", "level_type", "process")]
                    yield _batch(self.FIELDS, [pa.array([part.path.rsplit("/", 1)[-1]] * n), np.full(n, k, np.int32), *same, pa.array([got["reference"]] * n, pa.timestamp("us")), np.full(n, got["start_hour"], np.int32), np.full(n, got["end_hour"], np.int32), got["lat"], got["lon"], _masked(got["values"], ~got["there"])])
            at += length


def register(spark: SparkSession) -> None:
    for source in (RawGrids, NetcdfFields, PackedMessages):
        spark.dataSource.register(source)
