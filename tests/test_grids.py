"""Readers of raw grids, classic NetCDF and packed messages against files made here byte by byte."""

import datetime as dt
import struct
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincask.sources import grids as G
from raincask.sources.profile import text_evidence


@pytest.fixture(scope="module")
def sources(spark):
    G.register(spark)
    return spark


def folder():
    return tempfile.mkdtemp(prefix="raincask-grids-")


def test_raw_grids_come_back(sources):
    rng = np.random.default_rng(1)
    fields = {name: rng.gamma(1.0, 9.0, (n, 4, 6)).astype("<f4") for name, n in (("rain_2001.grd", 11), ("rain_2002.grd", 3))}
    for f in fields.values():
        f[rng.random(f.shape) < 0.2] = -999.0
    where = folder()
    for name, f in fields.items():
        Path(where, name).write_bytes(f.tobytes())
    read = sources.read.format("raincask_raw").options(ny="4", nx="6", records="4").load(where)
    assert read.rdd.getNumPartitions() == 4  # three ranges of the longer file, one of the other
    got = {(r.file, r.record, r.iy, r.ix): r.value for r in read.collect()}
    want = {(name, k, y, x): None if f[k, y, x] == -999 else float(f[k, y, x]) for name, f in fields.items() for k in range(len(f)) for y in range(4) for x in range(6)}
    assert got == want
    out = folder() + "/again"
    read.repartition("file").write.format("raincask_raw").options(ny="4", nx="6").mode("append").save(out)
    assert all(Path(out, name).read_bytes() == f.tobytes() for name, f in fields.items())
    assert G.raw_sizes(where, 4, 6)[0] == {"file": "rain_2001.grd", "bytes": 11 * 96, "fields": 11, "left_over": 0, "whole_year": False}


def test_raw_sizes_that_fit_no_field_are_an_error(sources):
    where = folder()
    Path(where, "a.grd").write_bytes(b"\0" * 100)
    with pytest.raises(Exception, match="no whole number"):
        sources.read.format("raincask_raw").options(ny="4", nx="6").load(where).count()
    assert G.raw_sizes(where, 4, 6)[0]["left_over"] == 4


def classic_by_hand(version=1, records=2):
    """A file with a record variable of shorts (scale, offset, fill), one of bytes that needs padding, and fixed coordinates."""
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    place = lambda n: struct.pack(">q" if version == 2 else ">i", n)
    words = lambda k, v: text(k) + struct.pack(">ii", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    raw = np.array([[[1, 2, -9], [4, 5, 6]], [[7, -9, 9], [10, 11, 12]]], ">i2")[:records]

    def header(begins):
        dims = struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0) + text("lat") + struct.pack(">i", 2) + text("lon") + struct.pack(">i", 3)
        attributes = struct.pack(">ii", 12, 1) + words("note", "24h rain ending 0300 UTC")
        scale = text("scale_factor") + struct.pack(">iif", 5, 1, 0.5) + text("add_offset") + struct.pack(">iif", 5, 1, 1.0) + text("_FillValue") + struct.pack(">iih", 3, 1, -9) + b"\0\0"
        variables = [
            text("lat") + struct.pack(">ii", 1, 1) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 5, 8) + place(begins[0]),
            text("time") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 12, 1) + words("units", "days since 2000-01-01") + struct.pack(">ii", 6, 8) + place(begins[1]),
            text("rain") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 12, 3) + scale + struct.pack(">ii", 3, 12) + place(begins[2]),
            text("flag") + struct.pack(">iii", 2, 0, 2) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 1, 4) + place(begins[3]),
        ]
        return b"CDF" + bytes([version]) + struct.pack(">i", records) + dims + attributes + struct.pack(">ii", 11, 4) + b"".join(variables)

    n = len(header([0] * 4))
    body = np.array([10.0, 20.0], ">f4").tobytes() + b"".join(struct.pack(">d", 5 + k) + raw[k].tobytes() + bytes([k, k, k, 0]) for k in range(records))
    return header([n, n + 8, n + 16, n + 28]) + body, raw


@pytest.mark.parametrize("version", [1, 2])
def test_classic_files_come_back(sources, version):
    data, raw = classic_by_hand(version)
    where = folder()
    Path(where, "a.nc").write_bytes(data)
    header = G.parse_header(data, len(data))
    assert header.record_bytes == 8 + 12 + 4 and header.shape(header.variables["rain"]) == [2, 2, 3]
    got = {(r.record, r.time, r.y, r.x): r.value for r in sources.read.format("raincask_netcdf").options(variable="rain", records="1").load(where).collect()}
    want = {(k, 5.0 + k, 10.0 * (1 + i), float(j)): None if raw[k, i, j] == -9 else raw[k, i, j] * 0.5 + 1 for k in range(2) for i in range(2) for j in range(3)}
    assert got == want
    assert {r.value for r in sources.read.format("raincask_netcdf").options(variable="rain").load(where).where("record = 1 AND y = 20").collect()} == {6.0, 6.5, 7.0}
    attributes = G.netcdf_attributes(sources, where)
    assert {(r.place, r.name, r.text) for r in attributes.collect()} >= {("file", "note", "24h rain ending 0300 UTC"), ("time", "units", "days since 2000-01-01"), ("rain", "shape", "time=2 lat=2 lon=3"), ("rain", "scale_factor", "0.5")}
    assert [(r.place, r.name) for r in text_evidence(attributes).collect()] == [("file", "note")]


def test_broken_classic_files_are_errors(sources):
    data, _ = classic_by_hand()
    for bad, told in ((data[:40], "cut off"), (b"HDF5" + data[4:], "not a classic"), (data[:-20], "cut off")):
        where = folder()
        Path(where, "a.nc").write_bytes(bad)
        with pytest.raises(Exception, match=told):
            sources.read.format("raincask_netcdf").options(variable="rain").load(where).count()
    where = folder()
    Path(where, "a.nc").write_bytes(data)
    with pytest.raises(Exception, match="no variable"):
        sources.read.format("raincask_netcdf").options(variable="flag").load(where).count()


def message(values, there=None, bits=11, scale=-2, decimals=1, reference=100.0, when=dt.datetime(2024, 6, 1), hours=(3, 27), number=8, ny=2, nx=3, total=True):
    """An edition-2 message; values are packed numbers of `bits` bits."""
    size = lambda n, body: struct.pack(">IB", len(body) + 5, n) + body
    signed = lambda n, width: (abs(n) | (1 << (8 * width - 1) if n < 0 else 0)).to_bytes(width, "big")
    end = when + dt.timedelta(hours=hours[1])
    one = size(1, struct.pack(">HHBBBHBBBBBBB", 7, 0, 2, 1, 1, when.year, when.month, when.day, when.hour, 0, 0, 0, 1))
    three = size(3, b"\0" + struct.pack(">IBBH", ny * nx, 0, 0, 0) + bytes([6]) + b"\0" * 15 + struct.pack(">II", nx, ny) + b"\0" * 8 + signed(-10_000_000, 4) + signed(70_000_000, 4) + bytes([48]) + signed(10_000_000, 4) + signed(71_000_000, 4) + struct.pack(">II", 500_000, 20_000_000) + bytes([0x40]))
    four = size(4, struct.pack(">HHBBBBBHBBI", 0, number, 1, 8, 2, 0, 0, 0, 0, 1, hours[0]) + bytes([1, 0]) + b"\0" * 4 + bytes([255, 0]) + b"\0" * 4 + struct.pack(">HBBBBBBIBBBIBI", end.year, end.month, end.day, end.hour, 0, 0, 1, 0, 1, 2, 1, hours[1] - hours[0], 255, 0))
    kept = values if there is None else [v for v, t in zip(values, there) if t]
    five = size(5, struct.pack(">IHf", len(kept), 0, reference) + signed(scale, 2) + signed(decimals, 2) + bytes([bits, 0]))
    six = size(6, bytes([255]) if there is None else bytes([0]) + np.packbits(np.array(there, np.uint8)).tobytes())
    packed = "".join(f"{v:0{bits}b}" for v in kept) if bits else ""
    seven = size(7, int(packed.ljust(-(-len(packed) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(packed) // 8), "big") if packed else b"")
    body = one + three + four + five + six + seven + b"7777"
    return b"GRIB\0\0" + bytes([0, 2]) + struct.pack(">Q", 16 + len(body)) + body


def test_messages_decode_exactly(sources):
    rng = np.random.default_rng(2)
    packed = [rng.integers(0, 2**b, 6).tolist() for b in (11, 1, 24)]
    there = [True, False, True, True, False, True]
    where = folder()
    Path(where, "a.grb2").write_bytes(message(packed[0]) + message(packed[1], there, bits=1, scale=0, decimals=0, reference=2.0, hours=(0, 3)) + message(packed[2], bits=24, hours=(6, 9)) + message([0] * 6, bits=0))
    got = sources.read.format("raincask_messages").options(messages="1").load(where).orderBy("message", F.desc("lat"), "lon").collect()
    assert len(got) == 24 and {(r.message, r.start_hour, r.end_hour) for r in got} == {(0, 3, 27), (1, 0, 3), (2, 6, 9), (3, 3, 27)}
    assert {(r.discipline, r.category, r.number, r.process) for r in got} == {(0, 1, 8, 1)} and {r.reference for r in got} == {dt.datetime(2024, 6, 1)}
    cells = [(la, lo) for la in (-10.0, 10.0) for lo in (70.0, 70.5, 71.0)]
    value = {(r.message, r.lat, r.lon): r.value for r in got}
    for k, (scale, decimals, reference, mask) in enumerate([(-2, 1, 100.0, None), (0, 0, 2.0, there), (-2, 1, 100.0, None)]):
        for c, x in enumerate(packed[k]):
            want = None if mask and not mask[c] else (reference + x * 2.0**scale) / 10**decimals
            assert value[(k, *cells[c])] == want
    assert all(value[(3, *c)] == 10.0 for c in cells)
    assert sources.read.format("raincask_messages").options(keep="0/1/7").load(where).count() == 0


def test_wrong_messages_are_errors():
    good = message([1, 2, 3, 4, 5, 6])
    for bad, told in ((good[:-6], "cut off"), (good[:7] + b"\1" + good[8:], "edition"), (good[:-4] + b"7778", "cut off")):
        with pytest.raises(G.GridError, match=told):
            G.index_messages(bad)
    (m,) = G.index_messages(good)
    four = m.sections[4][0]
    wrong = bytearray(good)
    wrong[four + 37 - 1] += 1  # the end's month no longer agrees with start and length
    with pytest.raises(G.GridError, match="end of interval"):
        G.decode(bytes(wrong), m)
    with pytest.raises(G.GridError, match="whole hours"):
        G._hours(0, 90)
