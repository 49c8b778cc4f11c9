"""The tagged spot file: a header with the place of the list's description, then length-delimited protobuf messages.

A file is read by one task, which gets files up to the size of an input partition at once (files of up to 2 GB; a dataset
is a folder of them), and written by one task per partition.
"""

from __future__ import annotations

import io
import struct
import uuid

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: a spot's fields by number, with name and kind; then the list's.
SPOT = {
    1: ("molecule", "int"), 2: ("channel", "int"), 3: ("frame", "int"), 4: ("slice", "int"), 5: ("pos", "int"), 7: ("x", "float"), 8: ("y", "float"), 9: ("z", "float"),
    10: ("intensity", "float"), 11: ("background", "float"), 12: ("width", "float"), 13: ("a", "float"), 14: ("theta", "float"), 19: ("fluorophore_type", "int"), 20: ("cluster", "int"),
    107: ("x_position", "int"), 108: ("y_position", "int"), 1500: ("error", "double"), 1501: ("noise", "float"), 1503: ("end_frame", "int"), 1504: ("original_value", "float"),
    1506: ("mean_intensity", "float"), 1507: ("category", "int"),
}
LIST = {1: "application_id", 7: "pixel_size", 8: "nr_spots", 22: "location_units", 23: "intensity_units"}
NAMES = {name: (number, kind) for number, (name, kind) in SPOT.items()}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in SPOT.values())
WIRE = {"int": 0, "double": 1, "float": 5}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def encode(number: int, kind: str, value) -> bytes:
    body = _varint(int(value)) if kind == "int" else struct.pack("<d" if kind == "double" else "<f", value)
    return _varint(number << 3 | WIRE[kind]) + body


def decode(message: memoryview) -> dict[int, float]:
    """Field number -> last value; other wire types are stepped over."""
    at, out = 0, {}
    while at < len(message):
        tag, at = _read_varint(message, at)
        wire = tag & 7
        if wire == 0:
            v, at = _read_varint(message, at)
            out[tag >> 3] = v - (1 << 64) if v >> 63 else v
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            out[tag >> 3] = struct.unpack_from("<d" if wire == 1 else "<f", message, at)[0]
            at += n
        elif wire == 2:
            n, at = _read_varint(message, at)
            at += n
        else:
            raise ValueError(f"wire type {wire}")
    return out


def spots(data: bytes):
    """The spots of a file as tuples in the schema's order; a file without a finished header has none."""
    view = memoryview(data)
    if len(view) < 12:
        return
    magic, offset = struct.unpack_from(">iq", view)
    if magic != 0:
        raise ValueError("not a tagged spot file")
    at, end = 12, 12 + offset
    while at < end:
        n, at = _read_varint(view, at)
        have = decode(view[at : at + n])
        at += n
        yield tuple(have.get(k) for k in SPOT)


def read(spark: SparkSession, path: str, channel: int = 1, slice_: int = 1, pos: int = 1, fluorophore: int = 1) -> DataFrame:
    """The spots of one channel, slice, position and fluorophore (all from 1; absent fields count as 1)."""

    def run(batches):
        for files in batches:
            for data in files["content"]:
                rows: list[tuple] = []
                for s in spots(bytes(data)):
                    rows.append(s)
                    if len(rows) == 20_000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[n for n, _ in SPOT.values()])
        return out.astype({n: "Int32" if k == "int" else "float64" for n, k in SPOT.values()})

    files = spark.read.format("binaryFile").load(path).select("content")
    every = files.mapInPandas(run, SCHEMA)
    picks = {"channel": channel, "slice": slice_, "pos": pos, "fluorophore_type": fluorophore}
    return every.where(" AND ".join(f"coalesce({c}, 1) = {v}" for c, v in picks.items()))


def write(df: DataFrame, folder: str, pixel_size: float = 100.0) -> int:
    """One file a partition in a folder that all executors share; returns the spots written.  Columns outside the format
    are left out, nulls are absent.  A file is renamed into place when whole, so a task run again leaves no half file."""
    names = [c for c in df.columns if c in NAMES]

    def run(batches):
        body, n = io.BytesIO(), 0
        for rows in batches:
            for r in rows.itertuples(index=False):
                n += 1
                have = {"molecule": n, "channel": 1, "fluorophore_type": 1} | {k: v for k, v in zip(names, r, strict=True) if not pd.isna(v)}
                spot = b"".join(encode(*NAMES[k], v) for k, v in have.items())
                body.write(_varint(len(spot)) + spot)
        about = b"".join([encode(1, "int", 4), encode(7, "float", pixel_size), encode(8, "int", n), encode(22, "int", 2), encode(23, "int", 0)])
        store, inside = fs.FileSystem.from_uri(folder)
        store.create_dir(inside, recursive=True)
        held = f"{inside}/_{uuid.uuid4().hex}"
        with store.open_output_stream(held) as f:
            f.write(struct.pack(">iq", 0, body.tell()) + body.getvalue() + _varint(len(about)) + about)
        store.move(held, f"{inside}/part-{TaskContext.get().partitionId():05d}.tsf")
        yield pd.DataFrame({"n": [n]})

    return sum(r["n"] for r in df.select(*names).mapInPandas(run, "n long").collect())
