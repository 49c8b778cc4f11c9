"""Image series from uncompressed TIFF files, and back: one row a page, numbered through the files in natural order.

A page is a directory of tags that say where its strips lie.  Stacks beyond 4 GB are often written with one directory whose
description tells how many images follow each other; those are read too.  A file is read by one task (at most 2 GB), its
pages leave one by one.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tags that are read, bytes of the value types, the sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, BYTE_COUNTS, FORMAT = 256, 257, 258, 259, 270, 273, 277, 279, 339
SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4)}
KINDS = {1: "u", 2: "i", 3: "f"}
SCHEMA = "frame int, width int, height int, pixels array<float>"


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in SIZES:
                code, size = SIZES[kind]
                place = at + 10 + 12 * k
                if size * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The images of a file as float arrays; ValueError for compressed pages or several samples a pixel."""
    found = list(directories(data))
    for order, tags in found:
        one = lambda t, default: tags.get(t, (default,))[0]  # noqa: B023, E731
        if one(COMPRESSION, 1) != 1 or one(SAMPLES, 1) != 1:
            raise ValueError("only uncompressed pages of one sample a pixel are read")
        width, height, bits = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 8)
        kind = np.dtype(f"{order}{KINDS[one(FORMAT, 1)]}{bits // 8}")
        size = width * height * kind.itemsize
        about = b"".join(tags.get(DESCRIPTION, ())).decode("latin-1")
        more = re.search(r"^images=(\d+)", about, re.M)
        if len(found) == 1 and more and int(more[1]) > 1:  # images follow each other after the first
            for k in range(int(more[1])):
                yield np.frombuffer(data, kind, width * height, tags[OFFSETS][0] + k * size).reshape(height, width).astype(np.float32)
            return
        strips = [data[a : a + n] for a, n in zip(tags[OFFSETS], tags.get(BYTE_COUNTS, (size,)), strict=True)]
        yield np.frombuffer(b"".join(strips)[:size], kind).reshape(height, width).astype(np.float32)


def _natural(path: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", path)]


def read(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """(frame, width, height, pixels) of the pages of all files; files in natural order of their paths, frames from ``first``.

    The files are read twice, for their numbers of pages and for the pages; the driver gets one number a file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def count(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n = sum(1 for _ in pages(batch.column(1)[k].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([n], pa.int64())], ["path", "n"])

    counts = sorted(files.mapInArrow(count, "path string, n long").collect(), key=lambda r: _natural(r["path"]))
    start, before = {}, first
    for r in counts:
        start[r["path"]] = before
        before += r["n"]

    def draw(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at = start[batch.column(0)[k].as_py()]
                for n, img in enumerate(pages(batch.column(1)[k].as_py())):
                    sizes = [pa.array([v], pa.int32()) for v in (at + n, img.shape[1], img.shape[0])]
                    yield pa.RecordBatch.from_arrays([*sizes, pa.array([img.ravel()], pa.list_(pa.float32()))], ["frame", "width", "height", "pixels"])

    return files.mapInArrow(draw, SCHEMA)


def encode(images: list[np.ndarray]) -> bytes:
    """One file of 32-bit pages, a strip each."""
    out, last = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for img in images:
        body = np.ascontiguousarray(img, "<f4").tobytes()
        place = len(out)
        out += body
        struct.pack_into("<I", out, last, len(out))
        height, width = img.shape
        tags = [(WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, 32), (COMPRESSION, 3, 1), (OFFSETS, 4, place), (SAMPLES, 3, 1), (BYTE_COUNTS, 4, len(body)), (FORMAT, 3, 3)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        last = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def write(df: DataFrame, folder: str, each: int = 100) -> int:
    """Frames as files of up to ``each`` pages in a folder that all executors reach; the number of pages written."""

    def run(batches):
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(folder)
        store.create_dir(inside, recursive=True)
        block, held, n = None, [], 0

        def put() -> None:
            if held:
                with store.open_output_stream(f"{inside}/_{block}.tmp") as out:
                    out.write(encode(held))
                store.move(f"{inside}/_{block}.tmp", f"{inside}/frames-{block:08d}.tif")

        for batch in batches:
            for k in range(batch.num_rows):
                b, _, width, height, pixels = (c[k].as_py() for c in batch.columns)
                if b != block:
                    put()
                    block, held = b, []
                held.append(np.array(pixels, "f4").reshape(height, width))
                n += 1
        put()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    keyed = df.select(F.floor((F.col("frame") - 1) / each).alias("_b"), "frame", "width", "height", "pixels")
    return keyed.repartition("_b").sortWithinPartitions("_b", "frame").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
