"""Image files: round trips, byte orders, strips, contiguous stacks, natural order."""

import struct

import numpy as np
import pytest

from spotlattice.operators import imaging
from spotlattice.sources import tiff


def page(order, img, strips, description=b""):
    """A file of one page in another layout than the writer's."""
    data = img.astype(img.dtype.newbyteorder(order)).tobytes()
    height, width = img.shape
    rows = -(-height // strips)
    size = rows * width * img.itemsize
    parts = [data[k : k + size] for k in range(0, len(data), size)]
    body, places = b"", []
    for x in parts:
        places.append(8 + len(body))
        body += x
    kind = {"u": 1, "i": 2, "f": 3}[img.dtype.kind]
    tags = [(256, 3, (width,)), (257, 3, (height,)), (258, 3, (img.itemsize * 8,)), (259, 3, (1,)), (270, 2, description + b"\0"), (273, 4, places), (277, 3, (1,)), (279, 4, [len(x) for x in parts]), (339, 3, (kind,))]
    at = 8 + len(body)
    extra, entries, far = b"", b"", at + 2 + 12 * len(tags) + 4
    for t, k, v in tags:
        code = {2: "s", 3: "H", 4: "I"}[k]
        raw = bytes(v) if k == 2 else struct.pack(f"{order}{len(v)}{code}", *v)
        n = len(v)
        if len(raw) > 4:
            entries += struct.pack(order + "HHII", t, k, n, far + len(extra))
            extra += raw
        else:
            entries += struct.pack(order + "HHI", t, k, n) + raw.ljust(4, b"\0")
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "u4", "f4"])
def test_layouts(order, kind):
    img = np.arange(7 * 5).reshape(7, 5).astype(kind)
    for strips in (1, 2, 7):
        assert np.array_equal(next(tiff.pages(page(order, img, strips))), img.astype("f4"))


def test_contiguous_stack():
    img = np.arange(12, dtype="u2").reshape(3, 4)
    data = page("<", np.vstack([img, img + 100, img + 200]), 1, b"Stack=1\nimages=3\n")
    data = data.replace(struct.pack("<HHIH", 257, 3, 1, 9), struct.pack("<HHIH", 257, 3, 1, 3))
    assert [int(x[0, 0]) for x in tiff.pages(data)] == [0, 100, 200]


def test_refusals():
    with pytest.raises(ValueError):
        next(tiff.pages(b"GIF89a.."))
    squeezed = page("<", np.zeros((2, 2), "u1"), 1).replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 5))
    with pytest.raises(ValueError):
        next(tiff.pages(squeezed))


def test_series(spark, tmp_path):
    frames = imaging.simulate(spark, 23)[0]
    assert tiff.write(frames, str(tmp_path / "out"), each=5) == 23
    back = tiff.read(spark, str(tmp_path / "out"))
    assert sorted((r.frame, r.width, r.height, tuple(r.pixels)) for r in back.collect()) == sorted((r.frame, r.width, r.height, tuple(r.pixels)) for r in frames.collect())
    folder = tmp_path / "natural"
    folder.mkdir()
    for k in (1, 2, 10):
        (folder / f"img{k}.tif").write_bytes(page("<", np.full((2, 2), k, "u1"), 1))
    assert [r.pixels[0] for r in tiff.read(spark, str(folder)).orderBy("frame").collect()] == [1, 2, 10]
