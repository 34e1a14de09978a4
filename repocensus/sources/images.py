"""Images: PNG files to runs of pixels, and what the measurements of pages need of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first bytes of a file, and the channels of each colour type.
SIGNATURE, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of an image that a task will hold; a larger one is reported, not read.
MOST_PIXELS = 1 << 26


def chunks(data: bytes):
    """(kind, body) of each chunk, up to the end or where the file breaks off."""
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def unfiltered(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes with their filters taken back; ``step``: bytes to the pixel at the left."""
    rows = raw.reshape(height, stride + 1)
    out, before = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, row = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            now = row
        elif kind == 1:
            now = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = row + before
        elif kind in (3, 4):
            now = _from_left(row.tolist(), before.tolist(), step, kind)
        else:
            raise ValueError(f"a filter of kind {kind}")
        out[y] = before = now
    return out


def _from_left(row: list[int], up: list[int], step: int, kind: int) -> np.ndarray:
    """The two filters that need the bytes at the left, which are only just known."""
    now = [0] * step + row
    for i, x in enumerate(row):
        left, above, corner = now[i], up[i], up[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + above) >> 1
        else:
            base = left + above - corner
            _, _, guess = min((abs(base - left), 0, left), (abs(base - above), 1, above), (abs(base - corner), 2, corner))
        now[i + step] = (x + guess) & 255
    return np.array(now[step:], np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Red, green, blue and alpha of a PNG, a byte each, (height, width, 4). ValueError says why it can't be read.

    All colour types and depths, of 16 bits the upper eight; palettes and single transparent colours. Interlaced images aren't read.
    """
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise ValueError("not a PNG")
    found: dict[bytes, bytes] = {}
    for kind, body in chunks(data):
        found[kind] = found.get(kind, b"") + body if kind == b"IDAT" else found.get(kind, body)
    if len(found.get(b"IHDR", b"")) != 13 or b"IDAT" not in found:
        raise ValueError("no header or no pixels")
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", found[b"IHDR"])
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or laced:
        raise ValueError("interlaced" if laced else f"colour type {colour} of {depth} bits")
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError(f"{width} by {height} pixels")
    n = CHANNELS[colour]
    stride = (width * n * depth + 7) // 8
    try:
        raw = zlib.decompressobj().decompress(found[b"IDAT"], height * (stride + 1))
    except zlib.error as e:
        raise ValueError("broken pixels") from e
    if len(raw) < height * (stride + 1):
        raise ValueError("fewer pixels than the header says")
    rows = unfiltered(np.frombuffer(raw, np.uint8), height, stride, max(1, n * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
    values = rows[:, : width * n].reshape(height, width, n)
    out = np.full((height, width, 4), 255, np.uint8)
    clear = found.get(b"tRNS", b"")
    if colour == 3:
        table = np.full((256, 4), 255, np.uint8)
        colours = np.frombuffer(found.get(b"PLTE", b"")[: 256 * 3], np.uint8)
        colours = colours[: len(colours) // 3 * 3].reshape(-1, 3)
        table[: len(colours), :3] = colours
        table[: len(clear[:256]), 3] = np.frombuffer(clear[:256], np.uint8)
        return table[values[:, :, 0]]
    grey = values[:, :, :1].astype(np.uint16) * 255 // ((1 << min(depth, 8)) - 1) if colour in (0, 4) else values[:, :, :3]
    out[:, :, :3] = grey
    if colour in (4, 6):
        out[:, :, 3] = values[:, :, -1]
    elif clear and depth <= 8:
        hidden = np.frombuffer(clear, ">u2")[: values.shape[2]]
        out[(values == hidden).all(axis=2), 3] = 0
    return out


def encode(rgba: np.ndarray, colour: int = 6, filters: tuple[int, ...] = (0,)) -> bytes:
    """A PNG of eight bits from (height, width, 4) bytes, in colour type 0, 2, 3 or 6; rows take the filters (0 to 4) in turn."""
    height, width, _ = rgba.shape
    extra = b""
    if colour == 3:
        table, places = np.unique(rgba.reshape(-1, 4), axis=0, return_inverse=True)
        rows = places.reshape(height, width).astype(np.uint8)
        extra = _chunk(b"PLTE", table[:, :3].tobytes()) + _chunk(b"tRNS", table[:, 3].tobytes())
    else:
        rows = rgba[:, :, : CHANNELS[colour]].reshape(height, -1)
    step, body, before = CHANNELS[colour], b"", np.zeros(rows.shape[1], np.int16)
    for y in range(height):
        row, kind = rows[y].astype(np.int16), filters[y % len(filters)]
        left = np.concatenate([np.zeros(step, np.int16), row[:-step]])
        corner = np.concatenate([np.zeros(step, np.int16), before[:-step]])
        base = left + before - corner
        away = np.stack([np.abs(base - x) for x in (left, before, corner)])
        nearest = np.choose(away.argmin(axis=0), [left, before, corner])
        guess = (0 * row, left, before, (left + before) >> 1, nearest)[kind]
        body += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + extra + _chunk(b"IDAT", zlib.compress(body)) + _chunk(b"IEND", b"")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def read_images(files: DataFrame) -> DataFrame:
    """(path, content), as ``binaryFile`` gives them, to (image, width, height, why, y, x, n, rgb, opaque): a row for each run of equal pixels in a
    row of an image, opaque from half an alpha on. An image that can't be read has one row, with why; null content too.

    Pixels never leave the task that decodes them, only runs do.
    """

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    px = decode(data.as_py() or b"")
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"image": path, "why": str(e)}], schema=schema)
                    continue
                height, width, _ = px.shape
                code = (px[:, :, 0].astype(np.int64) << 16) | (px[:, :, 1].astype(np.int64) << 8) | px[:, :, 2] | ((px[:, :, 3] >= 128).astype(np.int64) << 24)
                new = np.ones((height, width), bool)
                new[:, 1:] = code[:, 1:] != code[:, :-1]
                y, x = np.nonzero(new)
                n = np.diff(np.append(y * width + x, height * width))
                kinds, back = np.unique(code[y, x], return_inverse=True)
                names = pa.array([f"#{c & 0xFFFFFF:06x}" for c in kinds.tolist()]).take(pa.array(back))
                for low in range(0, len(y), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    size = len(y[part])
                    cols = [pa.array([path] * size, pa.string()), pa.array(np.full(size, width), pa.int32()), pa.array(np.full(size, height), pa.int32()), pa.nulls(size, pa.string()), pa.array(y[part], pa.int32()), pa.array(x[part], pa.int32()), pa.array(n[part], pa.int64()), names.slice(low, size), pa.array(kinds[back[part]] >> 24 > 0)]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)

    types = {"image": pa.string(), "width": pa.int32(), "height": pa.int32(), "why": pa.string(), "y": pa.int32(), "x": pa.int32(), "n": pa.int64(), "rgb": pa.string(), "opaque": pa.bool_()}
    schema = pa.schema(types)
    return files.select("path", "content").mapInArrow(run, "image string, width int, height int, why string, y int, x int, n long, rgb string, opaque boolean")


def edge_pixels(runs: DataFrame) -> DataFrame:
    """(image, rgb, n): opaque pixels at the four edges; corners lie at two."""
    n = F.when(F.col("y") == 0, F.col("n")).otherwise(0) + F.when(F.col("y") == F.col("height") - 1, F.col("n")).otherwise(0) + (F.col("x") == 0).cast("int") + (F.col("x") + F.col("n") == F.col("width")).cast("int")
    return runs.filter("opaque").withColumn("n", n).filter("n > 0").groupBy("image", "rgb").agg(F.sum("n").alias("n"))


def against_ground(runs: DataFrame, grounds: DataFrame, near: int = 6) -> DataFrame:
    """Runs with drawn: whether their colour is further from the image's ground (image, ground) than its anti-aliased neighbours are."""
    from ..functions import colours as C

    return runs.filter("why is null").join(grounds, "image").withColumn("drawn", C.distance(F.col("rgb"), F.col("ground")) > near)
