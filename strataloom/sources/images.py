"""Image files as pixel tables, and small files written from tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 1 << 16  # pixels of a batch


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            name, width, height, channels, data = (batch.column(c)[i] for c in range(5))
            width, channels = width.as_py(), channels.as_py()
            raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, channels)  # blue, green, red, and opacity; or grey alone
            colours = [raw[:, 2], raw[:, 1], raw[:, 0]] if channels >= 3 else [raw[:, 0]] * 3
            for s in range(0, len(raw), ROWS):
                place = np.arange(s, min(s + ROWS, len(raw)), dtype=np.int32)
                columns = [pa.array([name.as_py()] * len(place), pa.string()), pa.array(place % width), pa.array(place // width), *(pa.array(c[s : s + ROWS].astype(np.int32)) for c in colours)]
                yield pa.RecordBatch.from_arrays(columns, names=["image", "x", "y", "r", "g", "b"])


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(image, x, y, r, g, b) of the image files of a folder; image is a file's name without folder and ending.

    Spark's image source decodes PNG, JPEG, GIF and BMP, each file in its task; other files are left out. Grey images
    have three equal channels, opacity is dropped. What follows groups pixels by tile, so a large image is spread.
    """
    image = spark.read.format("image").option("dropInvalid", True).load(path)
    name = F.regexp_replace(F.element_at(F.split("image.origin", "/"), -1), r"\.[^.]*$", "")
    rows = image.select(name.alias("image"), "image.width", "image.height", "image.nChannels", "image.data").filter("width > 0 and height > 0")
    return rows.mapInArrow(_unpacked, "image string, x int, y int, r int, g int, b int")


def png_of(width: int, height: int, rgb: bytes) -> bytes:
    """A PNG file of 8-bit red, green and blue."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_images(pixels: DataFrame, folder: str) -> DataFrame:
    """Write each image of a pixel table as a PNG file; (image, bytes) of the files. A pixel that is missing is black.

    An image is one task's work, as in a codec. Give only images that fit in a task's memory.
    """

    def encode(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        grid = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        for k, c in enumerate("rgb"):
            grid[y, x, k] = table.column(c).to_numpy()
        data = png_of(grid.shape[1], grid.shape[0], grid.tobytes())
        store, top = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(top, recursive=True)
        name = str(table.column("image")[0].as_py())
        with store.open_output_stream(f"{top}/{name}.png") as out:
            out.write(data)
        return pa.table({"image": [name], "bytes": [len(data)]})

    return pixels.groupBy("image").applyInArrow(encode, "image string, bytes long")
