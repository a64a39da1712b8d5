"""Frame images as fixed-shape tensors: a masked region, resizing, normalisation, over whole batches of images at a time.

An image is the bytes of its rows of pixels, blue, green and red a byte each, with its height and width. A tensor is an array of 32-bit
floats, planes of red, green and blue one after the other, whose shape is in the column's metadata. Images of one size in a batch
are one array, and every step is one operation on it; BATCH of them are held at a time, whatever the batch's size.

Defined cases: a null image, or one whose length isn't that of its height and width, has a null tensor. A mask reaches as far as the
image does. Images of any sizes may be mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings

#: Images that are held as arrays at a time.
BATCH = 16


def taps(size: int, out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of the resized axis the two neighbours that it lies between, and its part of the way: centres of pixels are matched."""
    at = np.clip((np.arange(out) + 0.5) * (size / out) - 0.5, 0, size - 1)
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, np.minimum(low + 1, size - 1), at - low


def resize(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """(n, height, width, channels) of (n, h, w, channels) bytes, bilinear, to the nearest byte."""
    _, h, w, _ = images.shape
    if (h, w) == (height, width):
        return images
    top, bottom, down = taps(h, height)
    left, right, along = taps(w, width)
    down, along = down[None, :, None, None], along[None, None, :, None]
    rows = images[:, top] * (1 - down) + images[:, bottom] * down
    return np.rint(rows[:, :, left] * (1 - along) + rows[:, :, right] * along).astype(np.uint8)


def masked(images: np.ndarray, mask: tuple[int, int, int, int]) -> np.ndarray:
    """Black from the mask's top and left up to its bottom and right, which are outside."""
    top, left, bottom, right = mask
    images = images.copy()
    images[:, top:bottom, left:right] = 0
    return images


def normalised(images: np.ndarray, s: Settings = DEFAULTS) -> np.ndarray:
    """(n, 3, h, w) floats: red, green and blue of blue, green and red bytes, less the mean, by the deviation of each."""
    scale, shift = 1 / (255 * np.array(s.image_std)), np.array(s.image_mean) / np.array(s.image_std)
    return (images[..., ::-1] * scale - shift).transpose(0, 3, 1, 2).astype(np.float32)


def arrays(heights, widths, images: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, (n, h, w, 3) bytes) of images of one size, BATCH at most."""
    length = np.asarray(pa.compute.binary_length(images).fill_null(-1))
    h, w = (np.nan_to_num(np.asarray(x, float)).astype(np.int64) for x in (heights, widths))
    good = (h > 0) & (w > 0) & (length == 3 * h * w)
    for size in np.unique(np.stack([h[good], w[good]], axis=1), axis=0):
        places = np.flatnonzero(good & (h == size[0]) & (w == size[1]))
        for k in range(0, len(places), BATCH):
            part = places[k : k + BATCH]
            joined = b"".join(images.take(pa.array(part)).to_pylist())
            yield part, np.frombuffer(joined, np.uint8).reshape(len(part), *size, 3)


def prepared(images: np.ndarray, s: Settings = DEFAULTS, mask: bool = True) -> np.ndarray:
    """What a detector is given of frames (n, h, w, 3): masked where the camera prints its clock, resized, normalised."""
    return normalised(resize(masked(images, s.clock_mask) if mask else images, s.model_height, s.model_width), s)


def tensors(frames: DataFrame, s: Settings = DEFAULTS, mask: bool = True, carry: tuple[str, ...] = ("camera_name", "frame_id")) -> DataFrame:
    """The columns `carry` and tensor of frames (height, width, image)."""
    schema = pa.schema([pa.field(f.name, t) for f, t in ((frames.schema[c], _arrow(frames, c)) for c in carry)] + [("tensor", pa.list_(pa.float32()))])
    n = len(carry)
    size = 3 * s.model_height * s.model_width

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                out, known = np.zeros((part.num_rows, size), np.float32), np.zeros(part.num_rows, bool)
                for places, pixels in arrays(part.column(n), part.column(n + 1), part.column(n + 2)):
                    out[places] = prepared(pixels, s, mask).reshape(len(places), size)
                    known[places] = True
                flat = pa.array(out[known].ravel())
                at = pa.array(np.concatenate([[0], np.cumsum(known) * size]).astype(np.int32), mask=np.append(~known, False))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.ListArray.from_arrays(at, flat)], schema=schema)

    named = ", ".join([*(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in carry), "tensor array<float>"])
    out = frames.select(*[F.col(f"`{c}`") for c in carry], F.col("height").cast("int"), F.col("width").cast("int"), "image").mapInArrow(run, named)
    return out.withColumn("tensor", F.col("tensor").alias("tensor", metadata={"shape": [3, s.model_height, s.model_width]}))


def _arrow(frames: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frames.schema[column].dataType)
