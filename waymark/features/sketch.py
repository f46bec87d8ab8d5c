"""Polynomial kernels by tensor sketches: features whose number is chosen, not p^degree.

The kernel is ``(scale * <x, y> + offset) ^ degree``. Each of ``degree`` count sketches adds the
coordinates of a row (and one for the offset) to ``width`` cells by a hash, with hashed signs.
The circular convolution of the sketches, computed by Fourier transforms, is a count sketch of
the row's tensor power, so inner products of sketched rows estimate the kernel without bias.
With ``a = scale <x, x> + offset`` and ``b`` the same of y, the variance of an estimate is at most
``(3^degree - 1) / width * (a b)^degree``.

Hashes depend on the seed only. A row costs degree x width steps, whatever p^degree is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from waymark.features.base import FixedStep

# Sketched rows of this many bytes are made at a time; a task holds a few times as much.
SLICE_BYTES = 2 << 20


class TensorSketch:
    """The map of rows of ``size`` coordinates to ``width`` features."""

    def __init__(self, size: int, degree: int, width: int, scale: float = 1.0, offset: float = 1.0, seed: int = 1):
        if degree < 1 or width < 1 or scale < 0 or offset < 0:
            raise ValueError("degree and width from 1, scale and offset from 0")
        draw = np.random.default_rng(seed)
        self.width, self.scale, self.offset = width, scale, offset
        self.cells = draw.integers(0, width, (degree, size + 1))
        self.signs = draw.choice([-1.0, 1.0], (degree, size + 1))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = np.concatenate([rows * np.sqrt(self.scale), np.full((len(rows), 1), np.sqrt(self.offset))], axis=1)
        product = None
        for cells, signs in zip(self.cells, self.signs, strict=True):
            sketch = np.zeros((self.width, len(x)))
            np.add.at(sketch, cells, (x * signs).T)
            wave = np.fft.rfft(sketch, axis=0)
            product = wave if product is None else product * wave
        return np.fft.irfft(product, self.width, axis=0).T


def _in_slices(batches: Iterator[pa.Array], sketch: TensorSketch, size: int) -> Iterator[pa.Array]:
    """Sketched rows of ``size`` coordinates, some at a time: the sketches of a whole batch of
    Spark's are many times its own size."""
    count = max(1, SLICE_BYTES // (8 * sketch.width))
    for batch in batches:
        for start in range(0, len(batch), count):
            rows = batch.slice(start, count)
            if rows.null_count or rows.value_lengths().unique().to_pylist() != [size]:
                raise ValueError(f"every row needs {size} numbers")
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * sketch.width
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sketch(np.nan_to_num(x)).ravel()))


def sketched(column, size: int, degree: int, width: int, scale: float, offset: float, seed: int):
    """An array column of rows as an array column of sketched rows; NaN counts as zero."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _in_slices(batches, TensorSketch(size, degree, width, scale, offset, seed), size)

    return run(column)


class SketchedVector(FixedStep):
    """``out``: the sketch of a feature vector."""

    def __init__(self, source="features", out="expanded", size=0, degree=2, width=256, scale=1.0, offset=1.0, seed=1, **state):
        super().__init__(source=source, out=out, size=size, degree=degree, width=width, scale=scale, offset=offset, seed=seed)

    def _transform(self, df):
        v = self.values
        column = sketched(vector_to_array(v["source"]), v["size"], v["degree"], v["width"], v["scale"], v["offset"], v["seed"])
        return df.withColumn(v["out"], array_to_vector(column))
