"""Pictures drawn from the embeddings table, which stand in for a media column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hash64
from .media import encode_png, resized

SIDE, SIGNS = 112, 14


def scene(vector: list[float] | None) -> int:
    """A number for the signs of a vector's first values: rows with the same number show the same scene."""
    signs = "".join("+" if x is not None and x > 0 else "-" for x in ([] if vector is None else vector)[:SIGNS])
    return hash64("scene " + signs)


def draw(number: int, variant: int) -> np.ndarray:
    """The scene of that number, as it is (variant 0 of 5), cropped, with other tones, both, or turned by 90 degrees."""
    rng = np.random.default_rng(number)
    x = sum(resized(rng.integers(0, 256, (n + 1, n + 1)).astype(float), SIDE / n)[:SIDE, :SIDE] * w for n, w in ((7, 0.25), (14, 0.25), (28, 0.25), (56, 0.25)))
    x = np.clip((x - 128) * 2 + 128, 0, 255)
    cut = np.random.default_rng(variant).integers(0, 16, 4)
    if variant % 5 in (1, 3):
        x = x[cut[0] : SIDE - cut[1], cut[2] : SIDE - cut[3]]
    if variant % 5 in (2, 3):
        x = x * 0.8 + 20
    if variant % 5 == 4:
        x = np.rot90(x)
    return np.rint(x).astype(np.uint8)


def pictures(embeddings: DataFrame) -> DataFrame:
    """image_id and picture (a PNG) of every row: its vector's scene, edited as vec_id says."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                drawn = [encode_png(draw(scene(v), i or 0)) for i, v in zip(part["vec_id"].to_pylist(), part["embedding"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(drawn, pa.binary())], ["image_id", "picture"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "image_id long, picture binary")
