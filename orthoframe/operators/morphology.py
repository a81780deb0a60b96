"""Cleaning of validity masks, a tile at a time in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.kernels import clean_mask


def clean_masks(tiles: DataFrame, key: str = "tile_id") -> DataFrame:
    """(key, h, w, mask) of rows (key, h, w, mask: array of 0 and 1, row by row)."""
    kind = tiles.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, mask in zip(*(batch.column(c).to_pylist() for c in ("h", "w", "mask")), strict=True):
                out.append(clean_mask(np.array(mask, float).reshape(h, w) > 0).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("h"), batch.column("w"), pa.array(out, pa.list_(pa.float64()))], [key, "h", "w", "mask"])

    return tiles.select(key, "h", "w", "mask").mapInArrow(run, f"{key} {kind}, h int, w int, mask array<double>")
