"""Disparity estimators by name, applied to rows of tile pairs in Arrow batches.

An estimator takes two (h, w, 3) arrays of values in [0, 1] and returns disparity and validity of
the left one. Rows are ``(tile_id, h, w, left, right)`` with little-endian 32-bit floats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.kernels import block_means, semi_global

Estimator = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
_REGISTRY: dict[str, Callable[..., Estimator]] = {}


def register(name: str) -> Callable:
    def add(make: Callable[..., Estimator]) -> Callable[..., Estimator]:
        _REGISTRY[name] = make
        return make

    return add


def estimator(name: str, **options) -> Estimator:
    if name not in _REGISTRY:
        raise ValueError(f"unknown estimator {name}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**options)


#: Semi-global matching works on images smaller by this factor; holes get -32 of its pixels.
FACTOR, HOLE = 6, -32


@register("SGM")
def semi_global_estimator(low: int = -16, high: int = 16, factor: int = FACTOR) -> Estimator:
    def grey(image: np.ndarray) -> np.ndarray:
        small = np.rint(255 * block_means(image, factor)).astype(np.int64)
        return ((small @ np.array([19595, 38470, 7471]) + 32768) >> 16).astype(float)

    def run(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = left.shape[:2]
        pad = [(0, -rows % factor), (0, -cols % factor), (0, 0)]  # whole blocks, cut off again below
        disparity, valid = semi_global(grey(np.pad(left, pad, mode="edge")), grey(np.pad(right, pad, mode="edge")), low, high)
        filled = np.where(np.isnan(disparity), HOLE, disparity) * factor
        wide = lambda a: a.repeat(factor, axis=0).repeat(factor, axis=1)[:rows, :cols]
        return wide(filled), wide(valid.astype(float))

    return run


MEAN, SPREAD, MULTIPLE = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 128


def load_network(model_path: str, make: Callable | None = None):
    """A network on the CPU: TorchScript, or weights for the module that ``make()`` gives.

    Weights are a state dictionary, in a ``.tar`` checkpoint its entry ``state_dict``; only tensors are
    unpickled. Needs torch, which this library does not install.
    """
    import torch

    path = str(model_path)
    if make is None:
        return torch.jit.load(path, map_location="cpu").eval()
    weights = torch.load(path, map_location="cpu", weights_only=True)
    model = make()
    model.load_state_dict(weights["state_dict"] if path.endswith(".tar") else weights)
    return model.eval()


@register("CNN")
def network_estimator(model_path: str, make: Callable | None = None) -> Estimator:
    """A stereo network from a file, loaded once in a task: an ``.npz`` file of weights for the network of
    :mod:`.network`, which needs NumPy alone, or a file for :func:`load_network`.

    Images are normalised and padded at top and right to multiples of 128, and the result cut.
    """
    if str(model_path).endswith(".npz"):
        from .network import Network, sized

        own = Network.load(str(model_path))

        def solve(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            disparity, valid = own(left, right)
            return disparity, sized(valid, *disparity.shape)
    else:
        import torch

        model = load_network(model_path, make)

        def solve(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            with torch.no_grad():
                out = model(*[torch.from_numpy(x[None].astype(np.float32)) for x in (left, right)])[0, 0].numpy()
            return out, np.ones_like(out)

    def ready(image: np.ndarray) -> np.ndarray:
        h, w = image.shape[:2]
        data = np.pad((image - MEAN) / SPREAD, [(-h % MULTIPLE, 0), (0, -w % MULTIPLE), (0, 0)], mode="edge")
        return data.transpose(2, 0, 1)

    def run(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, w = left.shape[:2]
        disparity, mask = (x[x.shape[0] - h :, :w] for x in solve(ready(left), ready(right)))
        return np.maximum(disparity, 0.0), np.maximum(mask, 0.0)

    return run


def estimate(pairs: DataFrame, name: str, **options) -> DataFrame:
    """(tile_id, h, w, disparity, mask) of tile pairs; the estimator is made once in a task."""
    key = pairs.schema["tile_id"].dataType.simpleString()
    estimator_names = list(_REGISTRY)
    if name not in estimator_names:
        raise ValueError(f"unknown estimator {name}; known: {', '.join(sorted(estimator_names))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = None
        for batch in batches:
            solve = solve or estimator(name, **options)
            for i in range(batch.num_rows):  # one pair of tiles in memory at a time
                row = batch.slice(i, 1)
                h, w = row.column("h")[0].as_py(), row.column("w")[0].as_py()
                images = [np.frombuffer(row.column(c)[0].as_py(), "<f4").reshape(h, w, 3).astype(float) for c in ("left", "right")]
                found = [np.ascontiguousarray(a, "<f4").tobytes() for a in solve(*images)]
                yield pa.RecordBatch.from_arrays([row.column("tile_id"), row.column("h"), row.column("w"), *[pa.array([b], pa.binary()) for b in found]], ["tile_id", "h", "w", "disparity", "mask"])

    return pairs.select("tile_id", "h", "w", "left", "right").mapInArrow(run, f"tile_id {key}, h int, w int, disparity binary, mask binary")
