"""Settings of a reconstruction, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    data_root: str
    work_root: str
    epsg: int = 32632
    downsample_factor: float = 1.0
    overlap_buffer_px: float = 300.0
    estimator: str = "CNN"
    model_path: str | None = None
    threshold: float = 0.75
    shift_ratio: float = 0.9
    tile_rows: int = 1620
    tile_cols: int = 2880
    overlap_rows: int = 512
    overlap_cols: int = 1280
    base_filter: str | None = None

    def __post_init__(self) -> None:
        if self.estimator not in ("CNN", "SGM"):
            raise ValueError("an estimator of CNN or SGM")
        if self.estimator == "CNN" and self.model_path is not None:
            object.__setattr__(self, "model_path", str(self.model_path))

    def cache(self, kind: str) -> str:
        """Folder of one kind of cached raster or cloud."""
        return f"{self.work_root.rstrip('/')}/{kind}"
