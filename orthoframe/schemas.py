"""Schemas of the catalog's tables."""

from __future__ import annotations

MATRIX = "ARRAY<ARRAY<DOUBLE>>"

CATALOG = {
    "globals": "estimated_gsd DOUBLE, mean_flying_height DOUBLE, epsg INT, x_shift DOUBLE, y_shift DOUBLE",
    "image": "img_id INT, img_name STRING, img_param_id INT",
    "image_param": f"img_param_id INT, nrows INT, ncols INT, x DOUBLE, y DOUBLE, z DOUBLE, camera_matrix {MATRIX}, rotation_matrix {MATRIX}, geobound {MATRIX}",
    "image_pair": "img_pair_id INT, base_img_id INT, side_img_id INT, overlap DOUBLE, rect_param_id INT",
    "rectification_param": f"rect_param_id INT, h1 {MATRIX}, h2 {MATRIX}, h_shift {MATRIX}, k {MATRIX}, r {MATRIX}",
    "multi_stereo": "ms_id INT, base_img_id INT, overlapping_bounds ARRAY<INT>, pc_ready BOOLEAN, pc_id INT",
    "point_cloud": f"pc_id INT, pc_name STRING, footprint {MATRIX}, n_points BIGINT",
}
