"""Default parameters of the measuring operators, in metres, degrees and seconds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: thresholds that results depend on
    voxel: float = 0.02
    level_bin: float = 0.02
    min_ceiling_gap: float = 1.8
    min_ceiling_share: float = 0.2
    band_low: float = 0.3
    band_high: float = 0.3
    band_default: float = 2.0
    strip: float = 0.02
    peak_reach: int = 2
    min_peak_points: int = 500
    along_cell: float = 0.05
    min_cell_cover: float = 0.5
    max_gap_cells: int = 6
    min_length: float = 0.4
    min_height_cover: float = 0.6
    height_cell: float = 0.1
    min_prominence: float = 1.5
    wall_reach: float = 0.03
    grid: float = 0.05
    grid_margin: float = 0.2
    min_depth: float = 0.2
    max_depth: float = 5.0
    edge_threshold: float = 0.05
    min_confidence: int = 2
    min_stride: int = 5
    target_frames: int = 1200
    depth_width: int = 256
    colour_width: int = 1920
    chunk_seconds: float = 20.0
    floor_cell: float = 0.1
    min_floor_cells: int = 50
    max_floor_gap: float = 0.15
    max_lift_step: float = 0.05
    floor_tolerance: float = 0.05
    max_wall_shift: float = 0.10
    max_wall_turn: float = 1.0
    wall_turn_step: float = 0.25
    wall_cell: float = 0.02
    min_wall_points: int = 8
    min_wall_overlap: int = 150
    min_wall_gain: float = 1.05
    surface_sigma: float = 0.005
    missing_side_sigma: float = 0.05
    min_drift_sigma: float = 0.003
    low_cover_sigma: float = 0.01
    rectangle_fill: float = 0.8
    door_min: float = 0.6
    door_max: float = 1.2
    align_tolerance: float = 0.15
    floor_fill: float = 0.30
    door_split: float = 0.45
    min_room_area: float = 1.5
    side_reach: float = 0.15
    min_side_overlap: float = 0.5
    max_beyond: float = 0.10
    level_apart: float = 0.10
    min_ceiling_seen: float = 0.25
    min_second_seen: float = 0.10
    nms_iou: float = 0.5
    max_box_share: float = 0.5
    merge_distance: float = 0.5
    size_sigma: float = 0.15
    min_spots: int = 20
    depth_bias: float = 1.35
    gate_abs: float = 0.01
    gate_rel: float = 0.005
    max_ratio_spread: float = 0.10
    min_sides: int = 3


DEFAULTS = Params()
