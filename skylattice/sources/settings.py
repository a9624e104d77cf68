"""Typed settings from YAML text: only declared keys are bound, and each to its declared type."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import TypeVar

from skylattice.sources.text import read_yaml

S = TypeVar("S")


@dataclass(frozen=True)
class StageSettings:
    """What every stage has."""

    type: str = ""
    path_output: str = ""
    queue_size: int = 5
    log_to_file: bool = True


# Names and defaults of the keys in settings files (fixed values).


@dataclass(frozen=True)
class PoseSettings(StageSettings):
    """Poses: tracking, georeferencing, what is published and what is saved."""

    use_vslam: bool = False
    use_imu: bool = False
    set_all_frames_keyframes: bool = False
    fallback_strategy: int = 0
    use_initial_guess: bool = False
    update_georef: bool = False
    do_delay_keyframes: bool = False
    suppress_outdated_pose_pub: bool = False
    th_error_georef: float = 1.0
    init_lost_frames_reset_count: int = 15
    min_nrof_frames_georef: int = 5
    overlap_max: float = 0.0
    overlap_max_fallback: float = 0.0
    save_trajectory_gnss: bool = False
    save_trajectory_visual: bool = False
    save_frames: bool = False
    save_keyframes: bool = False
    save_keyframes_full: bool = False


@dataclass(frozen=True)
class DensificationSettings(StageSettings):
    """Depth maps: filters and what is saved."""

    do_drop_planar: bool = False
    use_filter_bilat: bool = False
    use_filter_guided: bool = False
    compute_normals: bool = False
    save_bilat: bool = False
    save_dense: bool = False
    save_guided: bool = False
    save_imgs: bool = False
    save_sparse: bool = False
    save_thumb: bool = False
    save_normals: bool = False


@dataclass(frozen=True)
class SurfaceSettings(StageSettings):
    """Surfaces: how elevations and normals are made."""

    try_use_elevation: bool = False
    compute_all_frames: bool = False
    knn_max_iter: int = 5
    mode_surface_normals: int = 0
    save_valid: bool = False
    save_elevation: bool = False
    save_normals: bool = False


@dataclass(frozen=True)
class OrthoSettings(StageSettings):
    """Orthophotos: resolution and what is saved."""

    GSD: float = 0.0
    publish_pointcloud: bool = False
    save_valid: bool = False
    save_ortho_rgb: bool = False
    save_ortho_gtiff: bool = False
    save_elevation: bool = False
    save_elevation_angle: bool = False


@dataclass(frozen=True)
class MosaicSettings(StageSettings):
    """The mosaic: thresholds, meshes and what is saved."""

    th_elevation_min_nobs: int = 0
    th_elevation_variance: float = 0.0
    publish_mesh_every_nth_kf: int = 0
    publish_mesh_at_finish: bool = False
    downsample_publish_mesh: float = 0.0
    split_gtiff_channels: bool = False
    save_valid: bool = False
    save_ortho_rgb_one: bool = False
    save_ortho_rgb_all: bool = False
    save_ortho_gtiff_one: bool = False
    save_ortho_gtiff_all: bool = False
    save_elevation_one: bool = False
    save_elevation_all: bool = False
    save_elevation_var_one: bool = False
    save_elevation_var_all: bool = False
    save_elevation_obs_angle_one: bool = False
    save_elevation_obs_angle_all: bool = False
    save_elevation_mesh_one: bool = False
    save_num_obs_one: bool = False
    save_num_obs_all: bool = False
    save_dense_ply: bool = False


@dataclass(frozen=True)
class TileSettings(StageSettings):
    """Tiles: the zooms that are made."""

    min_zoom: int = 11
    max_zoom: int = -1


#: Settings classes by the name in a file's type key (fixed values).
STAGES = {
    "pose_estimation": PoseSettings, "densification": DensificationSettings, "surface_generation": SurfaceSettings,
    "ortho_rectification": OrthoSettings, "mosaicing": MosaicSettings, "tileing": TileSettings,
}


def _bound(text: str, kind: str):
    if kind == "bool":
        return text.strip().lower() in ("1", "true", "yes")
    return {"int": int, "float": float, "str": str}[kind](text)


def load(text: str, defaults: S) -> S:
    """Settings with the declared keys of a YAML text; a value that doesn't convert raises ValueError."""
    got = read_yaml(text)
    return replace(defaults, **{f.name: _bound(got[f.name], f.type if isinstance(f.type, str) else f.type.__name__) for f in fields(defaults) if f.name in got})


def load_stage(text: str, stage: str) -> StageSettings:
    """Settings of a stage; a file for another stage, or an unknown one, is refused."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    if read_yaml(text).get("type") != stage:
        raise ValueError(f"not a file for {stage!r}")
    return load(text, STAGES[stage]())
