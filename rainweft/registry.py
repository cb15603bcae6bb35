"""Operators by kind and name; names are matched without case."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from rainweft.functions import transforms as T
from rainweft.kernels import advection, features, motion, nowcast, spectral
from rainweft.operators import blending, ensemble, forecast, grid, objects, ranks, reprojection, scattered, tracking, verification
from rainweft.sources import rasters, sinks

GROUP = "rainweft.plugins"

_BUILT_IN: dict[str, dict[str, Callable]] = {
    "importer": dict(rasters.FORMATS),
    "exporter": {k: sinks.write_forecast for k in ("parquet", "kineros", "netcdf", "geotiff")},
    "motion": dict(motion.METHODS),
    "nowcast": dict(nowcast.METHODS),
    "feature": {"blob": features.blobs, "shitomasi": features.corners, "tstorm": features.storm_cells},
    "blending": {"linear_blending": blending.linear_blend, "salient_blending": blending.salient_blend, "steps": forecast.blended_forecast, "pca_enkf": forecast.kalman_forecast},
    "cascade": {"fft": forecast.decomposed},
    "filter": {"gaussian": spectral.band_weights, "uniform": spectral.uniform_weights},
    "noise": {"parametric": spectral.power_law_filter, "nonparametric": spectral.field_filter, "ssft": spectral.local_filters, "nested": spectral.nested_filters, "bps": nowcast.velocity_perturbation},
    "tracking": {"lucaskanade": forecast.motion_fields, "tdating": tracking.tracks},
    "extrapolation": {"semilagrangian": advection.extrapolate, "eulerian": nowcast.eulerian, "none": None},
    "downscaling": {"rainfarm": forecast.downscaled},
    "ensemblestat": {"mean": ensemble.ensemble_mean, "excprob": ensemble.exceedance, "banddepth": ensemble.band_depth},
    "diagnostic": {},
    "interpolation": {"idwinterp2d": scattered.idw, "rbfinterp2d": scattered.rbf},
    "utils": {
        "mm/h": T.to_rainrate, "rainrate": T.to_rainrate, "mm": T.to_raindepth, "raindepth": T.to_raindepth, "dbz": T.to_reflectivity, "reflectivity": T.to_reflectivity, "db": T.db_transform, "decibel": T.db_transform,
        "boxcox": T.boxcox_transform, "log": T.boxcox_transform, "sqrt": T.sqrt_transform, "nqt": ranks.normal_scores, "accumulate": grid.aggregate_time, "upscale": grid.aggregate_space, "clip": grid.clip_domain, "square": grid.square_domain, "rapsd": forecast.radial_spectra, "reprojection": reprojection.reproject_grids,
    },
    "deterministic": {k: verification.categorical_scores for k in ("acc", "bias", "csi", "ets", "f1", "fa", "far", "gss", "hk", "hss", "mcc", "pod", "sedi")}
    | {k: verification.continuous_scores for k in ("beta", "beta1", "beta2", "corr_p", "drmse", "mae", "mse", "me", "nmse", "rmse", "rv")}
    | {"corr_s": verification.spearman, "scatter": verification.scatter, "binary_mse": verification.binary_mse_scores, "fss": verification.fss_scores, "sal": objects.sal, "intensity_scale": verification.intensity_scale},
    "ensemble": {"ens_skill": verification.ensemble_skill, "ens_spread": verification.ensemble_spread, "rankhist": verification.rank_histogram},
    "probabilistic": {"crps": verification.crps_state, "reldiag": verification.reliability, "roc": verification.roc_curve},
}

_added: dict[str, dict[str, Callable]] = {}


def register(kind: str, name: str, method: Callable) -> None:
    """Add a method; a name that exists already is an error."""
    if name.lower() in methods(kind):
        raise ValueError(f"{kind} {name} is there already")
    _added.setdefault(kind, {})[name.lower()] = method


def discover() -> int:
    """Register the entry points of installed plugins, named ``kind:name``."""
    found = 0
    for point in entry_points(group=GROUP):
        kind, _, name = point.name.partition(":")
        if kind in _BUILT_IN and name.lower() not in methods(kind):
            register(kind, name, point.load())
            found += 1
    return found


def methods(kind: str) -> dict[str, Callable]:
    if kind not in _BUILT_IN:
        raise ValueError(f"unknown kind {kind}; there are {sorted(_BUILT_IN)}")
    return _BUILT_IN[kind] | _added.get(kind, {})


def get_method(name: str, kind: str) -> Callable:
    """The method of a name; TypeError where the name isn't a string, ValueError where there is none."""
    if not isinstance(name, str):
        raise TypeError("a method's name is a string")
    known = methods(kind)
    if name.lower() not in known:
        raise ValueError(f"unknown {kind} {name}; there are {sorted(known)}")
    return known[name.lower()]


def to_df(spark):
    """``(kind, name)`` of all methods."""
    return spark.createDataFrame([(k, n) for k in _BUILT_IN for n in methods(k)], "kind string, name string")
