"""Settings: defaults, laid over by a dataset's, a user's, overrides and the environment, in this order."""

from __future__ import annotations

import os
from copy import deepcopy

#: Every switch of a run. Stages named in "skip" are passed over: screen, shadow, trailing, exit, residual, recursion, gate, experts.
DEFAULTS: dict = {
    "seed": 11, "learner": "logistic", "learner_settings": {}, "split_seed": 42, "block_weights": [3, 1, 1], "oof_folds": 4,
    "label": "target", "time_col": None, "entity_cols": [], "drop": [],
    "category_min_unique": 10, "category_max_unique": 50_000, "log_skew": 2.0, "encoding_folds": 5, "te_alpha": 20.0, "te_blocks": 5,
    "route_shift_share": 0.2, "route_unseen_rate": 0.2, "max_initial_candidates": 36, "probe_trees": 20, "probe_rows": 60_000,
    "psi_max": 0.25, "auc_band": 0.15, "max_rounds": 3, "max_empty_rounds": 2, "cycles": 3, "candidate_caps": [128, 96, 64], "dedup": 0.95,
    "entry_alpha": 0.05, "entry_cap": 12, "discovery_rows": 200_000, "residual_folds": 5, "ridge_alpha": 1.0, "trailing_fraction": 0.3,
    "exit_max_drops": 2, "harm_k": 2.0, "bootstrap_repeats": 1000, "expert_min_half_positives": 100, "expert_benefit_k": 1.0, "expert_bootstrap_repeats": 600,
    "expert_min_rows": 800, "expert_min_positives": 40, "slice_max_columns": 25, "skip": [], "proposals": None, "proposer": None, "templates": None,
}
ENVIRONMENT = {"QUARRY_LEARNER": ("learner", str), "QUARRY_SEED": ("seed", int), "QUARRY_PROPOSER": ("proposer", str)}


def merge(base: dict, over: dict | None) -> dict:
    """base with over's keys, dictionaries merged key by key; neither is changed."""
    out = deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def make_config(dataset: dict | None = None, user: dict | None = None, **overrides) -> dict:
    """Unknown keys are an error, as they are mistyped more often than meant."""
    cfg = merge(merge(merge(DEFAULTS, dataset), user), overrides)
    for name, (key, kind) in ENVIRONMENT.items():
        if name in os.environ:
            cfg[key] = kind(os.environ[name])
    if unknown := set(cfg) - set(DEFAULTS):
        raise ValueError(f"settings not known: {sorted(unknown)}")
    return cfg


def load_config(path: str | None = None, dataset: dict | None = None, **overrides) -> dict:
    user = None
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            user = yaml.safe_load(f)
    return make_config(dataset, user, **overrides)
