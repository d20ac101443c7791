"""X-01: configuration with defaults, per-key deep merge, presets and checks."""

from __future__ import annotations

import copy
import tomllib
from pathlib import Path

#: Defaults by section.
DEFAULTS = {
    "retrieval": {"seed_k": 25, "max_expansions": 800, "deliver": 40, "floor": 0.0, "mode": "hybrid", "pagerank_rounds": 25, "lexical_weight": 0.0,
                  "source_trust": {}},
    "heat": {"half_life_secs": 30 * 86_400, "evidence_half_life_secs": 0},
    "ingest": {"dedup_threshold": 0.98, "poll_secs": 5, "retention_secs": {}, "review": {}, "dedup_by_kind": {}},
    "store": {"cold_cap": 50_000},
}
PRESETS = {
    "relaxed": {"retrieval": {"seed_k": 25, "max_expansions": 800, "deliver": 40}, "heat": {"half_life_secs": 30 * 86_400}, "ingest": {"dedup_threshold": 0.98}},
    "medium": {"retrieval": {"seed_k": 15, "max_expansions": 500, "deliver": 25}, "heat": {"half_life_secs": 7 * 86_400}, "ingest": {"dedup_threshold": 0.95}},
    "tight": {"retrieval": {"seed_k": 10, "max_expansions": 250, "deliver": 12}, "heat": {"half_life_secs": 3 * 86_400}, "ingest": {"dedup_threshold": 0.90}},
}
_RANGES = {("ingest", "dedup_threshold"): (0.0, 1.0), ("retrieval", "floor"): (-10.0, 10.0), ("retrieval", "seed_k"): (1, 4096),
           ("retrieval", "max_expansions"): (1, 1_000_000), ("retrieval", "deliver"): (1, 10_000),
           ("heat", "half_life_secs"): (1, 10**10), ("ingest", "poll_secs"): (1, 86_400), ("store", "cold_cap"): (1, 10**12)}


def merge(base: dict, over: dict) -> dict:
    """``over`` laid over ``base`` key by key; lists and scalars are replaced whole."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def check(config: dict) -> dict:
    """The config, or an error that names the first value out of range."""
    for (section, key), (lo, hi) in _RANGES.items():
        v = config[section][key]
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not lo <= v <= hi:
            raise ValueError(f"{section}.{key} = {v!r} is outside {lo}..{hi}")
    if config["retrieval"]["mode"] not in ("content", "reason", "hybrid"):
        raise ValueError(f"retrieval.mode = {config['retrieval']['mode']!r}")
    return config


def load(*paths: str | Path, preset: str | None = None) -> dict:
    """Defaults, then each TOML file that is there, then a preset's five values."""
    config = DEFAULTS
    for p in paths:
        if Path(p).exists():
            config = merge(config, tomllib.loads(Path(p).read_text()))
    if preset is not None:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}")
        config = merge(config, PRESETS[preset])
    return check(config)
