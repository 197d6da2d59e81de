"""Configuration: defaults, overrides by dotted key, ``${}`` references; dataset specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml


def _merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _get(cfg: dict, key: str):
    for part in key.split("."):
        cfg = cfg[part]
    return cfg


def _resolve(value, cfg: dict, depth: int = 0):
    if depth > 20:
        raise ValueError("references run in a circle")
    if isinstance(value, dict):
        return {k: _resolve(v, cfg, depth) for k, v in value.items()}
    if isinstance(value, list):
        return [_resolve(v, cfg, depth) for v in value]
    if isinstance(value, str) and (refs := re.findall(r"\$\{([^}]+)\}", value)):
        if value == "${" + refs[0] + "}":
            return _resolve(_get(cfg, refs[0]), cfg, depth + 1)
        for r in refs:
            value = value.replace("${" + r + "}", str(_resolve(_get(cfg, r), cfg, depth + 1)))
    return value


def load_config(root: str, name: str = "config", overrides: list[str] = ()) -> dict:
    """``root/name.yaml`` over its list of defaults (group files), then ``a.b=c`` and ``group=file`` overrides, references last."""
    base = yaml.safe_load((Path(root) / f"{name}.yaml").read_text()) or {}
    groups: dict[str, str] = {}
    for d in base.pop("defaults", []):
        if isinstance(d, dict):
            groups.update(d)
    pairs = [o.split("=", 1) for o in overrides]
    groups.update({k: v for k, v in pairs if k in groups})
    cfg: dict = {}
    for group, file in groups.items():
        cfg = _merge(cfg, {group: yaml.safe_load((Path(root) / group / f"{file}.yaml").read_text()) or {}})
    cfg = _merge(cfg, base)
    for k, v in pairs:
        if k not in groups:
            value = yaml.safe_load(v)
            for part in reversed(k.split(".")):
                value = {part: value}
            cfg = _merge(cfg, value)
    return _resolve(cfg, cfg)


@dataclass(frozen=True)
class DatasetSpec:
    """What a data set declares; fractions must add up to 1."""

    label_col: str
    num_cols: tuple[str, ...] = ()
    cat_cols: tuple[str, ...] = ()
    train_frac: float = 0.8
    val_frac: float = 0.1
    test_frac: float = 0.1
    filter_query: str | None = None
    min_cat_count: int | None = None
    top_n: int = 128
    hash_buckets: int = 256
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if abs(self.train_frac + self.val_frac + self.test_frac - 1) > 1e-9:
            raise ValueError("fractions must add up to 1")

    @classmethod
    def load(cls, path: str) -> DatasetSpec:
        raw = yaml.safe_load(Path(path).read_text())
        known = {k: tuple(v or ()) if k in ("num_cols", "cat_cols") else v for k, v in raw.items() if k in cls.__dataclass_fields__ and k != "extra"}
        return cls(**known, extra={k: v for k, v in raw.items() if k not in known})
