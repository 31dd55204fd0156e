"""Settings and feature specifications from files: loading, validation, canonical text and fingerprint."""

from __future__ import annotations

import hashlib
import json
import tomllib
from pathlib import Path

from framewright.functions.geometry import feature, parse_feature
from framewright.functions.scalars import deep_merge

#: Keys of the residue metrics and what each must be.
RESIDUE_SETS = ("hydrophobic_residues", "aromatic_residues", "basic_residues", "acidic_residues")
RESIDUE_NUMBERS = ("pka_n_terminus", "pka_c_terminus", "ph_lower", "ph_upper", "pi_tolerance")


class SettingsError(ValueError):
    """A settings file lacks something or holds something else than it must."""


def load(path: str | Path, defaults: dict | None = None, required: tuple[str, ...] = ()) -> dict:
    """A mapping from a JSON, TOML or (where its library is there) YAML file, over ``defaults``."""
    path = Path(path)
    if not path.is_file():
        raise SettingsError(f"no settings file {path}")
    text = path.read_text()
    if path.suffix == ".json":
        own = json.loads(text)
    elif path.suffix == ".toml":
        own = tomllib.loads(text)
    elif path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise SettingsError("reading YAML needs its library; use JSON or TOML") from e
        own = yaml.safe_load(text) or {}
    else:
        raise SettingsError(f"unknown kind of settings file {path.suffix!r}")
    if not isinstance(own, dict):
        raise SettingsError(f"{path} is no mapping")
    whole = deep_merge(defaults or {}, own)
    if lost := sorted(set(required) - set(whole)):
        raise SettingsError(f"{path} lacks {', '.join(lost)}")
    return whole


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; equal settings have equal texts however they were written."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def canonical_features(specs: list[str]) -> list[str]:
    """Each feature in one spelling: folded name, atoms, options by name; unknown ones raise."""
    out = []
    for text in specs:
        own = parse_feature(text)
        arity, _, _ = feature(own.name)
        if len(own.atoms) != arity:
            raise SettingsError(f"{text}: {arity} atoms are needed")
        inside = [*map(str, own.atoms), *(f"{k}={v!r}" for k, v in sorted(own.options.items()))]
        out.append(own.name + (f"({','.join(inside)})" if inside else ""))
    return out


def feature_spec(path: str | Path) -> tuple[list[str], str]:
    """The features of a specification file in canonical spelling, and their fingerprint."""
    own = load(path, required=("features",))
    if not isinstance(own["features"], list) or not own["features"] or not all(isinstance(x, str) for x in own["features"]):
        raise SettingsError("features must be a list of texts")
    specs = canonical_features(own["features"])
    return specs, fingerprint(specs)


def _number(value, key: str, kind: type = float):
    try:
        if isinstance(value, bool):
            raise TypeError
        return kind(value)
    except (TypeError, ValueError) as e:
        raise SettingsError(f"{key} must be a number") from e


def residue_settings(own: dict) -> dict:
    """Checked settings of the residue metrics: letter sets, pK values, the range and the accuracy of the search."""
    if lost := sorted({*RESIDUE_SETS, *RESIDUE_NUMBERS, "pka_side", "pi_max_iterations"} - set(own)):
        raise SettingsError(f"settings lack {', '.join(lost)}")
    out: dict = {}
    for key in RESIDUE_SETS:
        letters = own[key].replace(" ", "") if isinstance(own[key], str) else own[key]
        if not letters or not all(isinstance(x, str) and len(x.strip()) == 1 for x in letters):
            raise SettingsError(f"{key} must be single letters")
        out[key] = {x.strip().upper() for x in letters}
    if both := out["basic_residues"] & out["acidic_residues"]:
        raise SettingsError(f"both basic and acidic: {', '.join(sorted(both))}")
    if not isinstance(own["pka_side"], dict):
        raise SettingsError("pka_side must be a mapping")
    out["pka_side"] = {str(k).strip().upper(): _number(v, f"pka_side.{k}") for k, v in own["pka_side"].items()}
    if lost := sorted((out["basic_residues"] | out["acidic_residues"]) - set(out["pka_side"])):
        raise SettingsError(f"pka_side lacks {', '.join(lost)}")
    out |= {k: _number(own[k], k) for k in RESIDUE_NUMBERS} | {"pi_max_iterations": _number(own["pi_max_iterations"], "pi_max_iterations", int)}
    if out["ph_lower"] >= out["ph_upper"] or out["pi_tolerance"] <= 0 or out["pi_max_iterations"] <= 0:
        raise SettingsError("the range, the tolerance and the number of rounds must be positive")
    return out
