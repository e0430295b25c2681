"""Registered models, benchmarks and run plans: small configuration files, read on the driver."""

from __future__ import annotations

import json
import re
from pathlib import Path

try:
    import yaml
except ImportError:  # JSON files need none
    yaml = None

#: Fixed value: how identifiers are written.
IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9._-]*")


class ConfigError(ValueError):
    pass


def _once(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise ConfigError(f"repeated key: {key}")
        out[key] = value
    return out


def _yaml(text: str) -> object:
    if yaml is None:
        raise ConfigError("YAML files need the yaml package")

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, lambda loader, node: _once([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]))
    return yaml.load(text, Loader)


def load_config(path: str | Path) -> dict:
    """The mapping of a YAML or JSON file; a repeated key, or anything but a mapping, is an error."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    try:
        found = json.loads(text, object_pairs_hook=_once) if path.suffix == ".json" else _yaml(text)
    except ConfigError as error:
        raise ConfigError(f"{path.name}: {error}") from None
    if not isinstance(found, dict):
        raise ConfigError(f"{path.name}: not a mapping")
    return found


def load_folder(folder: str | Path, key: str = "id") -> dict[str, dict]:
    """The configurations of a folder by id, in order of file names; ids are checked, and none may come twice."""
    out: dict[str, dict] = {}
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yaml", ".yml", ".json")):
        found = load_config(path)
        name = found.get(key)
        if not isinstance(name, str) or not IDENTIFIER.fullmatch(name):
            raise ConfigError(f"{path.name}: {key} is no identifier: {name!r}")
        if name in out:
            raise ConfigError(f"{path.name}: {name} is registered twice")
        out[name] = found
    return out


def run_plans(plans: dict[str, dict], benchmark: str, fingerprint: str | None = None, capabilities: set[str] | None = None) -> list[str]:
    """Ids of plans for a benchmark, of this fingerprint if one is given, that ask for no capability beyond those given."""
    fits = lambda p: p.get("benchmark") == benchmark and fingerprint in (None, p.get("fingerprint")) and (capabilities is None or set(p.get("capabilities") or ()) <= capabilities)
    return [name for name, plan in plans.items() if fits(plan)]
