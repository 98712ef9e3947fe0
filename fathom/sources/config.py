"""Options of a scan from a TOML or JSON file."""

from __future__ import annotations

import difflib
import json
import tomllib
from dataclasses import fields
from pathlib import Path

from fathom.plans.rules import Limits
from fathom.plans.scan import Options


def _checked(given: dict, kind: type, where: str) -> dict:
    known = {f.name for f in fields(kind)}
    for key in given:
        if key not in known:
            near = difflib.get_close_matches(key, known, 1)
            raise ValueError(f"{where} has no {key!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    return given


def load_options(path: str | Path) -> Options:
    """Options by the names of their fields, limits in a table of their own; an unknown key raises, with the nearest known one."""
    text = Path(path).read_text()
    given = _checked(json.loads(text) if str(path).endswith(".json") else tomllib.loads(text), Options, "the configuration")
    limits = Limits(**_checked(given.pop("limits", {}), Limits, "limits"))
    return Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}, limits=limits)


def merged(base: Options, nested: dict[str, Options]) -> Options:
    """``base`` with the exclusions of nested folders' configurations, each for paths below its folder."""
    more = [f"{folder.rstrip('/')}/.*{e}" for folder, o in sorted(nested.items()) for e in o.exclude]
    return Options(**{f.name: getattr(base, f.name) for f in fields(Options)} | {"exclude": (*base.exclude, *more)})
