"""Settings: key files, the cutoff configuration, and which file an option names. Nothing here is a plan."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import fields, replace
from pathlib import Path

from caseloom.operators.cutoff import Grid

#: Values that switch a flag off; a second reading knows those that switch it on.
FALSE, TRUE = frozenset(("", "0", "false", "no", "off")), frozenset(("1", "true", "yes", "y", "on"))


def flag(value: str | None, default: bool = False, strict: bool = False) -> bool:
    """A flag: everything but FALSE is on, or with ``strict`` only TRUE is."""
    if value is None:
        return default
    word = value.strip().lower()
    return word in TRUE if strict else word not in FALSE


def read_key_file(path: str | Path, known: Mapping[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines; "export " and one pair of quotes are dropped, comments skipped, and known names win."""
    file = Path(path)
    return parse_keys(file.read_text(encoding="utf-8") if file.exists() else "") | dict(known or {})


def parse_keys(text: str) -> dict[str, str]:
    """The first value of each name of NAME=value lines."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        bare = line.strip().removeprefix("export ").strip()
        name, eq, value = bare.partition("=")
        if not eq or bare.startswith("#"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out.setdefault(name.strip(), value)
    return out


def numbers(text: str, kind: type = int) -> tuple:
    """Comma-separated numbers; blank parts are skipped."""
    return tuple(kind(part) for part in text.split(",") if part.strip())


def cutoff_grid(payload: Mapping | None = None, options: Mapping[str, str] | None = None) -> Grid:
    """The grid of a JSON payload; lists given as options win, while remove_self, write_submission and the tag of the payload do."""
    if payload is not None and not isinstance(payload, Mapping):
        raise ValueError("the configuration must be a JSON object")
    payload, options = payload or {}, options or {}
    names = {
        "k": ("fixed_topk", "k_values", int), "ratio_p": ("ratio_cutoff", "p_values", float), "ratio_l": ("ratio_cutoff", "l_values", int), "ratio_h": ("ratio_cutoff", "h_values", int),
        "gap_n": ("largest_gap_cutoff", "N_values", int), "gap_buffer": ("largest_gap_cutoff", "buffer_values", int), "gap_l": ("largest_gap_cutoff", "l_values", int), "gap_h": ("largest_gap_cutoff", "h_values", int),
    }
    values: dict = {}
    for name, (section, key, kind) in names.items():
        if options.get(name):
            values[name] = numbers(options[name], kind)
        elif (listed := payload.get(section, {}).get(key)) is not None:
            values[name] = tuple(map(kind, listed))
    for name in ("remove_self", "write_submission", "submission_run_tag"):
        if name in payload:
            values[name] = payload[name]
        elif name in options:
            values[name] = options[name] if name == "submission_run_tag" else flag(options[name])
    known = {f.name for f in fields(Grid)}
    return replace(Grid(), **{k: v for k, v in values.items() if k in known})


def load_cutoff_grid(path: str | Path | None, options: Mapping[str, str] | None = None) -> Grid:
    return cutoff_grid(json.loads(Path(path).read_text(encoding="utf-8")) if path else None, options)


def first_given(*choices: str | None) -> str | None:
    """The first choice that is given and not blank: how scope files and vector sources are picked (option, model's, shared, none)."""
    return next((c for c in choices if c and c.strip()), None)


def vector_source(source: str | None, custom: str | None, by_source: Mapping[str, str], default: str = "processed") -> str:
    """Path of the vectors: a custom one, else that of the named source; an unknown source is an error."""
    if custom and custom.strip():
        return custom
    name = (source or default).strip()
    if name not in by_source:
        raise ValueError(f"source must be one of {sorted(by_source)}, not {name!r}")
    return by_source[name]


def environment(name: str, default: str | None = None, required: bool = False) -> str | None:
    value = os.environ.get(name)
    if value is None and required:
        raise KeyError(name)
    return default if value is None else value
