"""Settings of a project in ``loomwork.toml`` or ``loomwork.json``; the command line goes before them."""

from __future__ import annotations

import json
import logging
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from .operators.generate import ATTEMPTS, DATASET_ATTEMPTS

FILES = ("loomwork.toml", "loomwork.json")
LEVELS = {"none": logging.CRITICAL + 1, "error": logging.ERROR, "warn": logging.WARNING, "info": logging.INFO, "debug": logging.DEBUG}


@dataclass
class Config:
    #: Files or folders of plugins, relative to the settings' own folder.
    plugins: list[str] = field(default_factory=list)
    seed: int = 0
    format: str = "json"
    pretty: bool = False
    log_level: str = "warn"
    #: Parts of the engine (generate, check, describe, cli) that are logged; all, if none is named.
    log_components: list[str] = field(default_factory=list)
    attempts: int = ATTEMPTS
    dataset_attempts: int = DATASET_ATTEMPTS
    folder: str = "."


def find(start: str | Path = ".") -> Path | None:
    """The nearest file of settings in a folder or those above it."""
    start = Path(start).resolve()
    return next((f / n for f in (start, *start.parents) for n in FILES if (f / n).is_file()), None)


def load(path: str | Path | None) -> Config:
    """The settings of a file; the defaults without one. Unknown names and wrong kinds are errors."""
    if path is None:
        return Config()
    path = Path(path)
    raw = tomllib.loads(path.read_text()) if path.suffix == ".toml" else json.loads(path.read_text())
    known = {f.name: f for f in fields(Config)}
    for name, value in raw.items():
        if name not in known or name == "folder":
            raise ValueError(f"{path}: unknown setting {name!r}")
        if type(value) is not type(getattr(Config(), name)):
            raise ValueError(f"{path}: {name} can't be {value!r}")
    out = Config(**raw, folder=str(path.parent))
    if out.log_level not in LEVELS:
        raise ValueError(f"{path}: log_level is one of {', '.join(LEVELS)}")
    return out


def start_logging(level: str, components: list[str] = ()) -> None:
    """Logs the named parts at a level, the others only errors."""
    top = logging.getLogger("loomwork")
    if not top.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("[%(levelname)s] [%(name)s] %(message)s"))
        top.addHandler(handler)
    top.setLevel(max(LEVELS[level], logging.ERROR) if components else LEVELS[level])
    for c in components:
        logging.getLogger(f"loomwork.{c}").setLevel(LEVELS[level])
