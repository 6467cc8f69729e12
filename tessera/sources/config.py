"""Settings: a flat YAML file of keys and one list, then the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

MAX_BYTES = 10 * 1024 * 1024
ENVIRONMENT = {"TESSERA_PATH": "database_path", "TESSERA_MODEL": "model_path", "TESSERA_WING": "default_wing"}


@dataclass
class Config:
    default_wing: str = "default"
    database_path: str = "tessera-store"
    model_path: str = ""
    auto_accept_entities: bool = False
    ignore_patterns: list[str] = field(default_factory=list)


def scalar(value: str) -> str:
    value = value.strip(' \r\t"')
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] == "'" else value


def load(*paths: str, environ: dict[str, str] | None = None) -> Config:
    """Settings of the first file that exists, under those of the environment. Unknown keys are ignored."""
    out, environ = Config(), os.environ if environ is None else environ
    for path in paths:
        if os.path.isfile(path):
            if os.path.getsize(path) > MAX_BYTES:
                raise ValueError(f"{path} is too large")
            with open(path, encoding="utf-8") as f:
                _read(f.read(), out)
            break
    for name, key in ENVIRONMENT.items():
        if environ.get(name):
            setattr(out, key, environ[name])
    return out


def _read(text: str, out: Config) -> None:
    in_list = False
    for raw in text.split("\n"):
        line = raw.strip(" \r\t")
        if not line or line.startswith("#"):
            continue
        if in_list and raw.startswith("  -"):
            out.ignore_patterns += [v] if (v := scalar(line.lstrip("- "))) else []
            continue
        key, colon, value = line.partition(":")
        in_list = key == "ignore_patterns" and bool(colon)
        if key == "auto_accept_entities":
            out.auto_accept_entities = scalar(value) == "true"
        elif key in ("default_wing", "database_path", "model_path") and scalar(value):
            setattr(out, key, scalar(value))
