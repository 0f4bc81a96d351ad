"""Settings from the environment; each has a default, none is a credential."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from functools import lru_cache
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    app_name: str = "millrace"
    app_env: str = "development"
    catalog_name: str = "main"
    config_path: str = ""
    storage_root: str = ""
    warehouse: str = "warehouse"
    host: str = "127.0.0.1"
    port: int = 8000
    options: dict[str, str] = field(default_factory=dict)

    @property
    def is_production(self) -> bool:
        return self.app_env == "production"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """``MILLRACE_<NAME>`` for each setting; an unreadable port is a ValueError."""
        env = dict(os.environ) if env is None else env
        found: dict[str, object] = {}
        for f in fields(cls):
            if f.name != "options" and (value := env.get(f"MILLRACE_{f.name.upper()}")) is not None:
                found[f.name] = int(value) if f.name == "port" else value
        return cls(**found)


@lru_cache(maxsize=1)
def settings() -> Settings:
    """Read once."""
    return Settings.from_env()


def catalog_options(name: str, path: str) -> dict[str, str]:
    """The section of one catalog in a JSON file ``{"catalogs": {name: {...}}}``."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    sections = json.loads(Path(path).read_text()).get("catalogs", {})
    if name not in sections:
        raise ValueError(f"{path} has no catalog {name!r}")
    return sections[name]
