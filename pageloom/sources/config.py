"""Settings from environment variables. Blank values count as unset, numbers that are none as their default."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

TRUE = ("1", "true", "yes", "on")


def text(env: Mapping[str, str], name: str, default: str | None = None) -> str | None:
    value = (env.get(name) or "").strip()
    return value or default


def number(env: Mapping[str, str], name: str, default: float) -> float:
    try:
        value = float(text(env, name) or "")
    except ValueError:
        return default
    return value if math.isfinite(value) else default


def integer(env: Mapping[str, str], name: str, default: int, least: int = 0) -> int:
    value = math.floor(number(env, name, default))
    return value if value >= least else default


def flag(env: Mapping[str, str], name: str, default: bool) -> bool:
    value = text(env, name)
    return default if value is None else value.lower() in TRUE


@dataclass(frozen=True)
class Config:
    """prefix + NAME in upper case of each field; see from_env."""

    url: str = "http://localhost:8000"
    api_key: str | None = None
    model: str | None = None
    page_concurrency: int = 2
    request_concurrency: int = 10
    retries: int = 3
    page_retries: int = 2
    timeout: float = 600.0
    skip_failed_pages: bool = True
    dpi: int = 200
    page_limit: int = 0
    jpeg_quality: float = 0.75
    formulas: bool = True
    tables: bool = True
    merge_tables: bool = True
    join_equations: bool = True
    without_lists: bool = False
    without_paratext: bool = False
    end_token: str = "<|im_end|>"

    @classmethod
    def from_env(cls, prefix: str = "PAGELOOM_", env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        out = {}
        for f in fields(cls):
            name = prefix + f.name.upper()
            if isinstance(f.default, bool):
                out[f.name] = flag(env, name, f.default)
            elif isinstance(f.default, int):
                out[f.name] = integer(env, name, f.default)
            elif isinstance(f.default, float):
                out[f.name] = number(env, name, f.default)
            elif f.name == "end_token" and env.get(name) == "":
                out[f.name] = ""  # set but empty: no token is cut
            else:
                out[f.name] = text(env, name, f.default)
        return cls(**out)
