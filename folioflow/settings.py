"""Settings of the engine: defaults, then a `.env` file, then the environment, read once on the driver."""

from __future__ import annotations

import dataclasses
import functools
import os
from collections.abc import Mapping

from .plans.routing import LOG_LEVELS

#: The prefix of variables, and the words that are true or false.
PREFIX = "IDP_"
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


@dataclasses.dataclass(frozen=True)
class Settings:
    """Names and defaults."""

    API_KEY: str | None = None
    DEBUG: bool = True
    LOG_LEVEL: str = "INFO"
    DEFAULT_OCR_ENGINE: str = "paddle"
    DEFAULT_LANGUAGE: str = "ar"
    OCR_CONFIDENCE_THRESHOLD: float = 0.5
    ENABLE_CACHING: bool = False
    CACHE_TTL: int = 3600
    BATCH_SIZE: int = 8
    RATE_LIMIT_ENABLED: bool = True
    RATE_LIMIT: int = 100
    MODELS: str = "models"

    def __post_init__(self) -> None:
        if self.LOG_LEVEL.upper() not in LOG_LEVELS:
            raise ValueError(f"LOG_LEVEL must be one of {', '.join(LOG_LEVELS)}")
        object.__setattr__(self, "LOG_LEVEL", self.LOG_LEVEL.upper())


def _value(kind: str, text: str) -> object:
    if kind.startswith("bool"):
        if text.lower() not in TRUE + FALSE:
            raise ValueError(f"neither true nor false: {text}")
        return text.lower() in TRUE
    return int(text) if kind.startswith("int") else float(text) if kind.startswith("float") else text


def _file(path: str) -> dict[str, str]:
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}


def load(environment: Mapping[str, str] = os.environ, path: str = ".env") -> Settings:
    """Names are found in any case; unknown ones are left alone; a value that does not fit its type is an error."""
    given = {k.upper(): v for source in (_file(path), environment) for k, v in source.items()}
    known = {f.name: f.type for f in dataclasses.fields(Settings)}
    return Settings(**{n: _value(str(kind), given[PREFIX + n]) for n, kind in known.items() if PREFIX + n in given})


@functools.cache
def settings() -> Settings:
    return load()
