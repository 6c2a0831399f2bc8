"""Settings: the command line first, then the environment, then a TOML file, then a default."""

from __future__ import annotations

import logging
import os
import tomllib
from pathlib import Path

FILE = "~/.lodestone/config.toml"
PREFIX = "LODESTONE_"
#: How far indexing gives way to other processes of its machine; 0 switches it off.
NICE = 10


def load(path: str | None = None) -> dict:
    """The file's settings; none if there is no file or it can't be read as TOML."""
    file = Path(path or FILE).expanduser()
    if not file.exists():
        return {}
    try:
        return tomllib.loads(file.read_text())
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        logging.getLogger(__name__).warning("%s is left out: %s", file, e)
        return {}


def setting(name: str, given=None, file: dict | None = None, default=None, kind: type = str):
    """One setting by precedence; a value that isn't of its kind is passed over with a warning."""
    for source, value in (("command line", given), ("environment", os.environ.get(PREFIX + name.upper())), ("file", (file or {}).get(name))):
        if value is None:
            continue
        try:
            return kind(value)
        except (TypeError, ValueError):
            logging.getLogger(__name__).warning("%s from the %s is left out: %r", name, source, value)
    return default


def nice_value(given: int | None = None, file: dict | None = None, default: int | None = NICE) -> int | None:
    """How far to give way; None if nothing says so or 0 does."""
    value = setting("nice", given, file, default, int)
    return value if value and value > 0 else None
