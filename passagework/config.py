"""Settings from the nearest ``.env`` file; what the environment has wins."""

from __future__ import annotations

import os
from pathlib import Path


def load_env(begin: str | Path = ".") -> Path | None:
    """Read ``KEY=value`` lines of the nearest ``.env`` from ``begin`` upwards; the file, or None."""
    here = Path(begin).resolve()
    for folder in (here, *here.parents):
        if (found := folder / ".env").is_file():
            for line in found.read_text().splitlines():
                name, sign, value = line.partition("=")
                name = name.strip().removeprefix("export ").strip()
                if sign and name and not name.startswith("#"):
                    os.environ.setdefault(name, value.strip().strip("'\""))
            return found
    return None
