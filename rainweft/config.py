"""Settings from a JSON file that may hold // comments."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from rainweft.errors import DataModelError


@dataclass
class Settings:
    """silent_import: no messages; data_sources: importer and archive pattern by name; outputs: default folders."""

    silent_import: bool = False
    data_sources: dict = field(default_factory=dict)
    outputs: dict = field(default_factory=dict)


    def __getitem__(self, name: str):
        return getattr(self, name)

    def __setitem__(self, name: str, value) -> None:
        if name not in {f.name for f in fields(self)}:
            raise KeyError(name)
        setattr(self, name, value)


#: Types that a settings file may hold, by name.
SCHEMA = {"silent_import": bool, "data_sources": dict, "outputs": dict}


def candidates() -> list[Path]:
    """Places of the settings file, first found counts."""
    named = os.environ.get("RAINWEFTRC")
    return [p for p in (Path("rainweftrc"), Path(named) if named else None, Path.home() / ".rainweft" / "rainweftrc") if p]


def load(path: str | Path | None = None) -> Settings:
    found = Path(path) if path else next((p for p in candidates() if p.is_file()), None)
    if found is None:
        return Settings()
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", found.read_text(), flags=re.S)
    raw = json.loads(text)
    unknown = set(raw) - {f.name for f in fields(Settings)}
    if unknown:
        raise DataModelError(f"unknown settings {sorted(unknown)}")
    wrong = [k for k, v in raw.items() if not isinstance(v, SCHEMA[k])]
    if wrong:
        raise DataModelError(f"settings of the wrong type: {sorted(wrong)}")
    return Settings(**raw)


def save(settings: Settings, path: str | Path) -> None:
    Path(path).write_text(json.dumps(asdict(settings), indent=2))
