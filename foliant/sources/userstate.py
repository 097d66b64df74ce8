"""Small JSON documents of a user: pins, folder colors, saved filters and preferences.

They are a few rows on the driver, not Spark jobs; frames of them are made for joins.
A file that can't be decoded is moved aside to ``*.corrupt`` and defaults are used.
"""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Pin:
    name: str
    path: str
    is_default: bool = False


@dataclass
class SavedFilter:
    name: str
    query: str


def default_pins(home: str) -> list[Pin]:
    return [Pin("Home", home, True), *(Pin(n, os.path.join(home, n), True) for n in ("Desktop", "Documents", "Downloads"))]


def _load(path: Path, decode):
    try:
        raw = path.read_text()
    except OSError:
        return None
    try:
        return decode(json.loads(raw))
    except (ValueError, TypeError, KeyError, AttributeError):
        os.replace(path, f"{path}.corrupt")
        return None


def _save(path: Path, value: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, new = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as file:
        json.dump(value, file, sort_keys=True, indent=2, ensure_ascii=False)
        file.flush()
        os.fsync(file.fileno())
    os.replace(new, path)


def _text(x: object) -> str:
    if not isinstance(x, str):
        raise TypeError(x)
    return x


class UserState:
    def __init__(self, folder: str, home: str | None = None) -> None:
        self.folder = Path(folder)
        pins = _load(self.folder / "pins.json", lambda v: [Pin(_text(p["name"]), _text(p["path"]), bool(p["is_default"])) for p in v])
        self.pins = default_pins(home or os.path.expanduser("~")) if pins is None else pins
        self.colors: dict[str, tuple[int, int, int, int]] = _load(self.folder / "folder_colors.json", lambda v: {_text(k): tuple(int(c[n]) for n in ("red", "green", "blue", "alpha")) for k, c in v["folders"].items()}) or {}
        self.filters: list[SavedFilter] = _load(self.folder / "filters.json", lambda v: [SavedFilter(_text(f["name"]), _text(f["query"])) for f in v]) or []
        self.folders_on_top: bool = _load(self.folder / "prefs.json", lambda v: bool(v.get("foldersOnTop", False))) or False

    def is_pinned(self, path: str) -> bool:
        return any(p.path == path for p in self.pins)

    def add_pin(self, name: str, path: str) -> None:
        if not self.is_pinned(path):
            self.pins.append(Pin(name, path))
            self._save_pins()

    def remove_pin(self, path: str) -> None:
        self.pins = [p for p in self.pins if p.path != path]
        self._save_pins()

    def _save_pins(self) -> None:
        _save(self.folder / "pins.json", [vars(p) for p in self.pins])

    def set_color(self, path: str, color: tuple[int, int, int, int] | None) -> None:
        self.colors = {k: v for k, v in self.colors.items() if k != path} | ({path: color} if color else {})
        _save(self.folder / "folder_colors.json", {"version": 1, "folders": {k: dict(zip(("red", "green", "blue", "alpha"), v, strict=True)) for k, v in self.colors.items()}})

    def add_filter(self, name: str, query: str) -> None:
        self.filters.append(SavedFilter(name, query))
        self._save_filters()

    def update_filter(self, index: int, name: str, query: str) -> None:
        if 0 <= index < len(self.filters):
            self.filters[index] = SavedFilter(name, query)
            self._save_filters()

    def remove_filter(self, index: int) -> None:
        if 0 <= index < len(self.filters):
            del self.filters[index]
            self._save_filters()

    def _save_filters(self) -> None:
        _save(self.folder / "filters.json", [vars(f) for f in self.filters])

    def set_folders_on_top(self, on: bool) -> None:
        self.folders_on_top = on
        _save(self.folder / "prefs.json", {"foldersOnTop": on})

    def color_frame(self, spark: SparkSession) -> DataFrame:
        """(path, color): color as #rrggbbaa."""
        return spark.createDataFrame([(p, "#{:02x}{:02x}{:02x}{:02x}".format(*c)) for p, c in self.colors.items()], "path string, color string")
