"""Settings from YAML files, as the dataclasses that operators take.

A main file names further ones under `includes` (classes, menus), relative to itself. Values are cast to the types of what they set.
A key that must be there and isn't, or a value that can't be cast, fails and is named; keys that nothing knows are named in a warning and in
`Settings.unknown`; a mode that doesn't exist becomes tray.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from orderweave.operators.exposure import Control
from orderweave.operators.service import MODES, Service
from orderweave.operators.tracking import Rules

#: Where settings stand, and what each sets. A rule's name, or "" for one that is taken elsewhere.
PLACES = {
    "thresholds": {"ai_conf": "", "ai_iou": ""},
    "placement": {"roi_strink": "shrink", "iou_assign": "tray", "iou_candidate": "candidate", "drift_iou_thresh": "drift"},
    "stability": {
        "n_settle_frame": "", "k_container_fail": "drift_frames", "k_container_new": "new_frames", "tray_missing_frame": "tray_missing",
        "sticker_missing_frame": "sticker_missing", "ticket_leave_frame": "ticket_leave",
    },
}
STEERING = {"tolerance": "tolerance", "max_step_ratio": "step", "overexposed_guard": "most_bright", "underexposed_guard": "most_dark"}
#: Sections that say what is outside of a table: devices, servers, models.
OUTSIDE = ("mqtt", "runtime", "camera_params")
SECTIONS = (*PLACES, *OUTSIDE, "includes", "mode", "preset_roi", "birghtness_controller")
AREAS = ("ticket_roi", "object_roi", "packing_roi")


@dataclass(frozen=True)
class Settings:
    service: Service
    score: float
    overlap: float
    classes: dict[int, str]
    menu: tuple[tuple[str, tuple[str, ...]], ...]
    areas: dict[str, tuple[float, ...]] = field(default_factory=dict)
    steering: dict[str, float | None] = field(default_factory=dict)
    outside: dict[str, Any] = field(default_factory=dict)
    unknown: tuple[str, ...] = ()

    def control(self, target: float) -> Control:
        return replace(Control(target), **self.steering)

    def menu_table(self, spark: SparkSession) -> DataFrame:
        """pos, name, sub_items, in the file's order."""
        return spark.createDataFrame([(k, n, list(parts)) for k, (n, parts) in enumerate(self.menu)], "pos long, name string, sub_items array<string>")


def _yaml(path: Path) -> dict:
    import yaml

    if not path.is_file():
        raise ValueError(f"there is no file {path}")
    with path.open(encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} has no settings")
    return found


def _get(tree: dict, kind: type, *keys: str) -> Any:
    for k, key in enumerate(keys):
        if not isinstance(tree, dict) or key not in tree:
            raise ValueError(f"setting {'.'.join(keys[: k + 1])} is missing")
        tree = tree[key]
    try:
        return kind(tree)
    except (TypeError, ValueError) as e:
        raise ValueError(f"setting {'.'.join(keys)} is {tree!r}, which is no {kind.__name__}") from e


def _corners(data: Any, name: str) -> tuple[float, ...]:
    try:
        out = tuple(float(v) for x, y in data["points"] for v in (x, y))
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"setting preset_roi.{name}.points must be pairs of numbers") from e
    if len(out) != 8:
        raise ValueError(f"setting preset_roi.{name}.points must be four corners")
    return out


def load(path: str | Path) -> Settings:
    main = Path(path).resolve()
    tree = _yaml(main)
    unknown = [k for k in tree if k not in SECTIONS]
    for section, known in (*PLACES.items(), ("includes", {"classes": "", "menus_mapping": ""}), ("preset_roi", dict.fromkeys(AREAS))):
        unknown += [f"{section}.{k}" for k in tree.get(section) or {} if k not in known]

    included = {k: _yaml(main.parent / name) for k, name in _get(tree, dict, "includes").items() if name and k in ("classes", "menus_mapping")}
    classes = {_get(c, int, "id"): _get(c, str, "name") for c in _get(included.get("classes", {"classes": []}), list, "classes")}
    menu = tuple((_get(m, str, "name"), tuple(str(s) for s in _get(m, list, "sub_items"))) for m in _get(included.get("menus_mapping", {"mapping": []}), list, "mapping"))

    mode = str(tree.get("mode", "tray")).strip().lower()
    if mode not in MODES:
        warnings.warn(f"there is no mode {mode!r}; tray is taken", stacklevel=2)
        mode = "tray"
    areas = {k: _corners(v, k) for k, v in (tree.get("preset_roi") or {}).items() if k in AREAS}
    if ("preset_roi" in tree or mode == "preset_roi") and "ticket_roi" not in areas:
        raise ValueError("setting preset_roi.ticket_roi is missing")
    rules: dict[str, Any] = {"mode": mode}
    for section, known in PLACES.items():
        for key, rule in known.items():
            value = _get(tree, type(getattr(Rules(), rule)) if rule else float, section, key)
            if rule:
                rules[rule] = value
    steering = {rule: None if tree["birghtness_controller"].get(key) is None else _get(tree, float, "birghtness_controller", key) for key, rule in STEERING.items()} if "birghtness_controller" in tree else {}
    if unknown:
        warnings.warn(f"unknown settings: {', '.join(unknown)}", stacklevel=2)
    service = Service(Rules(**rules), area=areas.get("ticket_roi"), settled=_get(tree, int, "stability", "n_settle_frame"))
    return Settings(service, _get(tree, float, "thresholds", "ai_conf"), _get(tree, float, "thresholds", "ai_iou"), classes, menu, areas, {k: v for k, v in steering.items() if v is not None or k.startswith("most_")}, {k: tree[k] for k in OUTSIDE if k in tree}, tuple(unknown))
