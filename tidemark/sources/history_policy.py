"""How long each layer keeps its history, and whether a table does."""

from __future__ import annotations

from tidemark.settings import RETENTION_DAYS

#: What a table says about its history: of its log, and of files that it names no more.
KEYS = ("log", "deleted_files")
_HOURS = {"hour": 1, "day": 24, "week": 168}


def policy(layer: str) -> dict[str, str]:
    """The properties that a table of the layer is created with."""
    return dict.fromkeys(KEYS, f"{RETENTION_DAYS[layer]} days")


def as_days(span: str | None) -> float:
    """Days of a text like "2 weeks" or "interval 36 hours"; what is not set, or no span, keeps nothing."""
    words = (span or "").lower().removeprefix("interval").split()
    hours = _HOURS.get(words[1].rstrip("s")) if len(words) == 2 else None
    return float(words[0]) * hours / 24 if hours else 0.0


def shortfalls(properties: dict[str, str], layer: str) -> list[str]:
    need = RETENTION_DAYS[layer]
    return [f"{key} keeps {properties.get(key, 'nothing')}; {layer} needs {need} days" for key in KEYS if as_days(properties.get(key)) < need]


def as_sql(properties: dict[str, str]) -> str:
    """The clause that sets properties in SQL."""
    return "TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")"
