"""Settings of a store: defaults, then a TOML file, then LOGLOOM_* variables of the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime, timedelta
from pathlib import Path

from logloom.operators.lifecycle import Budget
from logloom.schema import InvalidInput


@dataclass(frozen=True)
class Settings:
    """retention_days 0 keeps all rows; max_message_bytes bounds a line; budget is the storage budget."""

    retention_days: int = 90
    max_message_bytes: int = 8192
    budget: Budget = field(default_factory=Budget)

    def __post_init__(self):
        if self.retention_days < 0 or self.max_message_bytes < 1:
            raise InvalidInput("retention_days is at least 0 and max_message_bytes at least 1")

    def cutoff(self, now: datetime | None = None) -> datetime | None:
        """Rows that arrived before this go; None without a retention."""
        return (now or datetime.now(UTC)) - timedelta(days=self.retention_days) if self.retention_days else None


def _whole(name: str, value) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        raise InvalidInput(f"{name} must be a whole number") from None


def load_settings(path: str | None = None, env=None) -> Settings:
    """The file's top level holds retention_days and max_message_bytes, its table [budget] the fields of Budget.

    A variable is LOGLOOM_ and the field's name in capitals, of the budget too. Unknown names in the file are errors.
    """
    env = os.environ if env is None else env
    given = tomllib.loads(Path(path).read_text()) if path else {}
    budget = given.pop("budget", {})
    plain = {f.name for f in fields(Settings)} - {"budget"}
    if unknown := (given.keys() - plain) | (budget.keys() - {f.name for f in fields(Budget)}):
        raise InvalidInput(f"unknown settings: {', '.join(sorted(unknown))}")

    def merged(defaults: dict, file: dict) -> dict:
        found = defaults | file | {n: env[f"LOGLOOM_{n.upper()}"] for n in defaults if f"LOGLOOM_{n.upper()}" in env}
        return {n: _whole(n, v) for n, v in found.items()}

    defaults = Settings()
    return Settings(**merged({n: getattr(defaults, n) for n in sorted(plain)}, given), budget=Budget(**merged(asdict(defaults.budget), budget)))
