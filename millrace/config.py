"""Configuration from a TOML file: how a session starts and what it loads."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .errors import ConfigError


@dataclass
class Config:
    """What a file may set; everything has a default."""

    app: str = "millrace"
    master: str | None = None
    data_dir: str | None = None  # of stored tables
    checkpoint_dir: str | None = None  # shared by all executors
    max_concurrent_queries: int = 10
    format: str = "table"
    csv: dict[str, str] = field(default_factory=dict)  # name to path
    parquet: dict[str, str] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=dict)  # of Spark

    @classmethod
    def load(cls, path: str | Path) -> Config:
        try:
            found = tomllib.loads(Path(path).read_text())
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{path}: {e}") from e
        kinds = {f.name: f.default_factory() if f.name in ("csv", "parquet", "settings") else f.default for f in fields(cls)}
        for name, value in found.items():
            if name not in kinds:
                raise ConfigError(f"{path}: unknown name {name}")
            if not isinstance(value, str if kinds[name] is None else type(kinds[name])):
                raise ConfigError(f"{path}: {name} is a {type(value).__name__}")
        return cls(**found)

    def save(self, path: str | Path) -> None:
        """Write a file that ``load`` reads."""
        plain, tables = [], []
        for name, value in asdict(self).items():
            if isinstance(value, dict):
                tables += ["", f"[{name}]", *(f"{_quoted(k)} = {_quoted(str(v))}" for k, v in value.items())] if value else []
            elif value is not None:
                plain.append(f"{name} = {value if isinstance(value, int) else _quoted(value)}")
        Path(path).write_text("\n".join([*plain, *tables, ""]))

    def spark_settings(self) -> dict[str, str]:
        own = {
            "spark.sql.warehouse.dir": self.data_dir, "spark.checkpoint.dir": self.checkpoint_dir, "spark.scheduler.mode": "FAIR" if self.max_concurrent_queries > 1 else "FIFO",
        }
        return {k: v for k, v in own.items() if v} | {k: str(v) for k, v in self.settings.items()}


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'
