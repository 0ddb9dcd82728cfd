"""Settings from the environment, workspaces, logging."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass
from pathlib import Path

PREFIX = "AUGURY_"


@dataclass(frozen=True)
class Workspace:
    """Folders of one workspace; the champion is shared by all."""

    name: str
    data: Path
    parquet: Path
    artifacts: Path

    @classmethod
    def from_name(cls, name: str, root: str = ".") -> Workspace:
        base = Path(root)
        return cls(name, base / "data/workspaces" / name, base / "data/workspaces" / name / "parquet", base / "artifacts/workspaces" / name)

    @classmethod
    def from_env(cls) -> Workspace:
        names = [PREFIX + x for x in ("WORKSPACE", "DATA_DIR", "PARQUET_DIR", "ARTIFACTS_DIR")]
        missing = [n for n in names if not os.environ.get(n)]
        if missing:
            raise OSError(f"missing environment variables: {', '.join(missing)}")
        w, d, p, a = (os.environ[n] for n in names)
        return cls(w, Path(d), Path(p), Path(a))

    def make(self) -> Workspace:
        for p in (self.data, self.parquet, self.artifacts):
            p.mkdir(parents=True, exist_ok=True)
        return self

    def environment(self) -> dict[str, str]:
        """What a command in this workspace gets."""
        return {PREFIX + "WORKSPACE": self.name, PREFIX + "DATA_DIR": str(self.data), PREFIX + "PARQUET_DIR": str(self.parquet), PREFIX + "ARTIFACTS_DIR": str(self.artifacts)}


@dataclass(frozen=True)
class Settings:
    artifacts_dir: str = "artifacts"
    workspace: str = "ops_daily"
    log_level: str = "INFO"
    flat_stake: float = 1.0
    taker_bps: float = 30.0
    min_edge: float = 0.20
    cache_ttl_seconds: int = 3600
    api_key: str = ""
    api_secret: str = ""
    api_passphrase: str = ""

    @classmethod
    def read(cls, environ: dict[str, str] | None = None, env_file: str | None = None) -> Settings:
        """Variables with the prefix; those of the environment win over the file's."""
        found: dict[str, str] = {}
        if env_file and os.path.exists(env_file):
            for line in Path(env_file).read_text().splitlines():
                key, sign, value = line.strip().partition("=")
                if sign and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("'\"")
        found |= os.environ if environ is None else environ
        out = {}
        for name, default in cls.__dataclass_fields__.items():
            if (raw := found.get(PREFIX + name.upper())) is not None:
                out[name] = type(default.default)(raw)
        return cls(**out)

    @property
    def has_api_credentials(self) -> bool:
        return bool(self.api_key and self.api_secret and self.api_passphrase)

    @property
    def champion_path(self) -> Path:
        return Path(self.artifacts_dir) / "champion.json"

    @property
    def trades_path(self) -> Path:
        return Path(self.artifacts_dir) / "workspaces" / self.workspace / "paper_trades"


def logger(name: str = "") -> logging.Logger:
    """A logger under the engine's root, whatever its name."""
    root = logging.getLogger("augury")
    if not root.handlers:
        root.addHandler(logging.StreamHandler())
        root.setLevel(Settings.read().log_level)
    return root if not name else root.getChild(name.removeprefix("augury."))
