"""Configuration: a TOML file over defaults."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Config:
    """Defaults are fixed values of the search engine's data model. ``model`` is the directory of an embedding model."""

    index_dir: str = str(Path.home() / ".sondage" / "indexes")
    exclude_patterns: list[str] = field(default_factory=lambda: ["*.min.js", "*.min.css", "*.lock", "package-lock.json", "yarn.lock"])
    model: str = ""
    max_file_size: int = 10 * 1024 * 1024
    context_lines: int = 2
    top_k: int = 20
    rrf_k: int = 60
    score_threshold: float = 0.0
    batch_size: int = 32
    host: str = "127.0.0.1"
    port: int = 7720

    def save(self, path: str) -> None:
        """Write as TOML; JSON's strings, numbers and lists are TOML's."""
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("".join(f"{k} = {json.dumps(v)}\n" for k, v in asdict(self).items()), encoding="utf-8")


def load(path: str) -> Config:
    """The configuration under ``path``; where there is none, the defaults, which are then written there if possible."""
    source = Path(path)
    if source.exists():
        known = Config.__dataclass_fields__
        return Config(**{k: v for k, v in tomllib.loads(source.read_text(encoding="utf-8")).items() if k in known})
    config = Config()
    try:
        config.save(path)
    except OSError:
        pass
    return config
