"""Settings: a section for each part, strictly checked."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from typing import Any


def expand_home(path: str) -> str:
    """`~` and `~/x` under the home folder; another user's home is left as it is."""
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def _need(ok: bool, name: str, rule: str, value: Any) -> None:
    if not ok:
        raise ValueError(f"{name} must be {rule}, not {value!r}")


@dataclass
class Server:
    port: int
    db_path: str

    def check(self) -> None:
        _need(1 <= self.port <= 65535, "server.port", "from 1 to 65535", self.port)
        _need(bool(self.db_path), "server.db_path", "given", self.db_path)


@dataclass
class Embedding:
    model: str
    dim: int
    timeout_seconds: int

    def check(self) -> None:
        _need(bool(self.model), "embedding.model", "given", self.model)
        _need(self.dim > 0, "embedding.dim", "positive", self.dim)
        _need(self.timeout_seconds > 0, "embedding.timeout_seconds", "positive", self.timeout_seconds)


@dataclass
class Rerank:
    model: str
    factor: int
    timeout_seconds: int

    def check(self) -> None:
        _need(bool(self.model), "rerank.model", "given", self.model)
        _need(self.factor > 0, "rerank.factor", "positive", self.factor)
        _need(self.timeout_seconds > 0, "rerank.timeout_seconds", "positive", self.timeout_seconds)


@dataclass
class Chunker:
    max_chunk_size: int

    def check(self) -> None:
        _need(self.max_chunk_size > 0, "chunker.max_chunk_size", "positive", self.max_chunk_size)


@dataclass
class Bm25:
    k1: float
    b: float

    def check(self) -> None:
        _need(self.k1 > 0, "bm25.k1", "positive", self.k1)
        _need(0 <= self.b <= 1, "bm25.b", "from 0 to 1", self.b)


@dataclass
class Fetcher:
    timeout_seconds: int
    allow_private: bool

    def check(self) -> None:
        _need(self.timeout_seconds > 0, "fetcher.timeout_seconds", "positive", self.timeout_seconds)


@dataclass
class Trash:
    retention_days: int
    interval_seconds: int

    def check(self) -> None:
        _need(self.retention_days > 0, "trash.retention_days", "positive", self.retention_days)
        _need(self.interval_seconds > 0, "trash.interval_seconds", "positive", self.interval_seconds)


@dataclass
class Log:
    path: str = "~/.docpool/docpool.log"
    level: str = "info"

    def check(self) -> None:
        _need(bool(self.path), "log.path", "given", self.path)
        _need(self.level in ("debug", "info", "warn", "error"), "log.level", "debug, info, warn or error", self.level)


@dataclass
class Config:
    """All settings; only `log` may be left out."""

    server: Server
    embedding: Embedding
    rerank: Rerank
    chunker: Chunker
    bm25: Bm25
    fetcher: Fetcher
    trash: Trash
    log: Log = field(default_factory=Log)

    @classmethod
    def of(cls, values: dict[str, Any]) -> Config:
        """Checks sections, names, types and ranges; unknown or missing names are errors."""
        kinds = {"server": Server, "embedding": Embedding, "rerank": Rerank, "chunker": Chunker, "bm25": Bm25, "fetcher": Fetcher, "trash": Trash, "log": Log}
        types = {"int": (int,), "float": (int, float), "str": (str,), "bool": (bool,)}
        if unknown := sorted(set(values) - set(kinds)):
            raise ValueError(f"unknown sections: {', '.join(unknown)}")
        parts = {}
        for name, kind in kinds.items():
            given = values.get(name)
            if given is None:
                if name != "log":
                    raise ValueError(f"section {name} is missing")
                given = {}
            known = {f.name: types[str(f.type)] for f in fields(kind)}
            if unknown := sorted(set(given) - set(known)):
                raise ValueError(f"unknown names in {name}: {', '.join(unknown)}")
            if name != "log" and (missing := sorted(set(known) - set(given))):
                raise ValueError(f"missing in {name}: {', '.join(missing)}")
            for n, v in given.items():
                if not isinstance(v, known[n]) or isinstance(v, bool) and bool not in known[n]:
                    raise ValueError(f"{name}.{n} has the wrong type: {v!r}")
            parts[name] = kind(**{n: v for n, v in given.items() if not (name == "log" and v == "")})
            parts[name].check()
        config = cls(**parts)
        config.server.db_path = expand_home(config.server.db_path)
        if config.log.path not in ("stdout", "stderr"):
            config.log.path = expand_home(config.log.path)
        return config

    @classmethod
    def load(cls, path: str) -> Config:
        """Reads a YAML file, if PyYAML is there."""
        import yaml

        with open(expand_home(path), encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f) or {})
