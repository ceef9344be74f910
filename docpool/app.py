"""A service from settings, and the command line: `python -m docpool.app [--version | --show-config [FILE]]`."""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import SparkSession

from docpool import __version__
from docpool.config import Config
from docpool.service import Service, Sweeper
from docpool.sources.content import HttpFetcher
from docpool.sources.remote import RemoteEmbedder, RemoteReranker, api_key
from docpool.sources.store import SnapshotStore

DEFAULT_CONFIG = "~/.docpool/docpool.yaml"
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}


def set_up_log(config: Config) -> logging.Handler:
    """Sends the log to stdout, stderr, or a file, whose folders are made."""
    path = config.log.path
    if path in ("stdout", "stderr"):
        handler: logging.Handler = logging.StreamHandler(getattr(sys, path))
    else:
        os.makedirs(os.path.dirname(path) or ".", mode=0o755, exist_ok=True)
        handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("time=%(asctime)s level=%(levelname)s msg=%(message)s"))
    log = logging.getLogger("docpool")
    log.addHandler(handler)
    log.setLevel(LEVELS[config.log.level])
    return handler


def open_service(spark: SparkSession, config: Config, environment: Mapping[str, str] | None = None) -> tuple[Service, Sweeper]:
    """The service and its sweeper, as the settings say; the key of the providers comes from the environment."""
    key = api_key(environment=environment)
    retention = timedelta(days=config.trash.retention_days)
    service = Service(
        SnapshotStore(spark, config.server.db_path, config.embedding.dim),
        RemoteEmbedder(key, config.embedding.model, config.embedding.dim, config.embedding.timeout_seconds),
        reranker=RemoteReranker(key, config.rerank.model, config.rerank.timeout_seconds),
        fetcher=HttpFetcher(config.fetcher.timeout_seconds, config.fetcher.allow_private),
        max_chunk_size=config.chunker.max_chunk_size,
        retention=retention,
        k1=config.bm25.k1,
        b=config.bm25.b,
    )
    return service, Sweeper(service, config.trash.interval_seconds, retention)


def shown(config: Config, path: str) -> str:
    rows = {
        "version": __version__, "config_path": path, "log.path": config.log.path, "log.level": config.log.level,
        "server.db_path": config.server.db_path, "server.port": config.server.port, "embedding.model": config.embedding.model,
    }
    return "\n".join(f"{name}: {value}" for name, value in rows.items())


def main(arguments: Sequence[str]) -> int:
    if arguments[:1] in (["--version"], ["-v"]):
        print(__version__)
        return 0
    if arguments[:1] == ["--show-config"]:
        path = arguments[1] if len(arguments) > 1 else DEFAULT_CONFIG
        try:
            print(shown(Config.load(path), path))
        except (OSError, ValueError, ImportError) as e:
            print(f"settings can't be read: {e}", file=sys.stderr)
            return 1
        return 0
    print(__doc__, file=sys.stderr)
    return 2


def run() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    run()
