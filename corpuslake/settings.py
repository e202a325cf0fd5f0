"""Settings, with the defaults of a fresh installation."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    #: Accepted and without effect: chunks never overlap.
    overlap_tokens: int = 128


@dataclass(frozen=True)
class Querying:
    top_k: int = 5
    neighbor_radius: int = 1


@dataclass(frozen=True)
class Ingesting:
    filter_prompt: str | None = None
    filter_threshold: float = 0.5


@dataclass(frozen=True)
class Maintaining:
    stale_threshold: float = 0.3
    cold_chunk_days: int = 7
    quality_report_limit: int = 10


@dataclass(frozen=True)
class Schedules:
    watcher_seconds: int = 300
    maintenance_seconds: int = 21_600


@dataclass(frozen=True)
class Settings:
    chunker: Chunking = field(default_factory=Chunking)
    query: Querying = field(default_factory=Querying)
    ingest: Ingesting = field(default_factory=Ingesting)
    maintenance: Maintaining = field(default_factory=Maintaining)
    schedules: Schedules = field(default_factory=Schedules)
    corpus_path: str | None = None
    #: Where manifests and monitors lie; None: beside the store.
    manifest_dir: str | None = None
