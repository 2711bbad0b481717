"""Engine settings: defaults, overridden by ``.env``, by ``spark.tessera.*`` and by environment variables of the same upper-case names."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache


@dataclass(frozen=True)
class Settings:
    repos_dir: str = "./repos"
    index_dir: str = "./index"
    top_k_results: int = 5
    min_relevance_score: float = 0.30
    chunk_size: int = 1000
    chunk_overlap: int = 200
    file_size_cap_bytes: int = 512_000
    use_graph: bool = True
    use_bm25: bool = True
    hybrid_rrf_k: int = 60
    graph_max_hops: int = 2
    bm25_top_k: int = 20
    vector_top_k: int = 20
    use_semantic_cache: bool = True
    semantic_cache_threshold: float = 0.93
    semantic_cache_max_size: int = 1000
    use_reranker: bool = True
    use_cross_repo_linking: bool = True
    drift_similarity_threshold: float = 0.999
    api_key: str | None = None
    broadcast_rows: int = 1_000_000  # a side of at most so many counted rows,
    broadcast_bytes: int = 32 << 20  # and of at most so many bytes, may be broadcast


def _env_file(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file, where there is one; '#' begins a comment, quotes around a value go."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip().removeprefix("export ").strip().upper(): v.strip().strip("'\"") for k, _, v in pairs}


def _session() -> dict[str, str]:
    """Settings of the active Spark session under ``spark.tessera.``."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    keys = [f.name for f in fields(Settings)] if spark is not None else []
    found = {k.upper(): spark.conf.get(f"spark.tessera.{k}", None) for k in keys}
    return {k: v for k, v in found.items() if v is not None}


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    """The settings of this process: the environment before the session's configuration, that before ``.env``, that before the defaults.

    ``get_settings.cache_clear()`` reads them again.
    """
    known, given = _env_file() | _session() | dict(os.environ), {}
    for f in fields(Settings):
        raw = known.get(f.name.upper())
        if raw is None:
            continue
        kind = type(f.default)
        if f.default is None:
            given[f.name] = raw.strip() or None
        elif kind is bool:
            given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
        else:
            given[f.name] = kind(raw)
    return Settings(**given)
