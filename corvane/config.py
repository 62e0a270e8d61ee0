"""One flat configuration, as used on the driver; never a table."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

#: Extensions that never hold text worth indexing, by family.
BINARY_EXTENSIONS = tuple(
    "." + e
    for family in (
        "7z a avi bin bmp bz2 dll doc docx dylib eot exe flv gif gz ico jpeg jpg mov mp3 mp4 o obj otf pdf png ppt pptx rar so svg tar ttf wav webp woff woff2 xls xlsx zip",
        "class lock map min.css min.js pyc pyo wasm",
        "arrow db feather npy npz parquet pickle pkl sqlite",
    )
    for e in family.split()
)


@dataclass(frozen=True)
class Config:
    """Defaults of the engine; ``Config.from_env`` overrides any field by CORVANE_<FIELD>."""

    embed_dim: int = 384
    max_chunk_chars: int = 800
    chunk_overlap: int = 100
    chunk_context_header: bool = True
    max_file_size_bytes: int = 1_000_000
    binary_sample_bytes: int = 2048
    binary_null_threshold: float = 0.10
    generated_markers: tuple[str, ...] = ("@generated", "DO NOT EDIT", "auto-generated", "AUTO GENERATED")
    exclude_extensions: tuple[str, ...] = BINARY_EXTENSIONS
    exclude_dirs: tuple[str, ...] = (
        "*.egg-info", ".corvane", ".eggs", ".git", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".tox", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "venv")
    binary_top_k: int = 200
    ann_top_k: int = 50
    fts_top_k: int = 50
    fusion_k: int = 60
    rerank_pool: int = 50
    rerank_weight: float = 0.7
    top_k: int = 20
    max_seeds: int = 10
    seed_mode: str = "raw"
    fts_sanitize: bool = False
    expansion_top_k: int = 5
    expansion_threshold: float = 0.35
    private_margin: float = 0.1
    expand_hops: int = 1
    entity_depth: int = 2
    hot_hours: float = 24.0
    cold_hours: float = 168.0
    shards: int = 4

    @classmethod
    def from_env(cls, **overrides) -> "Config":
        said = {}
        for f in fields(cls):
            raw = os.environ.get(f"CORVANE_{f.name.upper()}")
            if raw is not None and f.type.startswith("tuple"):
                said[f.name] = tuple(part.strip() for part in raw.split(",") if part.strip())
            elif raw is not None:
                said[f.name] = raw.lower() in ("1", "true", "yes") if f.type == "bool" else {"int": int, "float": float, "str": str}[f.type](raw)
        return cls(**(said | overrides))

    def small(self) -> "Config":
        """A preset for tests and tiny corpora."""
        return replace(self, binary_top_k=50, ann_top_k=20, rerank_pool=10)
