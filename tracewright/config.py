"""All settings of a run, in one immutable object."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, replace

MODES = ("fusion", "audit_only", "pcap_only")
ENCODERS = ("tfidf", "bge-m3", "hashing")
STAGES = ("all", "tokenize", "stats")
BUNDLE_VERSION = 2


@dataclass(frozen=True)
class Settings:
    mode: str = "fusion"
    audit_encoder: str = "tfidf"
    net_encoder: str = "hashing"
    require_both: bool = True
    audit_max_features: int = 100_000
    net_max_features: int = 5_000
    min_df: int = 2
    max_df: float = 0.95
    host_weight: float = 1.0
    net_weight: float = 2.0
    chunk_tokens: int = 384
    chunk_stride: int = 384
    pooling: str = "mean"
    embedding_dim: int = 1024
    window: int = 3000
    overlap: int = 300
    max_repeat: int = 30
    svm_c: float = 1.0
    folds: int = 10
    max_samples_per_class: int = 0
    seed: int = 42
    encoder_path: str = os.environ.get("BGE_MODEL_PATH") or os.environ.get("BGE_MODEL") or "BAAI/bge-m3"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.audit_encoder not in ENCODERS or self.net_encoder not in ENCODERS:
            raise ValueError(f"an encoder must be one of {ENCODERS}")
        if self.pooling not in ("mean", "max"):
            raise ValueError("pooling must be mean or max")

    def with_(self, **changes: object) -> Settings:
        return replace(self, **changes)

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"bundle_version": BUNDLE_VERSION}, indent=2)


def settings_from_json(text: str) -> Settings:
    """Settings of a bundle; another version is accepted with a warning, unknown names are left out."""
    import warnings

    values = json.loads(text)
    if values.pop("bundle_version", None) != BUNDLE_VERSION:
        warnings.warn("bundle of another version", stacklevel=2)
    return Settings(**{k: v for k, v in values.items() if k in Settings.__dataclass_fields__})
