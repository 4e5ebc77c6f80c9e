"""Sizes and limits of the tiers, validated on construction."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """tiny and medium: greatest sizes in bytes of these tiers. The others: slots, pages and shares of the cache's levels."""

    tiny: int = 128
    medium: int = 2048
    shards: int = 8
    buckets: int = 16
    landing_slots: int = 3
    leaf_slots: int = 30
    page_entries: int = 340
    alignment: int = 4096
    payload_bytes: int = 128
    evict_at: float = 0.9
    evict_share: float = 0.1
    compact_percent: int = 75
    leaves_per_pass: int = 128
    queue_slots: int = 4096
    max_key_bytes: int = 256

    def __post_init__(self):
        if not 0 < self.tiny < self.medium:
            raise ValueError("0 < tiny < medium is required")
        if not 1 <= self.shards <= 1024:
            raise ValueError("shards: 1 to 1024")

    def with_thresholds(self, tiny: int, medium: int) -> Config:
        return Config(**{**self.__dict__, "tiny": tiny, "medium": medium})


DEFAULT = Config()
