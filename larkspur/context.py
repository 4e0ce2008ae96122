"""The clock and the settings that every derived relation reads."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

#: Settings of the ranker and of the offline layer.
SETTINGS = {
    "weight_similarity": 0.50,
    "weight_category": 0.20,
    "weight_popularity": 0.15,
    "weight_rating": 0.10,
    "weight_recency": 0.05,
    "popularity_half_life": 30.0,
    "affinity_half_life": 60.0,
    "max_anchors_per_user": 50,
    "max_neighbours_per_item": 50,
    "min_common_users": 3,
    "cold_start_threshold": 3,
    "light_user_threshold": 10,
    "reason_similarity_cut": 0.80,
    "reason_affinity_cut": 0.70,
    "reason_popularity_cut": 0.80,
}

#: Funnel weight and stage of each interaction type.
FUNNEL = {"view": (1, 1), "wishlist": (3, 2), "cart": (5, 3), "purchase": (10, 4)}


@dataclass(frozen=True)
class Context:
    """What is known strictly before ``as_of``; rewinding makes a new context."""

    as_of: datetime
    mode: str = "production"
    settings: dict[str, float] = field(default_factory=lambda: dict(SETTINGS))

    def with_as_of(self, as_of: datetime, mode: str = "evaluation") -> Context:
        return replace(self, as_of=as_of, mode=mode)

    def __getitem__(self, key: str) -> float:
        return self.settings[key]
