"""Parameters of matching and retention, with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from ..functions.quality import TIERS

# The retention tiers in their default order.
RETENTION_ORDER = ("duration_accurate", "quality_best", "ctime_best", "album_best", "release_best", "scrape_best", "meta_best")


@dataclass(frozen=True)
class Config:
    """``compat`` keeps the original's removal of noise words inside words; ``exact_only`` trusts exact enrichment alone;
    ``bucket_limit`` (600 in the original) leaves duration buckets of more rows to the segment keys."""

    threshold: float = 0.90
    second: float = 0.90
    very_high: float = 0.97
    second_exact: float = 0.98
    tolerance: float = 5.0
    segments: int = 5
    band: float = 4.0
    bucket_limit: int | None = None
    compat: bool = True
    exact_only: bool = False
    tier_order: tuple[str, ...] = TIERS
    retention_order: tuple[str, ...] = RETENTION_ORDER

    def to_json(self) -> str:
        """The settings as text."""
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Config:
        """Settings from text; unknown ones are ignored, missing ones have their defaults."""
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text or "{}").items() if k in Config.__dataclass_fields__}
        return replace(Config(), **known)


def merged_order(saved: list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    """A saved order, completed by the tiers it lacks."""
    own = tuple(saved or ())
    return own + tuple(k for k in RETENTION_ORDER if k not in own)
