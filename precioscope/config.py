"""Settings of a price-watch round."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of thresholds and quotas."""

    accept_score: int = 62
    ambiguous_band: int = 14
    relevant_drop: float = 5.0
    store_spread: float = 0.05
    products_per_query: int = 40
    pages_per_sitemap: int = 8
    coupon_checks: int = 8
    coupon_checks_per_store: int = 3
    coupon_recheck_hours: int = 12
    enrich_pages: int = 6
    round_minutes: int = 60
    kept_rounds: int = 60
    price_tolerance: float = 0.35
    wide_price_tolerance: float = 0.40
    page_price_gap: float = 0.01
    refusal_rest_hours: int = 24


DEFAULTS = Settings()
