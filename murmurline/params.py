"""Parameters of the daily panel; operators take them explicitly and read no clock."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SignalParams:
    """Window lengths in days, the age from which a document is stale, and the weights of the components."""

    window_days: int = 7
    min_history_days: int = 3
    max_doc_age_days: int = 7
    weights: dict[str, float] = field(default_factory=lambda: {"mention_growth": 0.25, "sentiment_momentum": 0.25, "topic_velocity": 0.25, "engagement_growth": 0.25})
