"""Record schemas and ranking constants."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

COMMENTS = "doc_id string, comment string, room_type string, fuzzy_room_type string, score double, publish_date string, quality_score int, comment_len int, useful_count int, review_count int, images string"
REVERSE_QUERIES = "query string, comment_id string, comment string, room_type string, fuzzy_room_type string"
SUMMARIES = "category string, keywords string, summary string, comment_count int"

#: Column -> what a missing value becomes.
DEFAULTS: dict[str, object] = {
    "comment": "", "room_type": "", "fuzzy_room_type": "", "score": 0.0, "publish_date": "",
    "quality_score": 0, "comment_len": 0, "useful_count": 0, "review_count": 0, "images": "",
}
#: Order of the routes inside a sub-query; the hypothetical answer's list comes last.
ROUTES = {"text": 0, "vector": 1, "reverse": 2}
HYDE_LIST = 1_000_000


@dataclass(frozen=True)
class Weights:
    """Shares of the composite score."""

    relevance: float = 0.40
    quality: float = 0.25
    length: float = 0.05
    reviews: float = 0.05
    likes: float = 0.05
    timeliness: float = 0.20


@dataclass(frozen=True)
class SearchConfig:
    """Depths of the stages and constants of the formulas."""

    topk_recall: int = 150
    topk_rerank: int = 40
    topk_final: int = 10
    topk_summary: int = 3
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    reference_date: date = date(2025, 4, 16)
    horizon_days: int = 730
    weights: Weights = field(default_factory=Weights)

    @property
    def candidates(self) -> int:
        """How many fused records go to the reranker."""
        return self.topk_rerank * 2
