"""Model calls behind small protocols, with deterministic offline stand-ins."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str], mode: str = "document", instruct: str = "") -> list[list[float]]:
        """One vector a text, in order.  ``mode`` is ``document`` or ``query``."""
        ...


class Reranker(Protocol):
    def rerank(self, query: str, documents: Sequence[str], top_n: int) -> list[tuple[int, float]]:
        """(index, relevance) of the best ``top_n``, best first."""
        ...


class LanguageModel(Protocol):
    def complete(self, task: str, prompt: str, max_tokens: int) -> str:
        """The answer to a prompt; ``task`` is intent, expand, hyde or answer."""
        ...


def _grams(text: str) -> list[str]:
    text = re.sub(r"\s+", " ", text.lower())
    return [text[i : i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1)]


@dataclass
class HashEmbedder:
    """Signed hashed character grams, unit length."""

    dimension: int = 64

    def embed(self, texts: Sequence[str], mode: str = "document", instruct: str = "") -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for g in _grams(t or ""):
                h = zlib.crc32(g.encode())
                v[h % self.dimension] += 1 if h >> 31 else -1
            out.append((v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
        return out


@dataclass
class OverlapReranker:
    """Share of the query's character grams that the document has."""

    def rerank(self, query: str, documents: Sequence[str], top_n: int) -> list[tuple[int, float]]:
        q = set(_grams(query))
        scores = [(i, len(q & set(_grams(d or ""))) / max(len(q), 1)) for i, d in enumerate(documents)]
        return sorted(scores, key=lambda x: (-x[1], x[0]))[:top_n]


@dataclass
class OfflineModel:
    """Rule-based stand-in: finds room names, returns the question as its only sub-query, quotes the context's head."""

    room_types: Sequence[str] = ()
    room_classes: Sequence[str] = ("大床房", "双床房", "家庭房")
    recent_words: Sequence[str] = ("最近", "近期", "现在", "recent", "latest", "now")
    log: list[tuple[str, str]] = field(default_factory=list)

    def complete(self, task: str, prompt: str, max_tokens: int) -> str:
        self.log.append((task, prompt))
        if task == "intent":
            find = lambda names: next((n for n in names if n and n in prompt), None)
            recent = True if any(w in prompt.lower() for w in self.recent_words) else None
            return json.dumps({"room_type": find(self.room_types), "fuzzy_room_type": find(self.room_classes), "time_sensitivity": recent}, ensure_ascii=False)
        if task == "expand":
            return json.dumps([{"query": prompt, "weight": 1.0}], ensure_ascii=False)
        if task == "hyde":
            return f"{prompt} 住下来的感受如下。"
        return prompt[:max_tokens]


def parse_json(text: str, fallback):  # noqa: ANN001, ANN201
    """JSON with code fences stripped; ``fallback`` where it is malformed."""
    try:
        return json.loads(re.sub(r"```(?:json)?\s*", "", text).strip())
    except (ValueError, TypeError):
        return fallback


def parse_intent(text: str) -> dict[str, str | None]:
    """Intent with its three keys; values become strings, so that ``false`` still counts as given."""
    raw = parse_json(text, {})
    raw = raw if isinstance(raw, dict) else {}
    as_text = lambda v: None if v is None else (str(v).lower() if isinstance(v, bool) else str(v))
    return {k: as_text(raw.get(k)) for k in ("room_type", "fuzzy_room_type", "time_sensitivity")}


def parse_sub_queries(text: str, query: str) -> list[tuple[str, float]]:
    """(query, weight) pairs; the original question with weight 1 where the shape is wrong or empty."""
    raw = parse_json(text, None)
    raw = [raw] if isinstance(raw, dict) else raw
    out = []
    for x in raw if isinstance(raw, list) else []:
        if isinstance(x, dict) and isinstance(x.get("query"), str) and x["query"].strip():
            weight = x.get("weight", 1.0)
            out.append((x["query"].strip(), float(weight) if isinstance(weight, int | float) else 1.0))
    return out or [(query, 1.0)]
