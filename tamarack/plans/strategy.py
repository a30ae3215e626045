"""Settings of a retrieval-augmented run, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

METHODS = ("non-retrieval", "single-retrieval", "fix-length-retrieval", "fix-sentence-retrieval", "token", "entity", "attn_entropy", "dragin")
QUERIES = ("direct", "forward_all", "current", "current_wo_wrong", "last_sentence", "last_n_tokens", "real_words")


@dataclass(frozen=True)
class Strategy:
    method: str
    retriever: str = "bm25"
    retrieve_topk: int = 3
    fewshot: int = 0
    query_formulation: str = "direct"
    hallucination_threshold: float = 0.5
    sentence_solver: str = "avg"
    shuffle: bool = False
    sample: int | None = None
    use_counter: bool = True
    index_paths: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.method.lower() not in METHODS:
            raise ValueError(f"unknown method {self.method}")
        if self.query_formulation not in QUERIES:
            raise ValueError(f"unknown query formulation {self.query_formulation}")
        if self.retrieve_topk < 1 or self.fewshot < 0:
            raise ValueError("retrieve_topk must be at least 1 and fewshot at least 0")

    @classmethod
    def of(cls, settings: dict[str, Any], exemplars: int = 5, **overrides: Any) -> "Strategy":
        """From a flat mapping; unknown keys are left out, a missing method is an error, ``fewshot`` is limited to the exemplars
        that exist, one path stands for a list of one."""
        if "method" not in settings:
            raise ValueError("the settings lack a method")
        names = {f.name for f in fields(cls)}
        known = {k: v for k, v in settings.items() if k in names}
        paths = known.get("index_paths", ())
        known["index_paths"] = (paths,) if isinstance(paths, str) else tuple(paths)
        s = replace(cls(**known), **{k: v for k, v in overrides.items() if v is not None})
        return replace(s, fewshot=min(s.fewshot, exemplars))


def broadcast_setting(values: Any, n: int) -> list[Any]:
    """One value for each of n indexes: a single one counts for all."""
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    if len(values) == 1:
        return values * n
    if len(values) != n:
        raise ValueError(f"{len(values)} values for {n} indexes")
    return values
