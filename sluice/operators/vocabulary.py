"""Vocabularies as parameters: terms of topics, their event profiles and source tiers."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    code: str
    entities: list[str]
    actions: list[str]
    evidence: list[str]
    negative: list[str] = field(default_factory=list)
    least: float = 5.0
    needs_entity: bool = True


@dataclass(frozen=True)
class Topic:
    keywords: list[str]
    news: list[str]
    promotion: list[str]
    communities: list[str]
    profiles: list[Profile]


@dataclass(frozen=True)
class Vocabulary:
    topics: dict[str, Topic]
    tiers: dict[str, int]
    low_trust: list[str]
    bursts: dict[str, float]
    stopwords: list[str]
    entity_aliases: dict[str, str] = field(default_factory=dict)
    action_aliases: dict[str, str] = field(default_factory=dict)
    noise: list[str] = field(default_factory=list)  # words that say nothing about an event, beside the stopwords

    def lists(self) -> dict[str, list[str]]:
        """All term lists by name: topic/keywords, /news, /promotion, /core (the first two) and topic/place/part of each profile."""
        out: dict[str, list[str]] = {}
        for name, t in self.topics.items():
            out |= {f"{name}/keywords": t.keywords, f"{name}/news": t.news, f"{name}/promotion": t.promotion, f"{name}/core": [*t.keywords, *t.news]}
            for i, p in enumerate(t.profiles):
                out |= {f"{name}/{i}/{part}": getattr(p, part) for part in ("entities", "actions", "evidence", "negative")}
        return out
