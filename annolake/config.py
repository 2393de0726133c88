"""Configuration from environment variables, with defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Each field is read from the variable of its name in capitals: text, whole and decimal numbers, a switch (0 or 1), or a set (values between commas)."""

    openai_model: str = "gpt-4o-mini"
    openai_temperature: float = 0.0
    openai_max_retries: int = 3
    human_review_qa_statuses: frozenset[str] = frozenset({"needs_review", "pending_new_label_review"})
    usable_qa_statuses: frozenset[str] = frozenset({"approved", "approved_auto_new_label"})
    force_reembed: bool = False


def from_environment(env: Mapping[str, str] = os.environ) -> Config:
    """The configuration of env; variables that are unset or blank leave the default, and one that can't be read is an error."""
    read = {}
    for f in fields(Config):
        text = env.get(f.name.upper(), "").strip()
        if text:
            default = f.default
            if isinstance(default, bool):
                read[f.name] = bool(int(text))
            elif isinstance(default, frozenset):
                read[f.name] = frozenset(x.strip() for x in text.split(",") if x.strip())
            else:
                read[f.name] = type(default)(text)
    return Config(**read)
