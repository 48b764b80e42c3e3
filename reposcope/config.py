"""Settings: defaults, limits, and whatever a user gave made to fit them."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields, replace

#: Limits of numbers, choices of words, tools of each surface.
LIMITS = {"refresh_interval_seconds": (5, 3600), "warm_limit": (0, 50), "default_budget_tokens": (256, 32_000)}
CHOICES = {"instruction_style": ("playbook", "budget", "short", "off"), "tool_surface": ("lean", "full")}
LEAN_TOOLS = ("codebase_query", "instant_grep", "prechange_impact", "verify_change")
FULL_TOOLS = ("instant_grep", "codebase_query", "code_graph_context", "repository_context", "symbol_lookup", "prechange_impact", "verify_change")


@dataclass(frozen=True)
class Config:
    auto_index: bool = True
    respect_gitignore: bool = True
    include_hidden_directories: bool = False
    background_refresh: bool = True
    refresh_interval_seconds: int = 30
    warm_limit: int = 4
    include_snippets: bool = True
    use_cochange: bool = True
    default_budget_tokens: int = 4000
    instruction_style: str = "playbook"
    tool_surface: str = "lean"

    def merge(self, patch: dict) -> Config:
        """With what the patch gives; what it does not give stays, what does not fit gets its default."""
        return normalize(asdict(self) | patch)

    def tools(self) -> tuple[str, ...]:
        return FULL_TOOLS if self.tool_surface == "full" else LEAN_TOOLS


def normalize(value: object) -> Config:
    """A configuration of anything: numbers are rounded and held within their limits; a value of another
    kind, or a word that is no choice, gives way to the default; unknown keys are left out."""
    given = value if isinstance(value, dict) else {}
    made = {}
    for f in fields(Config):
        x = given.get(f.name)
        if f.name in LIMITS:
            low, high = LIMITS[f.name]
            if isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x):
                made[f.name] = min(high, max(low, math.floor(x + 0.5)))
        elif f.name in CHOICES:
            if x in CHOICES[f.name]:
                made[f.name] = x
        elif isinstance(x, bool):
            made[f.name] = x
    return replace(Config(), **made)


def load(path: str) -> Config:
    """From a JSON file; a missing or broken one gives the defaults."""
    try:
        with open(path, encoding="utf-8") as source:
            return normalize(json.load(source))
    except (OSError, ValueError):
        return Config()


def save(config: Config, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(asdict(config), out, indent=2)
