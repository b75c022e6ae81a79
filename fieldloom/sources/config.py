"""Settings from a base and an overlay."""

from __future__ import annotations


def overlay(base: dict, over: dict) -> dict:
    """A copy of base in which over's values win; dictionaries are merged at every depth."""
    out = dict(base)
    for k, v in over.items():
        out[k] = overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def stages_from(stages: list[str], only: str | None = None, start: str | None = None) -> list[str]:
    """The stages to run: one by name, or all from one on."""
    if only is not None:
        return [s for s in stages if s == only]
    return stages[stages.index(start) :] if start is not None else list(stages)
