"""Degradation as a planner's choice: ladders of operators and the rule that moves along them.  No network is measured here."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

DEGRADE_BELOW, UPGRADE_ABOVE = 0.95, 1.1


def choose_level(ratio: float, levels: Sequence[float], current: int) -> int:
    """The level of a ladder of carried shares (ascending) for a capacity ratio: down to what fits, up half-way."""
    carried = levels[current]
    if ratio < DEGRADE_BELOW:
        fitting = [i for i in range(current) if levels[i] <= carried * ratio]
        return max(fitting) if fitting else 0
    if ratio > UPGRADE_ABOVE and current < len(levels) - 1:
        affordable = max((i for i in range(current + 1, len(levels)) if levels[i] <= carried * ratio), default=current)
        return current + max(1, (affordable - current) // 2) if affordable > current else current
    return current


@dataclass
class Ladder:
    name: str
    levels: Sequence[float]
    current: int | None = None

    def __post_init__(self):
        if self.current is None:
            self.current = len(self.levels) - 1


class Policy:
    """Ladders by priority: the first degrades first, the last recovers first; one moves at a time, at most once a second."""

    def __init__(self, ladders: Sequence[Ladder], pause: float = 1.0):
        self.ladders, self.pause, self.last = list(ladders), pause, float("-inf")

    def react(self, ratio: float, now: float) -> str | None:
        """The name of the ladder that moved, if one did."""
        if now - self.last < self.pause:
            return None
        order = self.ladders if ratio < DEGRADE_BELOW else self.ladders[::-1]
        for ladder in order:
            level = choose_level(ratio, ladder.levels, ladder.current)
            if level != ladder.current:
                ladder.current, self.last = level, now
                return ladder.name
        return None
