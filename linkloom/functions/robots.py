"""Whether a site's robots.txt lets a url be fetched; the text is given, nothing here fetches it."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser


@lru_cache(maxsize=1024)
def _rules(text: str) -> RobotFileParser:
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return rules


def can_fetch(robots: str | None, agent: str, url: str) -> bool:
    """True where there is no robots.txt, or none that can be read."""
    if robots is None:
        return True
    try:
        return _rules(robots).can_fetch(agent, url)
    except ValueError:
        return True
