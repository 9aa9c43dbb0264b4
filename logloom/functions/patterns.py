"""User patterns: named groups made positional for Java, and patterns that don't compile left out."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Pattern:
    """A pattern without group names, and the place of each name."""

    text: str
    names: tuple[tuple[str, int], ...]
    groups: int

    def place(self, name: str) -> int | None:
        return dict(self.names).get(name)


def translate(pattern: str, unicode: bool = False) -> Pattern | None:
    """The pattern as Java reads it, or None (with a warning) if it doesn't compile."""
    try:
        known = re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern))
    except re.error as e:
        log.warning("pattern left out: %s: %s", pattern, e)
        return None
    text = re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
    return Pattern(("(?U)" if unicode else "") + text, tuple(sorted(known.groupindex.items(), key=lambda kv: kv[1])), known.groups)
