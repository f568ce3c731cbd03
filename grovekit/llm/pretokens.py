"""Splitting by the public pattern of the rank files, with a memory of what has been split.

A match of the pattern never crosses from a run of other characters into white
space except to begin with one blank. So a text is cut at white space by a
plain expression first, and only chunks not seen before need the full pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import regex

#: The characters with Unicode's White_Space property, as the pattern's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def matcher(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a chunk; \\s means White_Space."""
    own = pattern.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")
    return regex.compile(own).findall


def split_chunk(chunk: str, full: Callable[[str], list[str]]) -> list[str]:
    """The matches in a chunk; one of Latin letters only, with or without a blank before, is one match."""
    if (chunk.isalpha() or chunk[1:].isalpha() and chunk[0] == " ") and (chunk.isascii() or max(chunk) < "\u0250"):
        return [chunk]
    return full(chunk)


class Memory:
    """What has been worked out for chunks, up to ``limit`` of them; then it starts anew.

    ``work`` gets the chunks that are not known, all at once, and returns a value for each.
    """

    def __init__(self, work: Callable[[list[str]], list], limit: int = 300_000, longest: int = 200) -> None:
        self.work, self.limit, self.longest, self.known = work, limit, longest, {}

    def values(self, texts: Iterable[str]) -> list[list]:
        """For each text, the values of its chunks in order."""
        cut = [CHUNK.findall(t) for t in texts]
        wanted: set[str] = set()
        wanted.update(*cut)
        if len(self.known) > self.limit:
            self.known.clear()
        new = [c for c in wanted if c not in self.known]
        self.known.update(zip(new, self.work(new), strict=True))
        out = [list(map(self.known.__getitem__, c)) for c in cut]
        for c in new:
            if len(c) > self.longest:
                del self.known[c]
        return out
