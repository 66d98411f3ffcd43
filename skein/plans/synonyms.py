"""Synonym groups for query expansion."""

from __future__ import annotations

from pathlib import Path


class Synonyms:
    """Words and their groups; a word belongs to the first group that lists it."""

    def __init__(self, groups: list[list[str]]):
        self._group: dict[str, list[str]] = {}
        for group in groups:
            words = sorted({w.lower() for w in group})
            for w in words:
                self._group.setdefault(w, words)

    def expand(self, word: str) -> list[str]:
        """The sorted group of a word, or nothing if it has no group of two or more."""
        group = self._group.get(word.lower(), [])
        return group if len(group) > 1 else []


def default_synonyms() -> Synonyms:
    lines = (Path(__file__).parent.parent / "data" / "synonyms.txt").read_text().splitlines()
    return Synonyms([x.split() for x in lines if x.strip() and not x.startswith("#")])
