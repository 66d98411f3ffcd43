"""The search language: user text to match expressions, and their syntax trees."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from skein.functions.analysis import tokens_py
from skein.plans.synonyms import Synonyms

#: Names that users write for columns, signs that force a quoted phrase, and the shortest word (in bytes) that gets a wildcard.
ALIASES = {"from": "from_", "to": "to_"}
QUOTING = set("-@:+.")
WILDCARD_BYTES = 4
_ALIAS = re.compile(r"(?<![A-Za-z0-9_])(from|to)\s*:", re.I)
_FIELD_PHRASE = re.compile(r'([A-Za-z_][A-Za-z0-9_]*):"([^"]*)"')
_FIELD = re.compile(r"([A-Za-z_][^:]*):(.*)", re.S)
_MATCH = re.compile(r'\s*(?:([A-Za-z_][A-Za-z0-9_]*)\s*:\s*)?([()])|\s*(?:([A-Za-z_][A-Za-z0-9_]*)\s*:\s*)?(?:"((?:[^"]|"")*)"(\*)?|([^\s()"*:]+)(\*)?)')


class QueryError(ValueError):
    """A query that no table can answer."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens, the last perhaps a prefix, in one column or in any."""

    tokens: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Scope:
    """An opening parenthesis with a column for all in it."""

    column: str


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    """Left without right."""

    left: object
    right: object


def _word(word: str) -> tuple[str, bool, bool]:
    """(text, wildcard asked for, must be quoted) of an unquoted word."""
    star = word.endswith("*")
    text = (word[:-1] if star else word).rstrip("/?").replace("'", "")
    if star and not text:
        text = "."
    return text, star, bool(QUOTING & set(text)) or any(not (c.isalnum() or c == "_") for c in text)


def compile_query(query: str, synonyms: Synonyms) -> str:
    """The match expression of a user's query, or an empty text.

    Field names, phrases in quotes, trailing wildcards and AND, OR, NOT and
    parentheses pass through, a field name before a parenthesis holds for all
    in it, and NEAR(...) is refused. Words of four bytes and more match as prefixes,
    unless a word in the same unquoted part has synonyms: then all its words
    match exactly and synonyms are alternatives.
    """
    query = _ALIAS.sub(lambda m: ALIASES[m.group(1).lower()] + ":", query.strip())
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(f'{m.group(1)}:"{m.group(2)}"')
        return f" \x00{len(held) - 1} "

    parts = _FIELD_PHRASE.sub(hold, query).split('"')
    out: list[str] = []
    grouped = False
    for at, part in enumerate(parts):
        if at % 2:
            if part.strip():
                out.append(f'"{part}"')
            continue
        if "NEAR(" in part:
            raise QueryError("NEAR is not supported")
        words = re.findall(r"\x00\d+|[A-Za-z_][A-Za-z0-9_]*:\(|[()]|[^\s()]+", part)
        plain = [w for w in words if w[0] != "\x00" and w not in ("AND", "OR", "NOT", ")") and w[-1] != "("]
        expands = any(not _FIELD.fullmatch(w) and not w.endswith("*") and synonyms.expand(_word(w)[0]) for w in plain)
        for w in words:
            if w[0] == "\x00":
                out.append(held[int(w[1:])])
                continue
            if w in ("AND", "OR", "NOT", ")") or w[-1] == "(":
                out.append(w)
                continue
            if all(c in string.punctuation for c in w):
                continue
            field = _FIELD.fullmatch(w)
            name, raw = (field.group(1), field.group(2)) if field else (None, w)
            if name is not None and not raw:
                continue
            text, star, quote = _word(raw)
            if not text:
                continue
            prefix = f"{name}:" if name else ""
            if quote:
                out.append(f'{prefix}"{text}"')
            elif star:
                out.append(f"{prefix}{text}*")
            elif name is None and (group := synonyms.expand(text)):
                grouped = True
                out.append("(" + " OR ".join(group) + ")")
            else:
                out.append(prefix + text + ("*" if len(text.encode()) >= WILDCARD_BYTES and not expands else ""))
    if not grouped:
        return " ".join(out)
    joined: list[str] = []
    for piece in out:
        if joined and joined[-1] not in ("AND", "OR", "NOT") and joined[-1][-1] != "(" and piece not in ("AND", "OR", "NOT", ")"):
            joined.append("AND")
        joined.append(piece)
    return " ".join(joined)


def parse_match(expression: str, columns: list[str], analyse=tokens_py) -> object | None:
    """The tree of a match expression; AND is implicit, NOT binds closest, then AND, then OR. None for an empty one."""
    items: list[object] = []
    at = 0
    while at < len(expression.rstrip()):
        m = _MATCH.match(expression, at)
        if not m or m.end() == at:
            raise QueryError(f"syntax error near {expression[at:at + 20]!r}")
        at = m.end()
        held, bracket, column, quoted, quoted_star, bare, star = m.groups()
        if held is not None and (bracket == ")" or held not in columns):
            raise QueryError(f"no such column: {held}")
        if bracket:
            items.append(bracket if held is None else Scope(held))
        elif quoted is None and column is None and bare in ("AND", "OR", "NOT"):
            items.append(bare)
        else:
            if column is not None and column not in columns:
                raise QueryError(f"no such column: {column}")
            found = tuple(analyse(quoted.replace('""', '"') if quoted is not None else bare))
            if found:
                items.append(Phrase(found, bool(quoted_star or star), column))
    if not items:
        return None
    pos = 0

    def peek() -> object | None:
        return items[pos] if pos < len(items) else None

    def take() -> object:
        nonlocal pos
        pos += 1
        return items[pos - 1]

    def primary() -> object:
        item = peek()
        if item == "(" or isinstance(item, Scope):
            take()
            tree = disjunction()
            if peek() != ")":
                raise QueryError("unbalanced parenthesis")
            take()
            return tree if item == "(" else _within(tree, item.column)
        if isinstance(item, Phrase):
            return take()
        raise QueryError(f"syntax error near {item!r}")

    def exclusion() -> object:
        tree = primary()
        while peek() == "NOT":
            take()
            tree = Not(tree, primary())
        return tree

    def conjunction() -> object:
        tree = exclusion()
        while peek() == "AND" or isinstance(peek(), (Phrase, Scope)) or peek() == "(":
            if peek() == "AND":
                take()
            tree = And(tree, exclusion())
        return tree

    def disjunction() -> object:
        tree = conjunction()
        while peek() == "OR":
            take()
            tree = Or(tree, conjunction())
        return tree

    tree = disjunction()
    if peek() is not None:
        raise QueryError(f"syntax error near {peek()!r}")
    return tree


def _within(tree: object, column: str) -> object:
    """The tree with all its phrases in one column."""
    if isinstance(tree, Phrase):
        if tree.column not in (None, column):
            raise QueryError(f"{tree.column} stands inside {column}")
        return Phrase(tree.tokens, tree.prefix, column)
    return type(tree)(_within(tree.left, column), _within(tree.right, column))


def phrases(tree: object) -> list[Phrase]:
    """The phrases of a tree from left to right."""
    if isinstance(tree, Phrase):
        return [tree]
    return phrases(tree.left) + phrases(tree.right)
