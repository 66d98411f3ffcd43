"""Template residue, filler, error pages and script notices: character n-gram likelihood ratios over windows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import p10_seeds as seeds

KINDS = ("placeholder", "filler", "error_page", "script_notice")
#: A window is residue when the log likelihood ratio against prose reaches LEAST in all and PER_CHAR on average.
LEAST, PER_CHAR = 9.0, 0.35
#: A window teaches prose unless the seeds alone take it for residue, with LEAST in all and this much a character (more than PER_CHAR, as the seeds know little prose).
SEED_PER_CHAR = 0.7
_ORDERS, _BITS = 5, 18
#: Bits of a place in the tables of the corpus (three of them make a key of 63 bits).
_PLACE = 21
#: A window is scored by all models when the best residue model, by three characters alone, is at least this far ahead of prose a character (it is residue from PER_CHAR on).
COARSE = 0.0
#: Characters scored at a time; bounds the memory that a very long text takes.
STRETCH = 200_000
#: Characters whose n-grams are counted at a time.
COUNTED = 1_000_000
_WEIGHTS = np.array([0.03, 0.07, 0.15, 0.27, 0.48])
_FLOOR = 1e-4
_SENTENCE = regex.compile(r"[^.!?\n]*(?:[.!?](?![\s\"')\]])[^.!?\n]*)*[.!?]*[\"')\]]*\s*|\n")
#: White space beyond ASCII.
_WIDE_BLANKS = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint64)
_WORDS = regex.compile(r"\p{L}+")
_LATIN = bytes(i for i in range(256) if chr(i).isalpha())
_LETTER = regex.compile(r"\p{L}")
_DIGITS = re.compile("[0-9]")
_LIST_MARK = regex.compile(r"^\s*(?:[-*+>o#•]+|\d+[.)])\s+|^\s*(?:user|assistant|system|agent):\s+", regex.I)
_FIELD_SIGN = re.compile(r"[{\[<%@*«#$]|__")
#: The delimiters of merge fields in common template languages.
_FIELD = regex.compile(
    r"\{\{\{?\s*([\w.' -]+?)\s*(?:\|[^{}\n]*)?\}?\}\}|\{%\s*([\w.' -]+?)\s*(?:\|[^{}%\n]*)?%\}|<%=?\s*([\w.' -]+?)\s*(?:\|[^<>%\n]*)?%>|[$#]\{\s*([\w.' -]+?)\s*(?:\|[^{}\n]*)?\}|(?<![\{$#\w])\{\s*([\p{L}][\w.' -]{1,39}?)\s*\}"
    r"|%([A-Z][A-Z_]{1,38})%|@@([\w.-]{2,40})@@|__([A-Z][A-Z_]{1,38}?)__|\*\|([\w:. -]{2,40})\|\*|«\s*([\p{L}][\w.' -]{1,39}?)\s*»|\[\[\s*([\p{L}][\w.' -]{1,39}?)\s*\]\]"
    r"|\[(?:INSERT|ENTER|YOUR|EINFÜGEN|INSÉRER|INSERTAR)\s+([\p{L}\w.' -]{2,40}?)(?:\s+HERE)?\s*\]|(?<!\[)\[\s*([\p{L}][\w.' -]{1,39}?)\s*\](?![\](])|<<\s*([\p{L}][\w.' -]{1,39}?)\s*>>|<([\p{L}]+(?:[ _.-][\p{L}]+){0,3})>"
)


class Counts:
    """Counts of the different character n-grams of texts, each with its context; those of parts of the texts add up to those of all.

    A key holds the hashed places of an n-gram and of its context, _PLACE bits each.
    """

    def __init__(self, texts: Iterable[str] = ()):
        self.keys = [np.zeros(0, dtype=np.int64) for _ in range(_ORDERS)]
        self.times = [np.zeros(0, dtype=np.int64) for _ in range(_ORDERS)]
        self.seen = np.zeros(0, dtype=np.int64)  # the places of orders 1 to 3 that end together
        parts: list[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]] = []
        size = 0
        for text, known in _stretches(texts):
            parts.append(self._count(text, known))
            size += sum(map(len, parts[-1][0]))
            if size > 4 * COUNTED:
                self._merge(parts)
                parts, size = [], 0
        self._merge(parts)

    @staticmethod
    def _count(text: str, known: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Counts what ends in `text`, zeros and the first `known` signs left out: the different n-grams of the highest order are those of all orders, too."""
        x = _codes(text)
        signs = np.flatnonzero(np.bincount(x.view(np.int64)))
        number = np.zeros(int(signs[-1]) + 1, dtype=np.int64)
        number[signs] = np.arange(len(signs))
        bits = max(int(len(signs) - 1).bit_length(), 1)
        if bits * _ORDERS > 63:  # more than 4,096 different signs
            half = len(x) // 2
            first, second = Counts._count(text[:half], known), Counts._count(text[half - _ORDERS :], _ORDERS)
            return [np.concatenate(k) for k in zip(first[0], second[0])], [np.concatenate(k) for k in zip(first[1], second[1])], np.concatenate([first[2], second[2]])
        number = number[x.view(np.int64)]
        begin = max(known, _ORDERS)
        gram = number[begin:].copy()
        for n in range(1, _ORDERS):
            gram |= number[begin - n : len(x) - n] << n * bits
        gram, times = _different(gram[x[begin:] != 0])
        back = [signs[(gram >> n * bits) & ((1 << bits) - 1)].astype(np.uint64) for n in range(_ORDERS)]
        places = [(h & np.uint64((1 << _PLACE) - 1)).astype(np.int64) for h in _chain(back)]
        contexts = [np.zeros(len(gram), dtype=np.int64), *((h & np.uint64((1 << _PLACE) - 1)).astype(np.int64) for h in _chain(back[1:]))]
        seen, _ = _different((((places[0] << _PLACE) + places[1]) << _PLACE) + places[2])
        return [(p << _PLACE) + c for p, c in zip(places, contexts)], [times] * _ORDERS, seen

    def _merge(self, parts: list) -> None:
        for n in range(_ORDERS):
            keys = np.concatenate([self.keys[n], *(p[0][n] for p in parts)])
            times = np.concatenate([self.times[n], *(p[1][n] for p in parts)])
            self.keys[n], where = np.unique(keys, return_inverse=True)
            self.times[n] = np.bincount(where, times, minlength=len(self.keys[n])).astype(np.int64)
        self.seen = np.unique(np.concatenate([self.seen, *(p[2] for p in parts)]))

    def __add__(self, other: Counts) -> Counts:
        out = Counts()
        out._merge([(c.keys, c.times, c.seen) for c in (self, other)])
        return out

    def rows(self) -> pd.DataFrame:
        """(n, key, times): rows of equal n and key add up. Order 0 stands for the places that end together."""
        n = np.repeat(np.arange(_ORDERS + 1), [len(self.seen), *map(len, self.keys)])
        return pd.DataFrame({"n": n.astype(np.int32), "key": np.concatenate([self.seen, *self.keys]), "times": np.concatenate([self.seen * 0 + 1, *self.times])})

    @classmethod
    def of_rows(cls, rows: pd.DataFrame) -> Counts:
        out = cls()
        n, key, times = (rows[c].to_numpy() for c in ("n", "key", "times"))
        order = np.argsort(key)
        n, key, times = n[order], key[order], times[order]
        out.seen, out.keys, out.times = key[n == 0], [key[n == i + 1] for i in range(_ORDERS)], [times[n == i + 1] for i in range(_ORDERS)]
        return out


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(first, append=len(keys))


def _stretches(texts: Iterable[str]) -> Iterator[tuple[str, int]]:
    """The texts, zeros between them keeping them apart, in stretches of bounded size, and the number of signs that each repeats of the stretch before."""
    group: list[str] = []
    size = 0
    for t in texts:
        t = "\0" * _ORDERS + " " + _lower(t)
        if group and size + len(t) > COUNTED:
            yield "".join(group), 0
            group, size = [], 0
        if len(t) <= COUNTED:
            group.append(t)
            size += len(t)
        else:
            for at in range(0, len(t), COUNTED):
                yield t[max(at - _ORDERS, 0) : at + COUNTED], min(at, _ORDERS)
    if group:
        yield "".join(group), 0


class CharModel:
    """An interpolated character n-gram model in hashed tables of weighted conditional probabilities, one look-up an order.

    Of n-grams that share a place the most frequent gives the probability.
    """

    def __init__(self, texts: Iterable[str] | Counts, bits: int = _BITS):
        counts = texts if isinstance(texts, Counts) else Counts(texts)
        self.seen, self.p, self.bits = counts.seen, [], bits
        for n, (keys, times) in enumerate(zip(counts.keys, counts.times)):
            place, context = (keys >> _PLACE) & ((1 << bits) - 1), keys & ((1 << bits) - 1)
            before = np.bincount(context, times, minlength=1 << bits)
            last = np.argsort(times, kind="stable")
            p = np.zeros(1 << bits, dtype=np.float32)
            p[place[last]] = (_WEIGHTS[n] * times / (before[context] + 0.4))[last]
            self.p.append(p)

    def __getstate__(self) -> tuple:
        return self.seen, self.bits, [(i.astype(np.int32), p[i]) for p in self.p for i in [np.flatnonzero(p)]]

    def __setstate__(self, state: tuple) -> None:
        self.seen, self.bits, state = state
        self.p = [np.zeros(1 << self.bits, dtype=np.float32) for _ in state]
        for p, (i, values) in zip(self.p, state):
            p[i] = values

    def logp(self, text: str) -> np.ndarray:
        """The log probability of each sign of the text, a blank before it."""
        x = np.concatenate([np.zeros(_ORDERS, dtype=np.uint64), codes(text)])
        total = np.full(len(x) - _ORDERS, _FLOOR)
        for n, h in enumerate(_hashes(x, _ORDERS)):
            total += self.p[n][h & np.uint64((1 << self.bits) - 1)]
        return np.log(total)


def codes(text: str) -> np.ndarray:
    """Code points in lower case, digits as one symbol, white space and control signs as blanks, with a leading blank."""
    return _codes(" " + _lower(text))


def _lower(text: str) -> str:
    """Lower case of the same length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    x[(x >= 48) & (x <= 57)] = 48
    x[(x <= 32) & (x >= 9)] = 32
    if x.max() > 127:
        x[np.isin(x, _WIDE_BLANKS)] = 32
    return x


def _hashes(x: np.ndarray, orders: int) -> Iterator[np.ndarray]:
    """The hashes of the n-grams that end at each place of `x` from _ORDERS on, n = 1 .. orders, in one array that changes."""
    return _chain(x[_ORDERS - n : max(len(x) - n, _ORDERS - n)] for n in range(orders))


def _hashes_at(x: np.ndarray, at: np.ndarray, orders: int) -> Iterator[np.ndarray]:
    """Those of the places `at` only."""
    return _chain(x[at - n] for n in range(orders))


def _chain(back: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The hashes of n-grams given by their last signs, the signs before these and so on, order by order in one array that changes."""
    h = np.uint64(0)
    for n, signs in enumerate(back):
        h = np.bitwise_xor(h, signs + np.uint64(n + 1), out=h if n else None)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        yield h


def fold(text: str) -> str:
    """The text as the models see it, but for white space; places stay."""
    return _DIGITS.sub("0", _lower(text))


def windows(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines and sentences of the text, list marks and blanks left out."""
    out = []
    for m in _SENTENCE.finditer(text):
        start, end = m.span()
        if start == end:
            continue
        mark = _LIST_MARK.match(text, start, end)
        if mark:
            start = mark.end()
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def teaching(text: str) -> set[str]:
    """The different windows of a text that may teach the prose model, folded."""
    low = fold(text)
    return {w for a, b in windows(text) for w in [low[a:b]] if _like_prose(w)}


def _groups(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in lists of STRETCH characters, a longer text alone."""
    group: list[str] = []
    size = 0
    for t in texts:
        if group and size + len(t) > STRETCH:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _like_prose(window: str) -> bool:
    """Whether a window may teach the prose model: short, or with function words of some language."""
    low = window.lower()
    most = 1 + len(low.encode("latin-1", "replace").translate(None, _LATIN))  # words; any two have another sign between them
    if sum(map(seeds.FUNCTION_WORDS.__contains__, low.split())) >= 0.1 * most:
        return True
    words = _WORDS.findall(low)
    return len(words) < 5 or sum(w in seeds.FUNCTION_WORDS for w in words) >= 0.1 * len(words)


class Detector:
    """Models of the residue kinds, of prose and of talk about residue; finds the residue windows of a text."""

    def __init__(self, prose: Iterable[str] = ()):
        self.models = {
            "filler": CharModel(seeds.FILLER * 8 + seeds.drawn(seeds.FILLER_GRAMMARS) + seeds.repeats()),
            "filler, pseudo-Latin": CharModel(seeds.pseudo_latin()),
            "filler, keys": CharModel(seeds.key_runs()),
            "error_page": CharModel(seeds.ERROR * 8 + seeds.drawn(seeds.ERROR_GRAMMARS)),
            "script_notice": CharModel(seeds.SCRIPT * 8 + seeds.drawn(seeds.SCRIPT_GRAMMARS)),
        }
        self.field, self.note = CharModel(seeds.FIELDS), CharModel(seeds.NOTES)
        self.explaining, self.talk = CharModel(seeds.TALK), CharModel(seeds.TALK + seeds.NEUTRAL * 10)
        self.teach(Counts())
        if prose:
            self.teach(self.lessons({w for t in prose for w in teaching(t)}))

    def teach(self, corpus: Counts) -> None:
        """Sets the prose models to those of the seeds and the corpus."""
        self.prose = CharModel(Counts(seeds.TALK + seeds.NEUTRAL) + corpus, _PLACE)
        self.corpus_only = CharModel(Counts(seeds.NEUTRAL) + corpus, _PLACE)
        self._joined = (None,)

    def lessons(self, different: Iterable[str]) -> Counts:
        """The counts of those of the different windows that an untaught detector doesn't take for residue.

        Each counts once, so that what is repeated (residue often is) weighs little.
        As the seeds alone decide, a window's part in the model depends on no other text.
        """

        def kept() -> Iterator[str]:
            for group in _groups(different):
                x = _codes("".join("\0" * _ORDERS + " " + w for w in group))
                sizes = np.array([len(w) for w in group])
                ends = np.cumsum(sizes + _ORDERS + 1)
                ratio, _ = self._ratio(self._score(x, ends - sizes, ends))
                residue_ = (ratio >= LEAST) & (ratio >= SEED_PER_CHAR * sizes)
                yield from (w for w, out in zip(group, residue_) if not out)

        return Counts(kept())

    def _ratio(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log likelihood ratio of each window's best residue model against the better of prose and talk, and that model."""
        ratio = score[:, : len(self.models)] - score[:, len(self.models) :].max(axis=1, keepdims=True)
        return ratio.max(axis=1), ratio.argmax(axis=1)

    def has_field(self, window: str) -> bool:
        """Whether the window has an unfilled merge field and doesn't explain it."""
        found = False
        for m in _FIELD.finditer(window):
            name = next(g for g in m.groups() if g)
            name = name.replace("_", " ").replace(".", " ")
            if self.field.logp(name).sum() > self.note.logp(name).sum():
                found = True
                break
        if not found:
            return False
        rest = _FIELD.sub("", window).strip()
        if len(rest) < 12:
            return True
        return float(self.explaining.logp(rest).mean()) < float(self.corpus_only.logp(rest).mean()) + TALK_MARGIN

    def together(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The tables of all window models side by side, so that one look-up an order serves them all, and the coarse table."""
        every = [*self.models.values(), self.talk]
        now = (*map(id, every), id(self.prose))
        if getattr(self, "_joined", (None,))[0] != now:
            tables = [np.stack([m.p[n] for m in every], axis=1) for n in range(_ORDERS)]
            seen = np.unique(np.concatenate([m.seen for m in (*every, self.prose)]))
            places = [seen >> 2 * _PLACE, (seen >> _PLACE) & ((1 << _PLACE) - 1), seen & ((1 << _PLACE) - 1)]
            logs, prose = (np.log(sum(t[k & (len(t) - 1)] for t, k in zip(p, places)) + np.float32(_FLOOR)) for p in (tables, self.prose.p))
            coarse = np.full(1 << _BITS, -np.inf, dtype=np.float32)
            np.maximum.at(coarse, places[2] & ((1 << _BITS) - 1), logs[:, :-1].max(axis=1) - np.maximum(logs[:, -1], prose))
            coarse[np.isneginf(coarse)] = 0
            self._joined = now, tables, coarse
        return self._joined[1:]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_joined"}

    def _score(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(windows, models): the log probability of each window [start, end) of the codes `x`; hopeless ones, by the coarse table, have -inf for residue."""
        tables, coarse = self.together()
        out = np.full((len(starts), len(self.models) + 2), -np.inf)
        out[:, len(self.models) :] = 0.0
        *_, h = _hashes(x, 3)
        sums = np.concatenate([[0.0], np.cumsum(coarse[h & np.uint64((1 << _BITS) - 1)], dtype=np.float64)])
        hope = np.flatnonzero(sums[ends - _ORDERS] - sums[starts - _ORDERS] >= COARSE * (ends - starts))
        if len(hope):
            sizes = ends[hope] - starts[hope]
            first = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(starts[hope] - first, sizes)
            total, prose = np.full((len(at), len(self.models) + 1), _FLOOR, dtype=np.float32), np.full(len(at), _FLOOR, dtype=np.float32)
            all_places = len(at) > len(x) // 2
            for n, h in enumerate(_hashes(x, _ORDERS) if all_places else _hashes_at(x, at, _ORDERS)):
                keys = ((h[at - _ORDERS] if all_places else h) & np.uint64((1 << _PLACE) - 1)).view(np.int64)
                prose += self.prose.p[n].take(keys)
                total += tables[n].take(keys & ((1 << _BITS) - 1), axis=0)
            out[hope, :-1] = np.add.reduceat(np.log(total, out=total), first, axis=0, dtype=np.float64)
            out[hope, -1] = np.add.reduceat(np.log(prose, out=prose), first, dtype=np.float64)
        return out

    def scores(self, text: str, parts: list[tuple[int, int]]) -> np.ndarray:
        """The scores of the windows of a text, a stretch of it at a time."""
        out, begin = [], 0
        while begin < len(parts):
            low, end = parts[begin][0], begin + 1
            while end < len(parts) and parts[end][1] - low <= STRETCH:
                end += 1
            before = min(low, 2 * _ORDERS)
            x = np.concatenate([np.zeros(_ORDERS, dtype=np.uint64), codes(text[low - before : parts[end - 1][1]])])
            starts, ends = (np.array(parts[begin:end]) - low + before + _ORDERS + 1).T  # the blank before the text is a place too
            out.append(self._score(x, starts, ends))
            begin = end
        return np.concatenate(out)

    def many(self, texts: list[str | None], least: float = LEAST, per_char: float = PER_CHAR) -> list[list[tuple[str, int, int]]]:
        """What the detector says of each text; short ones are scored together."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        group: list[tuple[int, str, list[tuple[int, int]]]] = []
        size = 0

        def close() -> None:
            if not group:
                return
            x = _codes("".join("\0" * _ORDERS + " " + _lower(t) for _, t, _ in group))
            offsets = np.cumsum([0, *(len(t) + _ORDERS + 1 for _, t, _ in group)])[:-1] + _ORDERS + 1
            counts = [len(p) for _, _, p in group]
            starts, ends = (np.array([w for _, _, p in group for w in p]) + np.repeat(offsets, counts)[:, None]).T
            each = np.split(self._score(x, starts, ends), np.cumsum(counts)[:-1])
            for (i, t, parts), score in zip(group, each):
                out[i] = self._kinds(t, self.residue_windows(t, least, per_char, parts, score))
            group.clear()

        for i, t in enumerate(texts):
            if not t or t.isspace():
                continue
            if len(t) > STRETCH:
                out[i] = self._kinds(t, self.residue_windows(t, least, per_char))
                continue
            parts = windows(t)
            if not parts:
                continue
            if size + len(t) > STRETCH:
                close()
                size = 0
            group.append((i, t, parts))
            size += len(t)
        close()
        return out

    def residue_windows(self, text: str, least: float = LEAST, per_char: float = PER_CHAR, parts: list[tuple[int, int]] | None = None, score: np.ndarray | None = None) -> list[tuple[str, tuple[int, int]]]:
        """(kind, window) of each residue window.

        A window's log likelihood ratio is that of its best kind against the
        better of prose and talk. Neighbouring windows of one kind, each with
        `per_char` on average, count together; together they need `least`, and
        filler of one or two words must be a line of its own (but no salutation, which
        ends with a comma) or cover nearly the whole text.
        """
        parts = windows(text) if parts is None else parts
        if not parts:
            return []
        score = self.scores(text, parts) if score is None else score
        names = list(self.models)
        kinds = [k.partition(",")[0] for k in names]
        top, best = self._ratio(score)
        out: list[tuple[str, tuple[int, int]]] = []
        run: list[tuple[int, int]] = []
        run_kind, total = -1, 0.0

        def whole_line(a: int, b: int) -> bool:
            before, after = text[text.rfind("\n", 0, a) + 1 : a], text[b : len(text) if (end := text.find("\n", b)) < 0 else end]
            return text[b - 1] != "," and not after.strip() and (not before.strip() or _LIST_MARK.fullmatch(before) is not None)

        def close() -> None:
            words = sum(text[a:b].count(" ") + 1 for a, b in run)
            if run and total >= least and (kinds[run_kind] != "filler" or words > 2 or all(whole_line(*w) for w in run) or sum(b - a for a, b in run) > 0.9 * len(text.strip())):
                out.extend((kinds[run_kind], w) for w in run)

        fields = _FIELD_SIGN.search(text) is not None
        for i, (a, b) in enumerate(parts):
            window = text[a:b] if fields or top[i] >= 0 else ""
            kind = int(best[i]) if top[i] >= per_char * (b - a) and _LETTER.search(window) else -1
            if fields and _FIELD_SIGN.search(window) and _FIELD.search(window) and self.has_field(window):
                out.append(("placeholder", (a, b)))
                kind = -1
            if kind != run_kind:
                close()
                run, run_kind, total = [], kind, 0.0
            if kind >= 0:
                run.append((a, b))
                total += top[i]
        close()
        return out

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, residue characters, characters in all) for each kind found."""
        if not text or text.isspace():
            return []
        return self._kinds(text, self.residue_windows(text))

    @staticmethod
    def _kinds(text: str, windows_: list[tuple[str, tuple[int, int]]]) -> list[tuple[str, int, int]]:
        found: dict[str, int] = {}
        for kind, (a, b) in windows_:
            found[kind] = found.get(kind, 0) + b - a
        return [(k, n, len(text)) for k, n in sorted(found.items())]


#: A sentence explains its merge field when talk beats the sampled prose by this log likelihood a character.
TALK_MARGIN = 0.35


def fit(corpus: DataFrame, doc_id: str, text: str) -> Detector:
    """A detector whose prose model is fitted on all documents.

    Each different window of the corpus counts once, whatever its place; those
    that the seeds alone take for residue teach nothing. Counts are whole
    numbers that add up over tasks, so the model is the same however the rows
    are split. The driver gets one row for each different n-gram.
    """
    detector = Detector()
    shared = corpus.sparkSession.sparkContext.broadcast(detector)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"window": list(set().union(*map(teaching, batch["text"])))}, dtype=object)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield shared.value.lessons(w for batch in batches for w in batch["window"]).rows()

    documents = corpus.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counted = documents.mapInPandas(cut, "window string").distinct().mapInPandas(count, "n int, key long, times long")
    detector.teach(Counts.of_rows(counted.groupBy("n", "key").agg(F.sum("times").alias("times")).toArrow().to_pandas()))
    shared.unpersist()
    return detector


def residue(corpus: DataFrame, doc_id: str, text: str = "text", detector: Detector | None = None, least_coverage: float = 0.0) -> DataFrame:
    """(doc_id, kind, coverage): the documents with residue, each kind once, and the share of the text it covers.

    Every document is cut into windows (lines, sentences). A window with a
    merge field whose name looks like a field and whose sentence doesn't
    explain it is `placeholder`; else the window takes the kind whose character
    model beats both prose and talk about residue by enough. A document counts
    as a case of a kind when its windows cover more than `least_coverage` of
    the text (by default any: a text may consist of residue or only contain it). Null, empty and
    blank texts have none; a repeated document gives each kind once; further
    columns are ignored. All documents are scored, in one pass without a
    shuffle of texts.
    """
    found = detector or fit(corpus, doc_id, text)
    shared = corpus.sparkSession.sparkContext.broadcast(found)  # tables of fixed size

    @F.pandas_udf("array<struct<kind string, chars int, size int>>")
    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = shared.value
        for texts in batches:
            yield pd.Series([[{"kind": k, "chars": c, "size": s} for k, c, s in found] for found in run.many(list(texts))])

    rows = corpus.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("_d"), F.explode(detect(F.col(text))).alias("_r"))
    return rows.groupBy("_d", "_r.kind").agg(F.max(F.col("_r.chars") / F.col("_r.size")).alias("coverage")).where(F.col("coverage") > least_coverage).withColumnRenamed("_d", doc_id)


def without_residue(corpus: DataFrame, found: DataFrame, doc_id: str, most: float = 0.0) -> DataFrame:
    """The corpus without the documents whose residue of some kind covers more than `most` of the text."""
    return corpus.join(found.where(F.col("coverage") > most).select(doc_id).distinct(), doc_id, "left_anti")
