"""Text analysis: case and accent folding, tokens, stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.porter import stem

#: Token characters: letters, digits, private use and the four signs of the token definition.
TOKEN = r"[\p{L}\p{N}\p{Co}_.@-]+"
_TOKEN_PY = re.compile(r"(?:[^\W_]|[-_.@]|[-])+")


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition."""
    pairs = []
    for code in range(0x00C0, 0x0250):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFD", letter)[0]
        if len(letter) == 1 and base != letter and base.isalpha():
            pairs.append((letter, base))
    seen = dict(pairs)
    return "".join(seen), "".join(seen.values())


ACCENTED, BASE = _folding()
_FOLD = str.maketrans(ACCENTED, BASE)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, BASE)


def tokens(text: Column) -> Column:
    """The tokens of a text as an array; null counts as empty."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokens_py(text: str) -> list[str]:
    """The same on the driver, for query terms."""
    return _TOKEN_PY.findall(text.lower().translate(_FOLD))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of token arrays; each worker stems a word once."""
    known: dict[str, str] = {}
    for column in batches:
        out = []
        for words in column:
            if len(known) > 500_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = stem(w)
            out.append([known[w] for w in words])
        yield pd.Series(out)
