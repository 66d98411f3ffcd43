"""Texts for embedding, and dates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAIL_WORDS, MEMORY_WORDS = 150, 200
_SPACE = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space at both ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def truncate_words(text: Column, n: int) -> Column:
    """Up to the n-th white-space character (each counts, also of several in a row), stripped."""
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), rf"^(?:\S*\s){{0,{n - 1}}}\S*", 0))


def mail_text(subject: Column, sender: Column, to: Column, body: Column) -> Column:
    """Headers (the subject twice), a blank line and the first words of the body; a side that is empty leaves the other alone."""
    line = lambda label, c: F.when(strip(c) != "", F.concat(F.lit(label), strip(c)))
    head = F.concat_ws("\n", line("Subject: ", subject), line("Subject: ", subject), line("From: ", sender), line("To: ", to))
    text = truncate_words(strip(body), MAIL_WORDS)
    return F.when(head == "", text).when(text == "", head).otherwise(F.concat(head, F.lit("\n\n"), text))


def memory_text(role: Column, content: Column) -> Column:
    """`role: ` and the first words of the content; without prefix where the role is empty."""
    text, name = truncate_words(strip(content), MEMORY_WORDS), F.coalesce(role, F.lit(""))
    return F.when(name == "", text).otherwise(F.concat(name, F.lit(": "), text))


def date_string(ms: Column) -> Column:
    """Epoch milliseconds as local yyyy-MM-ddTHH:mm:ss with six more digits where there is a fraction; 0 and null give an empty text.

    The session time zone is the local one. Negative values show no fraction.
    """
    stamp = F.timestamp_millis(ms)
    plain = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(ms, F.lit(1000))
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "").when((ms > 0) & (fraction != 0), F.concat(plain, F.lit("."), F.lpad(fraction.cast("string"), 3, "0"), F.lit("000"))).otherwise(plain)
