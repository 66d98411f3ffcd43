"""Personal information in free text: a skip-chain CRF over open tokens, typed placeholders.

A document's variables are its open tokens: mail addresses, digit groups and
codes that could be phone or identity numbers, street addresses, and words that
could belong to a person's name, each of which begins a name, continues one or
is no name. All other words are fixed as `other` and act through the features
of their neighbours. Variables are linked to the next one nearby (chain; what
stands between them tells whether a name goes on) and to the next token of the
same form in the document (skip). All weights are learnt together by
likelihood, and sum-product messages run over both kinds of links at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._sample import least_hashes

LABELS = ("other", "email", "phone", "id_number", "street_address", "name", "name goes on")
EMAIL, PHONE, ID, ADDRESS, NAME, INSIDE = 1, 2, 3, 4, 5, 6
#: A name lexicon has this many slots in each of two tables (given, family), whatever the corpus.
SLOT_BITS = 21
#: The CRF is fitted on at most this many texts (those of least id hash), labelled by the rules of `silver`.
FIT_TEXTS = 4000
ROUNDS = 6
STEPS = 40
#: The kind of each label. Signs and equal tokens tell the kind; whether a name begins or goes on is told by what stands before.
KIND = np.array([0, 1, 2, 3, 4, 5, 5])
#: What stands between neighbouring tokens, and what a lexicon says of a word.
GAPS = ("join", "comma", "wrap", "line", "far")
JOINING = 3  # the first so many let a name go on
ROLES = ("given", "family", "both", "unknown")
#: Features that settle a token other than a name by themselves. They are hidden at random in half of the fitting sample, where context and links must do.
SURE = ("label:", "start:+", "cap", "town", "plain", "hidden", "end:")

_AT = r"(?:\s?@\s?|＠|&#64;|\s?\((?i:at)\)\s?|\s?\[(?i:at)\]\s?|\s?\{(?i:at)\}\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s(?:dot|DOT)\s)"
_MAIL = re.compile(rf"[\w+%-]+(?:{_DOT}[\w+%-]+)*{_AT}(?:[\w-]+{_DOT})+[^\W\d_]{{2,}}(?![\w@])")
_MAIL_SIGN = re.compile(r"@|＠|&#64;|[(\[{](?i:at)[)\]}]| (?:at|AT) \S+?(?:\.| dot | DOT |\s?[\[(]dot)")
_MAIL_REST = re.compile(rf"\s?(?:[\w-]|{_DOT})*")
#: Shapes of written phone numbers (international, 00, bracketed area, national trunk 0, three-three-four).
def _phone_pattern(gap: str) -> re.Pattern:
    return re.compile(
        r"(?<![\w/.+#-])(?:"
        rf"\+\d{{1,3}}(?:{gap}?\(\d{{1,4}}\))?(?:{gap}?\d{{1,12}}){{1,7}}"
        rf"|00[1-9]\d{{0,2}}{gap}(?:\(0\))?\d{{1,5}}(?:{gap}\d{{2,9}}){{1,5}}"
        rf"|\(\d{{2,5}}\){gap}?\d{{2,8}}(?:{gap}\d{{2,6}}){{0,4}}"
        rf"|0\d{{1,4}}{gap}\d{{2,9}}(?:{gap}\d{{2,6}}){{0,5}}"
        rf"|\d{{3}}{gap}\d{{3}}{gap}\d{{4}}"
        rf"|[67]\d{{2}}{gap}\d{{2,3}}{gap}\d{{2,3}}(?:{gap}\d{{2,3}})?"
        r")(?!\d|[-/.]\d)"
    )


_PHONE = _phone_pattern("[ ./-]")
_WRAPPED_PHONE = _phone_pattern(r"(?:[ ./-]|\n(?:> ?)*)")
_WRAP = re.compile(r"[\d)]\n(?:> ?)*[\d(]")
_DATE = re.compile(r"(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2})(?!\d)")
_EXTENSION = re.compile(r",?\s?(?:ext\.?|x|extension|durchwahl|poste|extensión)\s?\d{1,5}", re.I)
_ID_LABEL = re.compile(
    r"(?<!\w)(?:passport|reisepass|passeport|pasaporte|ssn|social (?:security|insurance)|sozialversicherung\w*|sécurité sociale|seguridad social|tax (?:id|number|no)|tin|steuer-?(?:id\w*|nummer|nr)|(?:identifiant|numéro|número|identificación) fiscal|nif|national insurance"
    r"|ni (?:number|no)|nino|driver'?s licen[cs]e|driving licen[cs]e|führerschein\w*|permis de conduire|(?:permiso|carn[eé]t?|licencia) de conducir|(?:national )?(?:identity|id) card|personalausweis\w*|carte (?:nationale )?d['’]identité|dni|nie|(?:documento|carné) de identidad)"
    r"(?!\w)[\s.:>-]{0,4}(?:(?:(?:numbers?|no|nr|nº|n°|n\.\s?º|núm|num|number is|nummer|numéro|número|is|lautet|ist|est|es|de la|de)(?!\w)|[#:])[\s.:>]{0,4}){0,3}",
    re.I,
)
_ID_SIGNS = (
    "passport", "reisepass", "passeport", "pasaporte", "ssn", "social", "sozialvers", "sécurité soc", "seguridad soc", "tax id", "tax n", " tin ", " tin:", "steuer", "fiscal", "nif", "insurance", "ni n", "nino", "licence", "license",
    "führerschein", "permis de", "conducir", "id card", "identity card", "personalausweis", "carte d", "carte nat", "dni", "nie ", "nie:", "identidad",
)
_DOTTED = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_CODE = re.compile(r"(?:[A-Za-z]{1,3}[ -]?)?\d[A-Za-z\d]*(?:[ ./-]?[A-Za-z\d]*\d[A-Za-z\d]*)*[A-Za-z]?(?![\w])")
#: Street types.
_EN = r"(?:Street|St\.|St|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Terrace|Row|Crescent|Cres\.?|Close|Boulevard|Blvd\.?|Drive|Dr\.|Court|Ct\.|Square|Sq\.|Place|Pl\.|Way|Walk|Gardens|Grove|Hill|Mews|Parade|Quay)"
_EN_LOWER = r"(?:street|st\.|road|rd\.?|avenue|ave\.?|lane|terrace|row|crescent|close|boulevard|blvd\.?|drive|court|square|place|way)"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|flat|apt\.?|unit|suite)\s\d+[A-Za-z]?,?\s)"
_NUMBER = r"\d{1,4}\s?(?:[A-Za-z]|bis|ter)?"
_CAP = r"[^\W\d_a-zà-ÿ][\w'’-]+"
#: A small number on its own, from which streets are sought on both sides.
_SMALL = re.compile(r"(?<![\w#€$£:/.,-])\d{1,4}(?=[ ,\r\nA-Za-z;.)]|$)(?![.,]\d)")
_NUMBER_FIRST = re.compile(
    rf"\d{{1,4}}[A-Za-z]?\s(?:{_CAP}\s){{1,3}}{_EN}(?!\w)|\d{{1,4}}[a-z]?\s[a-zà-ÿ][\w'’-]+\s{_EN_LOWER}(?=,\s[^\W\d_a-zà-ÿ]|\s*[\r\n]|\s*$)"
    rf"|{_NUMBER},?\s(?:[Rr]ue|[Aa]venue|av\.|[Bb]oulevard|bd\.?|[Pp]lace|[Cc]hemin|[Ii]mpasse|[Qq]uai|[Aa]llée|allee|[Cc]ours|[Rr]oute|square)\s(?:(?:de la|de l['’]|de|du|des|d['’])\s?)?[^\W\d_][\w'’-]+"
)
_UNIT_BEFORE = re.compile(rf"(?<!\w){_UNIT}$")
_STREET_WORDS = ("str.", "straße", "strasse", "weg", "platz", "gasse", "allee", "ring", "ufer", "damm", "chaussee")
_EN_WORDS = frozenset("Street St. St Road Rd Rd. Avenue Ave Ave. Lane Ln Ln. Terrace Row Crescent Cres Close Boulevard Blvd Blvd. Drive Dr. Court Ct. Square Sq. Place Pl. Way Walk Gardens Grove Hill Mews Parade Quay".split())
_ES_SIGNS = ("Calle ", "calle ", "C/", "c/", "Aven", "aven", "Avda", "avda", "Av. ", "Plaza ", "plaza ", "Pza", "Paseo ", "paseo ", "Camino ", "camino ", "Ronda ", "ronda ", "Carrera ", "Travesía ")
_NUMBER_LAST = re.compile(
    rf"(?:{_CAP}\s){{1,2}}{_EN}\s\d{{1,4}}[A-Za-z]?$"
    r"|(?:[^\W\d_a-zà-ÿ][\w'’-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|chaussee)|(?:[^\W\d_a-zà-ÿ][\w'’-]+[- ])+(?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ring|Ufer|Damm|Chaussee))\s\d{1,4}\s?[a-z]?$"
    r"|[^\W\d_][\w'’-]{2,}(?:straße|strasse|str\.|weg|gasse|allee)\s\d{1,4}[a-z]?$"
    rf"|(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Pza\.|Paseo|Camino|Ronda|Carrera|Travesía|calle|c/|avenida|avda\.|plaza|paseo|camino|ronda)\s?(?:(?:de la|de los|de las|del|de)\s)?[^\W\d_][\w'’-]+(?:\s{_CAP})?,?\s(?:n\.?º\s?)?\d{{1,4}}[A-Za-z]?$"
)


def _broken(text: str, start: int, end: int) -> int:
    """The place after the last line break in text[start:end] that no wrapping explains, or `start`."""
    at = text.find("\n", start, end)
    while at >= 0:
        if at - text.rfind("\n", 0, at) - 1 < 45:
            start = at + 1
        at = text.find("\n", at + 1, end)
    return start


def streets(text: str) -> Iterator[tuple[int, int]]:
    """The spans of street and house number, found from the number."""
    for start, end in _streets(text):
        if "\n" in text[start:end]:
            cut = _broken(text, start, end)
            if cut > start:
                m = _NUMBER_LAST.search(text[cut:end])
                if not m:
                    continue
                start = cut + m.start()
        yield start, end


_AFTER_EXTENSION = re.compile(r"(?:ext\.?|durchwahl|poste|extension|extensión)\s$", re.I)


def _streets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SMALL.finditer(text):
        start, end = m.span()
        continued = start > 1 and text[start - 1] in " )" and text[start - 2] in "0123456789)"  # of a longer number
        continued = continued or (start > 4 and text[start - 1] == " " and _AFTER_EXTENSION.search(text[max(0, start - 14) : start]) is not None)
        first = None if continued else _NUMBER_FIRST.match(text, start)
        if first:
            unit = _UNIT_BEFORE.search(text[max(0, start - 14) : start])
            yield start - (len(unit.group(0)) if unit else 0), first.end()
            continue
        if end < len(text) and text[end].isalpha() and not (end + 1 < len(text) and text[end + 1].isalnum()):
            end += 1
        low = max(0, start - 60)
        before = text[low:start]
        if not before or not before[-1].isspace():
            continue
        word = before.split()[-1:] or [""]
        if word[0].lower().endswith(_STREET_WORDS) or word[0] in _EN_WORDS or any(x in before for x in _ES_SIGNS):
            last = _NUMBER_LAST.search(text[low:end])
            if last:
                yield low + last.start(), end


_TOWN = re.compile(r",\s(?:\d{4,5}\s)?[^\W\d_a-zà-ÿ][\w'’-]+(?:\s[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2})?(?=[\s,.;]|$)")
_FLOOR = re.compile(r",\s\d{1,2}\.?º(?:\s[A-Z])?(?!\w)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_HEADER_ADDRESS = re.compile(r"<([^<>\s@]+)@")
_HEADER_CUT = re.compile(r"[\",;<>@]")
_CAPITALISED = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:['’-][^\W\d_]+)*")
_GREETINGS = tuple(
    (x + " ", _CAPITALISED.match(x).group(0)) for x in "Dear|Hi|Hello|Hallo|Hey|Hola|Bonjour|Salut|Moin|Guten Tag|Liebe|Lieber|Estimado|Estimada|Cher|Chère|Mr|Mrs|Ms|Mx|Mr.|Mrs.|Ms.|Dr.|Dr|Prof.|Herr|Herrn|Frau|Mme|Sr.|Sra.|Sr|Sra|Señor|Señora".split("|")
)
_TITLE = re.compile(r"(?:^|[^\w])(?:mr|mrs|ms|miss|mx|dr|prof|professor|herrn?|frau|mme|mlle|monsieur|madame|m|sr|sra|srta|don|doña|señora?)\.?\s$", re.I)
_GREETING = re.compile(r"(?:^|[\n>] ?|\W)(?:dear|hi|hello|hallo|hey|hola|bonjour|salut|moin|guten tag|guten morgen|liebe[rs]?|sehr geehrte[rs]?|estimad[oa]|cher|chère|querid[oa])\s$", re.I)
_NOT_PERSON = re.compile(r"(?:project|projekt|projet|proyecto|release|branch|filiale|succursale|sucursal|firma|company|portal|version|model|produkt|product)\s$", re.I)
#: What is no person though it has a name.
_THINGS = tuple(x + " " for x in "project projekt projet proyecto release branch filiale succursale sucursal firma company portal version model produkt product".split())
_PHONE_LABEL = re.compile(r"(?:[☎📞📱]|(?<!\w)(?:t|p|m|tel|tél|telefon|téléphone|teléfono|phone|mobile|mobil|móvil|portable|handy|fax|call|reach|dial|cell|direct|llamar|unter|appeler|anrufen)(?!\w))[\s.:]{0,3}$", re.I)
_OTHER_LABEL = re.compile(r"(?<!\w)(?:order|invoice|ticket|parcel|part|reference|ref|serial|counter|meter|batch|account|konto|rechnung|bestellung|auftrag|vorgang|beleg|teil|paket|zähler|commande|facture|colis|pièce|dossier|pedido|factura|paquete|pieza|recibo|tag|row|line|zeile|ligne|línea|version|id|no|nr)(?!\w)[\s.:#]{0,3}$", re.I)
_NO_NAMES = frozenset("team all everyone everybody damen herren kollegen kolleginnen zusammen madame monsieur messieurs todos todas equipo colleague colleagues customer customers sir sirs madam client cliente kunde kunden support service there folks".split())


@dataclass
class Candidate:
    start: int
    end: int
    label: int  # the label its form is open to
    form: str  # candidates of equal form are linked
    features: list[str] = field(default_factory=list)
    role: int = 3  # of ROLES
    gap: int = -1  # of GAPS, between the candidate before and this one; -1 if that is far off


def slots(word: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word.lower())
    return h & ((1 << SLOT_BITS) - 1), h >> 40 & ((1 << SLOT_BITS) - 1)


class Lexicon:
    """How often a word is seen as a given and as a family name in mail headers; counting Bloom tables of fixed size."""

    def __init__(self, given: np.ndarray, family: np.ndarray):
        self.tables, self.known = (given, family), {}

    def __call__(self, word: str) -> tuple[int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            a, b = slots(word)
            found = self.known[word] = tuple(int(min(t[0, a], t[1, b])) for t in self.tables)
        return found

    def __getstate__(self):
        return [[(i, t[r][i]) for r in (0, 1) for i in [np.flatnonzero(t[r])]] for t in self.tables]

    def __setstate__(self, state):
        out = []
        for table in state:
            t = np.zeros((2, 1 << SLOT_BITS), dtype=np.int32)
            for r, (i, v) in enumerate(table):
                t[r][i] = v
            out.append(t)
        self.tables, self.known = tuple(out), {}


def header_names(value: str) -> list[tuple[bool, str]]:
    """(is it a family name, word) of the persons named in an address line."""
    out, at = [], 0
    for m in _HEADER_ADDRESS.finditer(value):
        name, at, local = value[at : m.start()].rstrip(), m.end(), m.group(1).lower()
        if name.endswith('"'):
            name = name[:-1].rpartition('"')[2]
        else:
            name = _HEADER_CUT.split(name)[-1]
        words = _WORD.findall(name)
        if len(words) < 2 or not any(len(w) > 2 and w.lower() in local for w in words):
            continue
        family = 0 if "," in name else len(words) - 1
        out += [(i == family, w) for i, w in enumerate(words) if len(w) > 1]
    return out


def learn_lexicon(mails: DataFrame, columns: list[str]) -> Lexicon:
    """The lexicon of the display names in the address columns of all mails.

    A display name counts when a word of it is part of its own address, as with
    persons; of 'Family, Given' the first is the family name. Counts are summed
    by slot on the executors, so that what reaches the driver has a fixed bound.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            seen: dict[tuple[int, int, int], int] = {}
            for column in t.columns:
                for value in t[column].dropna():
                    for family, word in header_names(value):
                        for row, slot in enumerate(slots(word)):
                            key = (int(family), row, slot)
                            seen[key] = seen.get(key, 0) + 1
            if seen:
                k = np.array(list(seen))
                yield pd.DataFrame({"family": k[:, 0], "row": k[:, 1], "slot": k[:, 2], "n": list(seen.values())})

    rows = mails.select(*columns).mapInPandas(count, "family int, row int, slot int, n long").groupBy("family", "row", "slot").agg(F.sum("n").alias("n"))
    tables = np.zeros((2, 2, 1 << SLOT_BITS), dtype=np.int32)
    found = rows.toArrow()  # at most four tables of fixed size
    at = tuple(found.column(c).to_numpy() for c in ("family", "row", "slot"))
    tables[at] = np.minimum(found.column("n").to_numpy(), 1 << 30)
    return Lexicon(tables[0], tables[1])


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


_WRITTEN_DOT = re.compile(r"dot[\])]?\s?$", re.I)


def _mail_at(text: str, sign: re.Match, least: int) -> re.Match | None:
    """The mail address around a sign, not before `least`; the stretch searched goes on as far as address characters do."""
    high, before = min(len(text), max(sign.end() + 120, _MAIL_REST.match(text, sign.end()).end() + 1)), 80
    if sign.group(0) == "@":  # a plain local part ends right before the sign; what is written out is sought below
        start = sign.start()
        while start > least and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
            start -= 1
        m = None if _WRITTEN_DOT.search(text[max(0, start - 6) : start]) else _MAIL.match(text, start, high)
        if m is not None and m.end() > sign.start():
            return m
    while True:
        low = max(least, sign.start() - before)
        m = next((m for m in _MAIL.finditer(text, low, high) if m.end() > sign.start()), None)
        if m is None or m.start() > low + 10 or low == least:  # a dot that is written out takes fewer than ten characters
            return m
        before *= 2


def candidates(text: str, lexicon: Lexicon, things: bool = False) -> list[Candidate]:
    """The candidates of a text in order, without overlaps, each with its features.

    With `things`, words named as things ('project X') are open at all their
    places; these teach what an unknown word may be beside a person.
    """
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []  # sorted and without overlaps

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b,))
        return i == 0 or taken[i - 1][1] <= a

    def add(start: int, end: int, label: int, form: str, *features: str) -> None:
        insort(taken, (start, end))
        out.append(Candidate(start, end, label, form, [f"is:{LABELS[label]}", *features]))

    low = text.lower()
    if "@" in text or "＠" in text or "&#64;" in text or " at " in low or "at)" in low or "at]" in low or "at}" in low:
        at = 0
        for sign in _MAIL_SIGN.finditer(text):
            if sign.start() < at:
                continue
            m = _mail_at(text, sign, at)
            if m and m.start() < sign.end() <= m.end() + 1:
                written = m.group(0)
                add(m.start(), m.end(), EMAIL, written.lower(), "plain" if "@" in written and " " not in written else "hidden", "end:dot" if "." in written.rpartition("@")[2] else "end:word")
                at = m.end()

    if "\n" in text or any(c.isdigit() for c in text):
        for m in _ID_LABEL.finditer(text) if any(x in low for x in _ID_SIGNS) else ():
            c = _CODE.match(text, m.end())
            if c and len(c.group(0)) > 24:  # more than one number: the first word is the code
                c = _CODE.fullmatch(text, c.start(), c.start() + len(c.group(0).split()[0])) or c
            if c and len(_digits(c.group(0))) >= 5 and free(*c.span()):
                add(c.start(), c.end(), ID, "#" + re.sub(r"\W", "", c.group(0)).lower(), "label:id")
        for start, end in streets(text):
            if not free(start, end):
                continue
            written = text[start:end]
            tail = _FLOOR.match(text, end)
            end = tail.end() if tail else end
            tail = _TOWN.match(text, end)
            first = _WORD.search(written)
            add(start, tail.end() if tail else end, ADDRESS, "@" + written.lower(), "town" if tail else "no town", "number first" if written[0].isdigit() else "street first", "cap" if first and first.group(0)[0].isupper() else "low")
        phones = list(_PHONE.finditer(text))
        if _WRAP.search(text):
            phones += [m for m in _WRAPPED_PHONE.finditer(text) if (cut := m.group(0).find("\n")) > 0 and m.start() + cut - text.rfind("\n", 0, m.start()) > 45]
        for m in phones:
            number = m.group(0)
            n = len(_digits(number))
            if not 8 <= n <= 15 or _DATE.match(number) or not free(*m.span()):
                continue
            before = text[max(0, m.start() - 24) : m.start()]
            groups = "-".join(str(len(g)) for g in re.findall(r"\d+", number))
            kind = "+" if number[0] == "+" else "00" if number.startswith("00") else "(" if number[0] == "(" else "0" if number[0] == "0" else "n"
            label = "tel" if _PHONE_LABEL.search(before) else "other" if _OTHER_LABEL.search(before) else "none"
            ext = _EXTENSION.match(text, m.end())
            add(m.start(), ext.end() if ext else m.end(), PHONE, "#" + _digits(number), f"groups:{groups}", f"start:{kind}", f"label:{label}", f"digits:{n}", "plain" if number.isdigit() else "grouped")
        coded = {c.form for c in out if c.label == ID}
        if coded:  # other codes are open where a document has a labelled one
            for m in _CODE.finditer(text):
                a, b = m.span()
                word = text[a : a + 4].partition(" ")[0]
                if len(word) < 4 and word.isalpha() and not word.isupper():
                    a += len(word) + 1  # no part of the code
                if b - a > 24:
                    b = a + len(text[a:b].split()[0])
                if (a and (text[a - 1].isalnum() or text[a - 1] in "#/-.:")) or len(_digits(text[a:b])) < 5 or _DATE.match(text, a, b) or _DOTTED.fullmatch(text, a, b) or not free(a, b):
                    continue
                before = text[max(0, a - 24) : a]
                add(a, b, ID, "#" + re.sub(r"\W", "", text[a:b]).lower(), "label:other" if _OTHER_LABEL.search(before) else "label:none")

    words = set(_CAPITALISED.findall(text))
    words |= {w[:-2] for w in words if w.endswith(("'s", "’s"))}
    names = {w: v for w in words if (v := lexicon(w)) != (0, 0)}
    greeted = set()  # not in the lexicon, but with a sign beside them somewhere in the text
    for sign, word in _GREETINGS:
        at = text.find(sign) if word in words else -1
        while at >= 0:
            m = _CAPITALISED.match(text, at + len(sign))
            if m and m.group(0) not in names and m.group(0).lower() not in _NO_NAMES and (at == 0 or not text[at - 1].isalnum()):
                greeted.add(m.group(0))
            at = text.find(sign, at + 1)
    for sign in _THINGS if things else ():
        at = low.find(sign)
        while at >= 0:
            m = _CAPITALISED.match(text, at + len(sign))
            if m and m.group(0) not in names and m.group(0).lower() not in _NO_NAMES:
                greeted.add(m.group(0))
            at = low.find(sign, at + 1)
    hits = []
    for w in (*names, *greeted):
        at = text.find(w)
        while at >= 0:
            end = at + len(w)
            if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_@+")) and (end == len(text) or not (text[end].isalnum() or text[end] in "_@+")):
                hits.append((at, end, w))
            at = text.find(w, end)
    hits.sort()
    lower_words = set(_WORD.findall(text)) if any(w not in names for _, _, w in hits) else ()
    last_end = -2
    for a, b, w in hits:
        if not free(a, b):
            continue
        given, family = names.get(w, (0, 0))
        before = text[max(0, a - 20) : a]
        after = text[b : b + 2]
        role = "both" if given and family else "given" if given else "family" if family else "unknown"
        size = "many" if given + family >= 10 else "some" if given + family >= 2 else "once" if given + family else "zero"
        lead = "title" if _TITLE.search(before) else "greeting" if _GREETING.search(before) else "thing" if _NOT_PERSON.search(before) else "line" if a == 0 or text[a - 1] == "\n" else "word"
        shape = "upper" if w.isupper() else "cap" if w[1:].islower() else "mixed"
        start, initial = a, _INITIAL_BEFORE.search(text[max(0, a - 8) : a])
        if initial and not (last_end <= a - len(initial.group(0)) <= last_end + 1) and free(a - len(initial.group(0)), a):
            start = a - len(initial.group(0))
        last_end = b
        out.append(Candidate(start, b, NAME, w.lower(), ["is:name", f"lexicon:{role}", f"count:{size}", f"before:{lead}", f"shape:{shape}", f"after:{after[:1] if not after[:1].isalnum() else 'a'}", f"role&{role}&{lead}", *(["initial"] if start < a else []), *(["also lower"] if role == "unknown" and w.lower() in lower_words else [])], ROLES.index(role)))
    out.sort(key=lambda c: c.start)
    for one, other in zip(out, out[1:]):
        if other.start - one.end <= 40:
            other.gap = gap_kind(text, one, other)
    return out


_INITIAL_BEFORE = re.compile(r"(?:^|(?<=[^\w.@-]))(?:[^\W\d_a-zà-ÿ]\.[ -]?){1,2}\s?$")
_BETWEEN = re.compile(r"\s(?:[^\W\d_a-zà-ÿ]\.\s|(?:von|van|de|du|la|del|der|di)\s){0,2}|-|\s?\n(?:[>|] ?)*")


def gap_kind(text: str, one: Candidate, other: Candidate) -> int:
    """What stands between two neighbouring candidates, as a place in GAPS."""
    gap = text[one.end : other.start]
    if one.label != NAME or other.label != NAME:
        return 4
    if gap.strip(" ") == ",":
        return 1
    if not _BETWEEN.fullmatch(gap):
        return 4
    if "\n" not in gap:
        return 0
    return 3 if one.end - (text.rfind("\n", 0, one.start) + 1) < 40 else 2


def silver(nodes: list[Candidate]) -> list[int | None]:
    """The labels that sure signs give the candidates of a document of the fitting sample; None where there is none."""
    out: list[int | None] = []
    labelled = {c.form for c in nodes if "label:id" in c.features}
    named = {c.form for c in nodes if "before:greeting" in c.features or "before:title" in c.features}
    for i, c in enumerate(nodes):
        f = set(c.features)
        label: int | None = None
        if c.label == EMAIL:
            label = EMAIL
        elif c.label == ADDRESS:
            label = ADDRESS if "cap" in f or "town" in f else None
        elif c.label == ID:
            label = ID if "label:id" in f or c.form in labelled else 0
        elif c.label == PHONE:
            label = 0 if "label:other" in f else PHONE
        elif "before:thing" in f:
            label = 0
        elif "count:many" in f or "count:some" in f or (c.form in named and "also lower" not in f):
            before = nodes[i - 1] if i and out[-1] in (NAME, INSIDE) else None
            turned = before is not None and ROLES[before.role] == "family" and ROLES[c.role] == "given"  # family name first, or the next person
            goes_on = before is not None and 0 <= c.gap < JOINING and turned == (GAPS[c.gap] == "comma")
            label = INSIDE if goes_on else NAME
        elif "count:zero" in f:
            label = 0  # also beside a greeting or title, if the word is one of the text's common ones
        out.append(label)
    return out


def hide(documents: list[list[Candidate]], share: float = 0.5, seed: int = 17) -> list[list[Candidate]]:
    """The documents without the sure features of a random `share` of their tokens other than names."""
    rng = np.random.default_rng(seed)
    bare = lambda c: replace(c, features=[f for f in c.features if not f.startswith(SURE)])
    return [[bare(c) if h and c.label != NAME else c for c, h in zip(d, rng.random(len(d)) < share)] for d in documents]


class Forgetful:
    """A lexicon without half of its words, those of even hash: what it lacks stands for persons whom no mail header names."""

    def __init__(self, lexicon):
        self.lexicon = lexicon

    def __call__(self, word: str) -> tuple[int, int]:
        return (0, 0) if slots(word)[0] % 2 == 0 else self.lexicon(word)


def taught(texts: list[str], lexicon) -> tuple[list[list[Candidate]], list[list[int | None]]]:
    """Documents and their labels by the whole lexicon: each text as it is, and as it looks with half of the lexicon and of the sure signs."""
    whole = [candidates(t, lexicon, True) for t in texts]
    labels = [silver(d) for d in whole]
    part = [candidates(t, Forgetful(lexicon), True) for t in texts]
    known = [{c.start: v for c, v in zip(d, ls)} for d, ls in zip(whole, labels)]
    own = [[k.get(c.start, 0 if c.label == NAME else None) for c in d] for d, k in zip(part, known)]
    own = [[NAME if v == INSIDE and not (i and 0 <= c.gap < JOINING and vs[i - 1] in (NAME, INSIDE)) else v for i, (c, v) in enumerate(zip(d, vs))] for d, vs in zip(part, own)]  # its beginning is forgotten
    return whole + hide(part), labels + own


class Graph:
    """The candidates of many documents with their links, as arrays."""

    def __init__(self, documents: list[list[Candidate]]):
        self.nodes = [c for d in documents for c in d]
        chain, kinds, skip, at = [], [], [], 0
        for nodes in documents:
            last: dict[str, int] = {}
            for i, c in enumerate(nodes):
                if c.gap >= 0:
                    chain.append((at + i - 1, at + i))
                    kinds.append((c.gap * 4 + nodes[i - 1].role) * 4 + c.role)
                if c.form in last:
                    skip.append((at + last[c.form], at + i))
                last[c.form] = i
            at += len(nodes)
        self.chain, self.kinds = np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(kinds, dtype=np.int64)
        self.skip = np.array(skip, dtype=np.int64).reshape(-1, 2)
        self.of_name = np.array([int(self.nodes[a].label == NAME) for a, _ in skip], dtype=np.int64)
        n = len(self.nodes)
        self.closed = np.ones((n, len(LABELS)), dtype=bool)
        if n:
            self.closed[:, 0] = False
            own = np.array([c.label for c in self.nodes])
            self.closed[np.arange(n), own] = False
            self.closed[own == PHONE, ID] = False
            self.closed[[i for i, c in enumerate(self.nodes) if c.label == NAME and 0 <= c.gap < JOINING], INSIDE] = False


class SkipChain:
    """A skip-chain CRF: unary, chain and skip weights learnt together, loopy sum-product inference for many documents at once."""

    def __init__(self, chain: bool = True, skip: bool = True):
        k = len(LABELS)
        self.index: dict[str, int] = {}
        self.use = chain, skip
        self.weights = {"unary": np.zeros((0, k - 1)), "chain": np.zeros((len(GAPS), k, k)), "roles": np.zeros((len(GAPS) * 16, 2)), "skip": np.zeros((2, k - 1, k - 1))}

    def _features(self, graph: Graph) -> tuple[np.ndarray, np.ndarray]:
        get = self.index.get
        pairs = [(i, k) for i, c in enumerate(graph.nodes) for k in map(get, c.features) if k is not None]
        return np.array(pairs, dtype=np.int64).reshape(-1, 2).T

    def _scores(self, graph: Graph, features: tuple[np.ndarray, np.ndarray], w: dict) -> tuple[np.ndarray, list]:
        """Unary scores, and (from, to, table) for each kind of link that is in use."""
        node, feature = features
        n = len(graph.nodes)
        unary = np.stack([np.bincount(node, w["unary"][feature, y], n) for y in range(len(LABELS) - 1)], axis=1)[:, KIND]
        unary[graph.closed] = -30.0
        links = []
        if len(graph.chain):
            table = w["chain"][graph.kinds // 16] if self.use[0] else np.zeros((len(graph.kinds), *w["chain"].shape[1:]))
            if self.use[0]:
                table[:, NAME, NAME:] += w["roles"][graph.kinds]
                table[:, INSIDE, NAME:] += w["roles"][graph.kinds]
            table[:, :NAME, INSIDE] = -30.0  # a name goes on only after a name
            links.append((graph.chain, table))
        if len(graph.skip) and self.use[1]:
            links.append((graph.skip, w["skip"][:, KIND][:, :, KIND][graph.of_name]))
        return unary, links

    @staticmethod
    def _messages(unary: np.ndarray, links: list, rounds: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log beliefs of the nodes and of the links (pairs of labels) after `rounds` rounds over all links."""
        norm = lambda x: x - x.max(axis=1, keepdims=True)
        tables = [np.exp(t) for _, t in links]
        ahead, back = ([np.zeros((len(p), unary.shape[1])) for p, _ in links] for _ in (0, 1))
        belief = unary
        for _ in range(rounds):
            for k, (pairs, _) in enumerate(links):
                a, b = pairs[:, 0], pairs[:, 1]
                forth = np.log(np.einsum("ei,eij->ej", np.exp(norm(belief[a] - back[k])), tables[k]) + 1e-30)
                home = np.log(np.einsum("ej,eij->ei", np.exp(norm(belief[b] - ahead[k])), tables[k]) + 1e-30)
                ahead[k], back[k] = 0.5 * ahead[k] + 0.5 * norm(forth), 0.5 * back[k] + 0.5 * norm(home)
            belief = unary.copy()
            for k, (pairs, _) in enumerate(links):
                for y in range(unary.shape[1]):
                    belief[:, y] += np.bincount(pairs[:, 1], ahead[k][:, y], len(unary)) + np.bincount(pairs[:, 0], back[k][:, y], len(unary))
        both = [(belief[p[:, 0]] - back[k])[:, :, None] + (belief[p[:, 1]] - ahead[k])[:, None, :] + t for k, (p, t) in enumerate(links)]
        return belief, both

    def fit(self, documents: list[list[Candidate]], labels: list[list[int | None]], steps: int = STEPS, rate: float = 2.0, decay: float = 2e-5) -> None:
        """All weights by likelihood: expected counts with the known labels held, less those without, by loopy messages (Adagrad).

        What carries no label is summed over.
        """
        graph = Graph(documents)
        y = np.array([-1 if v is None else v for d in labels for v in d], dtype=np.int64)
        for c in graph.nodes:
            for f in c.features:
                self.index.setdefault(f, len(self.index))
        w = self.weights
        w["unary"] = np.zeros((len(self.index), len(LABELS) - 1))
        known = np.flatnonzero(y >= 0)
        if not len(known):
            return
        held = np.zeros((len(y), len(LABELS)))
        held[known] = -30.0
        held[known, y[known]] = 0.0
        node, feature = self._features(graph)
        squares = {k: np.full_like(v, 1e-6) for k, v in w.items()}

        def share(x: np.ndarray) -> np.ndarray:
            flat = x.reshape(len(x), -1)
            p = np.exp(flat - flat.max(axis=1, keepdims=True))
            return (p / p.sum(axis=1, keepdims=True)).reshape(x.shape)

        for _ in range(steps):
            unary, links = self._scores(graph, (node, feature), w)
            (free, free_links), (fixed, fixed_links) = self._messages(unary, links, 4), self._messages(unary + held, links, 4)
            slope = {k: -decay * len(known) ** 0.5 * v for k, v in w.items()}
            gap = share(fixed) - share(free)
            gap = np.concatenate([gap[:, :NAME], gap[:, NAME:].sum(axis=1, keepdims=True)], axis=1)
            slope["unary"] = slope["unary"] + np.stack([np.bincount(feature, gap[node, k], len(self.index)) for k in range(len(LABELS) - 1)], axis=1)
            for (pairs, _), one, other in zip(links, fixed_links, free_links):
                d = share(one) - share(other)
                if pairs is graph.chain and self.use[0]:
                    for g in range(len(GAPS)):
                        slope["chain"][g] += d[graph.kinds // 16 == g].sum(axis=0)
                    after = d[:, NAME:, NAME:].sum(axis=1)
                    slope["roles"] += np.stack([np.bincount(graph.kinds, after[:, k], len(w["roles"])) for k in (0, 1)], axis=1)
                elif pairs is graph.skip:
                    for g in (0, 1):
                        part = np.zeros_like(slope["skip"][g])
                        np.add.at(part, (KIND[:, None], KIND[None]), d[graph.of_name == g].sum(axis=0))
                        slope["skip"][g] += part + part.T
            for k in w:
                squares[k] += slope[k] ** 2
                w[k] += rate * slope[k] / np.sqrt(squares[k])

    def marginals(self, documents: list[list[Candidate]]) -> np.ndarray:
        """(nodes, labels) beliefs after ROUNDS rounds of messages over both kinds of links."""
        graph = Graph(documents)
        if not graph.nodes:
            return np.zeros((0, len(LABELS)))
        belief, _ = self._messages(*self._scores(graph, self._features(graph), self.weights), ROUNDS)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def mentions(nodes: list[Candidate], best: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the document's entities; a name reaches to the last token that goes on with it."""
    out: list[tuple[str, int, int]] = []
    inside = False
    for c, label in zip(nodes, best.tolist()):
        if label == INSIDE and inside:
            out[-1] = (*out[-1][:2], c.end)
        elif label:
            out.append(("name" if label == INSIDE else LABELS[label], c.start, c.end))
        inside = label in (NAME, INSIDE)
    return out


#: Texts written for this project, from which the signs are learnt that a sample may lack, and their names.
SEED_NAMES = {"Given": ("Mara", "Edda", "Ivo", "Nils", "Tilda"), "Family": ("Quandt", "Osterlo", "Vermeulen", "Haddad", "Sorlin")}
SEED_TEXTS = (
    "Dear Mara Quandt,\nplease call +44 20 7946 0991 or write to mara.quandt@seed.example.\nIvo Osterlo",
    "Hi Edda,\nproject Quandt is late. Mr. Haddad and Osterlo, Nils met Tilda Vermeulen.\nOrder 370-555-1234, tel. 370-555-1299.",
    "Sehr geehrte Frau Sorlin,\nReisepass-Nr. C4711X0815, Telefon 030 23125 990. Projekt Haddad, Rechnung 4711 2208 15.\nNils Quandt",
    "Bonjour Mme Vermeulen,\nle passeport no. 12AB34567 et encore 12AB34567; colis 998877665. 5 rue de Lille, Paris",
    "Hola Ivo,\nDNI 12345678Z, tel. 612 345 678, pedido 612-345-999. Calle Mayor 45, Madrid. El proyecto Sorlin de M. Osterlo",
    "Dear Zelmo,\nthanks. Zelmo, I sent it to Flat 6, 12 Mill Lane, Oxford. Passport number: AB7654321, again AB7654321.",
    "Dr. Quandt asked Tilda Sorlin, Edda Haddad and Nils. Ticket 20240506, tax id 77 123 456 789.\nwrite to nils (at) seed dot example",
    "The company Osterlo, the branch Vermeulen and the release Mara 2; ask Edda Haddad.\n45 harbour street, Dover",
    "Dear Torvik,\nit is late. Then ask Torvik about it.", "The project Melvane is late. Then ask Melvane about it.",
    "Mr. Jaskel is out. You can reach Jaskel later.", "The company Brindal is out. You can reach Brindal later.",
    "Hallo Wengo,\nwir warten. Bitte Wengo fragen.", "Das Projekt Listrum wartet. Bitte Listrum fragen.",
    "Call 020 7946 0384 today, invoice 020 7946 0999. SSN: 900-12-3456, 900-12-3456 once more.",
)


def _seed_lexicon(word: str) -> tuple[int, int]:
    return 20 * (word in SEED_NAMES["Given"]), 20 * (word in SEED_NAMES["Family"])


class Finder:
    """A lexicon and a fitted model; finds the entities of many texts at once."""

    def __init__(self, lexicon: Lexicon, texts: list[str], chain: bool = True, skip: bool = True):
        self.lexicon, self.model = lexicon, SkipChain(chain, skip)
        documents, labels = taught([t for t in texts if t], lexicon)
        seeds, of_seeds = taught(list(SEED_TEXTS) * max(1, len(texts) // 400), _seed_lexicon)
        self.model.fit(documents + seeds, labels + of_seeds)

    def __call__(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = []
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            documents = [candidates(t, self.lexicon) if t else [] for t in part]
            best = self.model.marginals(documents).argmax(axis=1)
            i = 0
            for d in documents:
                out.append(mentions(d, best[i : i + len(d)]))
                i += len(d)
        return out


def fit(texts: DataFrame, id_: str, text: str, mails: DataFrame, columns: list[str], sample: int = FIT_TEXTS) -> Finder:
    """A finder whose lexicon covers all mails and whose CRF is fitted on `sample` texts (those of least id hash)."""
    return Finder(learn_lexicon(mails, columns), least_hashes(texts, [id_, text], text, sample))


def occurrences(texts: DataFrame, keys: list[str], text: str, finder: Finder) -> DataFrame:
    """(keys, kind, start, end): each occurrence, offsets in characters from 0.

    Null, empty and blank texts have none; a repeated row repeats its
    occurrences; texts are never cut; further columns are ignored. One pass
    without a shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast(finder)  # tables of fixed size and a bounded model

    @F.pandas_udf("array<struct<kind string, start int, end int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = shared.value
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in found] for found in run(list(batch))])

    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.explode(find(F.col(text))).alias("_e"))
    return rows.select(*keys, "_e.kind", "_e.start", "_e.end")


def redact_text(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with a placeholder such as [EMAIL] for each entity, all else unchanged."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join(out) + text[at:]


def redact(texts: DataFrame, text: str, finder: Finder, out: str = "redacted") -> DataFrame:
    """Adds `out`: the text with typed placeholders; null stays null."""
    shared = texts.sparkSession.sparkContext.broadcast(finder)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            values = list(batch)
            yield pd.Series([None if t is None else redact_text(t, f) for t, f in zip(values, shared.value(values))], dtype=object)

    return texts.withColumn(out, run(F.col(text)))
