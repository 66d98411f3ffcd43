"""Newly written text of e-mails: a recursive layout grammar over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of mail clients and closing formulas in English, German, French and Spanish.
_WROTE = r"(?:wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe)"
_QUOTED = regex.compile(r"\s*[>|](?!\|)")
_PREFIX = regex.compile(r"\s*[>|] ?")
_INTRO = regex.compile(
    rf"(?:(?:On|Am|Le|El)\s.{{0,20}}\d.{{4,160}}\s{_WROTE}(?:\s.{{0,60}})?\s?:|.{{2,120}}\s{_WROTE}(?:\s(?:on|am|le|el)\s.{{4,40}})?\s?:|.{{2,80}}<[^<>\s]+@[^<>\s]+>(?:\s.{{0,40}}\d.{{0,20}})?\s?:)\s*",
    regex.I,
)
_SENTENCE_END = regex.compile(r"[.!?…][\"')»]*\s*$")
_FORWARD = regex.compile(
    r"\s*(?:[-_]{3,}\s*(?:forwarded message|original message|original appointment|weitergeleitete nachricht|ursprüngliche nachricht|message (?:transféré|d'origine|original)|mensaje (?:original|reenviado))\s*[-_]{3,}"
    r"|(?:begin forwarded message|anfang der weitergeleiteten (?:e-mail|nachricht)|début du message (?:transféré|réexpédié)|inicio del mensaje reenviado)\s?:)\s*",
    regex.I,
)
_HEADER = regex.compile(r"\s*\*?(from|sent|date|to|cc|subject|reply-to|von|gesendet|datum|an|betreff|de|envoyé|à|objet|enviado|fecha|para|asunto)\s?:\*?(?:\s|$)", regex.I)
_FROM = regex.compile(r"\s*\*?(?:from|von|de)\s?:\*?(?:\s|$)", regex.I)
_RULE = regex.compile(r"\s*(?:[-_=*]{5,}|(?:\* ){2,}\*)\s*")
_RULE_SIGNS = "-_=*—"
_DELIMITER = regex.compile(r"\s*(?:-{2,3}|_{2,3}|—)\s*")
_CLOSING = regex.compile(
    r"\s*(?:(?:(?:with |mit |avec |con )?(?:(?:my |our |the |very |many |all |die |den |un |una |mes |nos |mis |nuestros |muchos |muchas |viele[nr]? |vielen |beste[nr]? |liebe[nr]? |schöne[nr]? |freundliche[nr]? |herzliche[nr]? "
    r"|kind |kindest |best |warm |warmest |bien |très |sincères |meilleures |cordiales |distinguées |un cordial |cordial )*"
    r"(?:regards|wishes|thanks|gr(?:ü|ue)(?:ß|ss)(?:e|en)?|dank|salutations|saludos?|abrazo|gracias|remerciements|merci)"
    r"(?: (?:and|und|et|y) (?:best |kind |beste |viele )?(?:regards|wishes|thanks|grüße|gruß|dank|saludos|salutations|cordialement))?(?: (?:in advance|im voraus|d'avance|cordial(?:es)?|cordiaux|distingués|distinguées|aus \p{Lu}\w+))?))"
    r"|cheers|best|thanks|thank you|yours|yours (?:sincerely|faithfully|truly)|sincerely|(?:mit )?hochachtungsvoll|[vlm]g|mfg|bg|beste gr(?:üße|uesse)|schönen tag|"
    r"cordialement|bien cordialement|bien à (?:vous|toi)|bonne journée|bonne soirée|amicalement|à bientôt|sincèrement|"
    r"atentamente|cordialmente|un saludo|un abrazo|hasta pronto|reciba un (?:cordial )?saludo|br|rgds|kr|ciao|take care|tschüss)\s*[,.!]?\s*",
    regex.I,
)
_NAME = regex.compile(r"\s*(?:(?:dr|prof|mr|mrs|ms|herr|frau|m|mme|sr|sra)\.?\s+)?\p{L}[\p{L}'’.-]*(?:\s+(?:\p{Lu}\.|(?:von|van|de|du|la|le|del)\s+)?\p{L}[\p{L}'’.-]*){0,3}\s*,?\s*", regex.I)
_CAPITAL = regex.compile(r"\s*(?:\p{Lu}[\p{L}'’-]*\.?|von|van|de|du|la|del)(?:\s+(?:\p{Lu}[\p{L}'’-]*\.?|von|van|de|du|la|del)){0,3}\s*,?\s*")
_CONTACT = regex.compile(
    r"\s*(?:[☎✉📞📱]|(?:t|e|m|p|f|tel|tél|phone|mobile|mobil|móvil|fax|email|e-mail|mail|web|cell|direct|office|telefon|teléfono|téléphone|portable|handy|fon)\b\.?\s*:?\s*[+(\d\p{L}]|https?://|www\.|\+?[\d() /.-]{7,}|\S+@\S+\s*$|.{2,40}\s[|·•]\s.{2,40}$)",
    regex.I,
)
_DEVICE = regex.compile(
    r"\s*(?:sent from (?:my|the)\b|sent (?:with|via|by) my\b|get \p{Lu}\w+ for (?:your )?\w+|(?:von|aus) mein\p{L}* .{2,30} gesendet|gesendet (?:von|mit|aus)\b|diese nachricht wurde (?:von|mit) meinem\b|envoyé (?:de|depuis|avec) m(?:on|a)\b|enviado (?:desde|con) mi\b).{0,60}",
    regex.I,
)
_SMALL = r"(?:note|notice|hinweis|avis|aviso|legal (?:note|notice)|confidential(?:ity)?(?: (?:note|notice))?|vertraulich(?:keitshinweis)?|confidentiel|confidencial|disclaimer|rechtlicher hinweis|mention légale|aviso legal|\*{3})"
_NOTICE_START = regex.compile(rf"\s*(?:{_SMALL}\s*(?:[:–—-]|\*|(?<=\*{{3}}))\s*)", regex.I)
_NOTICE_CUES = (
    "intended for", "intended solely", "intended only", "reserved for", "reserved solely", "reserved only", "meant for", "meant solely", "meant only", "addressee", "named reader", "people listed above", "confidential",
    "in error", "by mistake", "right reader", "inform us", "inform the sender", "tell the sender", "notify the sender", "destroy it", "delete it", "erase it", "destroy every copy", "delete every copy", "all copies",
    "no liability", "without consent", "no contract arises", "those of the writer", "e-mail and its attachments", "content of this mail",
    "empfänger bestimmt", "genannte person", "vertraulich", "irrtümlich", "samt anhang", "nicht gemeint", "löschen sie", "informieren sie", "absender", "ohne zustimmung", "keine haftung", "versehentlich",
    "confidentiel", "destinataire", "personnes nommées", "par erreur", "en cas d'erreur", "prévenez", "prévenir l'expéditeur", "supprimez", "détruire", "ce courriel", "sans accord", "sans autorisation", "aucune responsabilité",
    "confidencial", "destinatario", "personas citadas", "por error", "avise al", "bórre", "borre", "elimine", "este correo", "sin permiso", "sin consentimiento", "ninguna responsabilidad", "si no es para usted",
)
_FOOTER = regex.compile(
    r"\s*(?:(?:please )?do not (?:answer|reply)\b.{0,60}|you (?:get|got|receive|received|are receiving) this (?:e-?mail|mail|message|notice)s? because.{0,80}|(?:manage|change|edit) your (?:notices|notifications|subscription|settings|preferences).{0,60}|(?:to )?unsubscribe\b.{0,60}"
    r"|this (?:is an automatic|is an automated|(?:e-?mail|mail|message) was (?:sent|generated|created) automatically).{0,80}|bitte (?:antworten sie nicht|nicht antworten).{0,60}|diese (?:automatische )?(?:e-mail|nachricht|mail) wurde automatisch.{0,80}|sie erhalten diese.{0,80}|abmelden\b.{0,40}"
    r"|(?:merci de )?ne (?:pas répondre|répondez pas).{0,60}|vous recevez ce.{0,80}|ceci est un (?:message|courriel) automatique.{0,60}|se désabonner.{0,40}|(?:por favor,? )?no (?:responda|conteste).{0,60}|recibe este.{0,80}|este es un (?:mensaje|correo) automático.{0,60}|cancelar la suscripción.{0,40})",
    regex.I,
)
_FOOTER_WORDS = ("do not answer", "do not reply", " this ", "manage your", "change your", "edit your", "unsubscribe", "antworten", "automatisch", "sie erhalten", "abmelden", "répond", "vous recevez", "automatique", "désabonner", "no responda", "no conteste", "recibe este", "automático", "cancelar")
_POSTSCRIPT = regex.compile(r"\s*p\.?\s?s\.?\s*[:.]?\s", regex.I)
_MARK = regex.compile(r"\s*(?:[(\[][\p{L} ]{3,20}[)\]]|v\d{1,2})\s*")


@dataclass(frozen=True)
class Limits:
    """How long the parts of a layout may be: what is longer is taken for text. The defaults suit mails; raise them for other layouts."""

    intro_lines: int = 8
    intro_chars: int = 400
    header_lines: int = 12
    contact_lines: int = 9
    contact_chars: int = 90
    name_lines: int = 2
    name_chars: int = 50
    signature_chars: int = 66


DEFAULT_LIMITS = Limits()


@dataclass
class Node:
    """A stretch of lines [start, end) of one kind: new, quote, forward, signature, notice or footer.

    `content` are the lines of a quoted or forwarded mail without their marks;
    where `offset` is given they are the outer mail's own lines from there on.
    """

    kind: str
    start: int
    end: int
    content: list[str] | None = None
    offset: int | None = None
    children: list[Node] = field(default_factory=list)


def _blank(line: str) -> bool:
    return not line or line.isspace()


class Grammar:
    """Descent over the lines of one body; `tree` descends into the bodies found in it.

    body      = { quote | forward | notice | footer | signature | new }
    quote     = [ intro ] quoted-line { quoted-line }        its content is a body
    intro     = lines that end in a colon and say who wrote when
    forward   = ( separator [ headers ] | headers ) body     up to the end, or to text below the forwarded mail's signature
    signature = closing [ names ] [ delimiter contacts ] | delimiter contacts | names contacts | device-line
    notice    = [ rule ] legal-paragraph
    footer    = [ rule ] automatic-line { automatic-line }
    """

    def __init__(self, lines: list[str], limits: Limits = DEFAULT_LIMITS):
        self.lines, self.n, self.limits = lines, len(lines), limits
        # What a body has nothing of is not sought line by line.
        text = " ".join(x.strip() for x in lines).lower()
        self.notices = any(c in text for c in _NOTICE_CUES)
        self.introductions = any(x.rstrip()[-1:] == ":" for x in lines)
        self.forwards = any(_FROM.match(x) or _FORWARD.fullmatch(x) for x in lines if ":" in x or "-" in x or "_" in x)
        self.footers = any(w in text for w in _FOOTER_WORDS)

    def parse(self) -> list[Node]:
        out: list[Node] = []
        at = 0
        while at < self.n:
            if _blank(self.lines[at]):
                at += 1
                continue
            node = self.quote(at) or self.forward(at) or self.footer(at) or self.notice(at) or self.signature(at, bool(out)) or Node("new", at, at + 1)
            if node.kind == "new" and out and out[-1].kind == "new" and out[-1].end == at:
                out[-1].end = node.end
            else:
                out.append(node)
            at = node.end
        return out

    def paragraph_end(self, at: int) -> int:
        while at < self.n and not _blank(self.lines[at]):
            at += 1
        return at

    def next_line(self, at: int) -> int:
        while at < self.n and _blank(self.lines[at]):
            at += 1
        return at

    def quoted_end(self, at: int) -> int:
        while at < self.n and _QUOTED.match(self.lines[at]):
            at += 1
        return at

    def quote(self, at: int) -> Node | None:
        body = self.intro_end(at)
        if body is None:
            return None
        end = self.quoted_end(body)
        if end == body:  # an introduction without marked lines: all that follows is quoted
            return Node("quote", at, self.n, self.lines[body:], body)
        return Node("quote", at, end, [_PREFIX.sub("", x, count=1) for x in self.lines[body:end]])

    def intro_end(self, at: int) -> int | None:
        """Where the quoted lines begin if an introduction or a quoted line is at `at`."""
        if _QUOTED.match(self.lines[at]):
            return at
        if not self.introductions:
            return None
        text = ""
        for size in range(1, self.limits.intro_lines + 1):
            i = at + size - 1
            if i >= self.n or _blank(self.lines[i]) or _QUOTED.match(self.lines[i]):
                return None
            text = (text + " " + self.lines[i].strip()).strip()
            if len(text) > self.limits.intro_chars:
                return None
            if text.endswith(":") and _INTRO.fullmatch(text):
                if size > 1 and _SENTENCE_END.search(self.lines[at]) and self.intro_end(at + 1) is not None:
                    return None  # a sentence stands above the introduction
                after = self.next_line(i + 1)
                if after < self.n and _QUOTED.match(self.lines[after]):
                    return after
                whole = text.endswith(":") and any(c.isdigit() for c in text) and ("@" in text or size > 1 or regex.match(r"(?:On|Am|Le|El)\s", text))
                return i + 1 if whole and after < self.n else None
        return None

    def headers_end(self, at: int) -> int:
        """The end of a block of at least three mail headers, the first naming the sender, or `at`."""
        if at >= self.n or not _FROM.match(self.lines[at]):
            return at
        end, count = at, 0
        while end < self.n and not _blank(self.lines[end]):
            if _HEADER.match(self.lines[end]):
                count += 1
            elif count == 0 or end - at > self.limits.header_lines or count >= 4:
                break
            end += 1
        return end if count >= 3 else at

    def forward(self, at: int) -> Node | None:
        if not self.forwards:
            return None
        line = self.lines[at]
        if _FORWARD.fullmatch(line):
            head = self.next_line(at + 1)
            body = max(self.headers_end(head), at + 1)
        elif _RULE.fullmatch(line) and self.headers_end(self.next_line(at + 1)) > self.next_line(at + 1):
            body = self.headers_end(self.next_line(at + 1))
        else:
            body = self.headers_end(at)
            if body == at:
                return None
        end = self.n
        last = self.n - 1
        while last > body and _blank(self.lines[last]):
            last -= 1
        if last > body and _blank(self.lines[last - 1]) and _MARK.fullmatch(self.lines[last]):
            end = last  # a remark of the sender's below all
        return Node("forward", at, end, self.lines[body:end], body)

    def after_rule(self, at: int) -> int:
        if self.lines[at].lstrip()[:1] not in _RULE_SIGNS:
            return at
        return self.next_line(at + 1) if _RULE.fullmatch(self.lines[at]) or _DELIMITER.fullmatch(self.lines[at]) else at

    def notice(self, at: int) -> Node | None:
        if not self.notices:
            return None
        start = self.after_rule(at)
        if start >= self.n:
            return None
        ruled = start > at
        named = _NOTICE_START.match(self.lines[start])
        if not (named or ruled or at == 0 or _blank(self.lines[at - 1])):
            return None
        end = self.paragraph_end(start)
        for i in range(start + 1, end):
            if _POSTSCRIPT.match(self.lines[i]) or _QUOTED.match(self.lines[i]) or _FORWARD.fullmatch(self.lines[i]):
                end = i
                break
        text = " ".join(x.strip() for x in self.lines[start:end]).lower()
        cues = sum(c in text for c in _NOTICE_CUES)
        return Node("notice", at, end) if cues >= (1 if named else 2) else None

    def footer(self, at: int) -> Node | None:
        if not self.footers:
            return None
        start = self.after_rule(at)
        end = start
        while end < self.n and _FOOTER.fullmatch(self.lines[end]):
            end += 1
        return Node("footer", at, end) if end > start else None

    def breaks(self, i: int) -> bool:
        """Whether something that is no signature begins at line i."""
        line = self.lines[i]
        return bool(_QUOTED.match(line) or _FORWARD.fullmatch(line) or _POSTSCRIPT.match(line) or _NOTICE_START.match(line) or _MARK.fullmatch(line) or _FOOTER.fullmatch(line) or _FROM.match(line)) or _RULE.fullmatch(line) is not None or self.intro_end(i) is not None

    def contacts_end(self, at: int) -> int:
        """The end of a short block of name and contact lines."""
        end = at
        while end < self.n and end - at < self.limits.contact_lines and not _blank(self.lines[end]) and len(self.lines[end]) <= self.limits.contact_chars and not self.breaks(end):
            end += 1
        return end

    def names_end(self, at: int) -> int:
        end = at
        while end < self.n and end - at < self.limits.name_lines and _CAPITAL.fullmatch(self.lines[end]) and len(self.lines[end]) < self.limits.name_chars and not _CLOSING.fullmatch(self.lines[end]):
            end += 1
        return end

    def delimited_end(self, at: int) -> int:
        """The end of a delimiter with contacts at `at`, or `at`."""
        if at < self.n and _DELIMITER.fullmatch(self.lines[at]):
            end = self.contacts_end(at + 1)
            if end > at + 1 and _CAPITAL.match(self.lines[at + 1]) and _NAME.fullmatch(self.lines[at + 1]):
                return end
        return at

    def signature(self, at: int, inside: bool) -> Node | None:
        line = self.lines[at]
        if len(line) > self.limits.signature_chars:
            return None
        if _DEVICE.fullmatch(line):
            return Node("signature", at, at + 1)
        end = self.delimited_end(at)
        if end > at:
            return Node("signature", at, end)
        if _CLOSING.fullmatch(line):
            name = self.next_line(at + 1)
            end = self.names_end(name) if name - at <= 3 else at + 1
            if end > name:
                further = self.delimited_end(end)
                if further == end:
                    further = self.delimited_end(self.next_line(end))
                    further = further if further > self.next_line(end) else end
                if further == end and not (end < self.n and _blank(self.lines[end])):
                    further = self.contacts_end(end)
                return Node("signature", at, max(end, further))
            delimited = self.delimited_end(name)
            if delimited > name:
                return Node("signature", at, delimited)
            if inside and (name >= self.n or self.breaks(name)):
                return Node("signature", at, at + 1)
            return None
        if inside and _blank(self.lines[at - 1]) and _CAPITAL.fullmatch(line) and _NAME.fullmatch(line):
            end = self.contacts_end(at)
            if end > at + 1 and (end == self.n or _blank(self.lines[end]) or self.breaks(end)) and any(_CONTACT.match(x) for x in self.lines[at + 1 : end]):
                return Node("signature", at, end)
        return None


def lines_of(body: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in body.split("\n")]


def tree(lines: list[str], limits: Limits = DEFAULT_LIMITS) -> list[Node]:
    """The nodes of a body, with those of quoted and forwarded mails as children, to any depth.

    A quoted or forwarded mail without marks reaches to the end of the body
    unless its own tree says where it ends: text below its signature that is
    no postscript goes back to the body that holds it.
    """
    top = Grammar(lines, limits).parse()
    order = [(top, n) for n in top if n.content]
    for _, node in order:  # grows as it goes
        node.children = Grammar(node.content, limits).parse()
        order += [(node.children, n) for n in node.children if n.content]
    for nodes, node in reversed(order):
        if node.offset is None:
            continue
        last = max((i for i, c in enumerate(node.children) if c.kind == "signature"), default=None)
        below = node.children[last + 1 :] if last is not None else []
        if below and all(c.kind == "new" for c in below) and not _POSTSCRIPT.match(node.content[below[0].start]):
            del node.children[last + 1 :]
            at = next(i for i, n in enumerate(nodes) if n is node)
            nodes[at + 1 : at + 1] = [Node("new", node.offset + c.start, node.offset + c.end) for c in below]
            node.end = node.offset + below[0].start
    return top


def parse(body: str, limits: Limits = DEFAULT_LIMITS) -> list[Node]:
    """The layout tree of a body."""
    return tree(lines_of(body), limits)


def old_lines(body: str | None, limits: Limits = DEFAULT_LIMITS) -> list[int]:
    """The numbers of the lines that hold more than white space and are not newly written."""
    if not body or body.isspace():
        return []
    lines = lines_of(body)
    return [i for node in tree(lines, limits) if node.kind != "new" for i in range(node.start, node.end) if not _blank(lines[i])]


def new_text(body: str | None, limits: Limits = DEFAULT_LIMITS) -> str | None:
    """The new nodes of a body's tree; runs of blank lines between them shrink to one."""
    if body is None:
        return None
    lines = lines_of(body)
    return "\n\n".join("\n".join(lines[n.start : n.end]) for n in tree(lines, limits) if n.kind == "new")


def not_new(mails: DataFrame, id_: str, body: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(id, line_no): the lines of each body that are quoted, forwarded, signature, notice or footer.

    Null, empty and blank bodies have none. Lines count from 0 and are cut at
    line feeds. A repeated row repeats its lines; further columns are ignored.
    One pass without a shuffle.
    """

    @F.pandas_udf("array<int>")
    def find(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in bodies:
            yield pd.Series([old_lines(x, limits) for x in b])

    rows = mails.where(F.col(id_).isNotNull() & F.col(body).isNotNull())
    return rows.select(F.col(id_), F.explode(find(F.col(body))).alias("line_no"))


def with_new_text(mails: DataFrame, body: str, out: str = "new_text", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Adds `out`: the newly written part of `body`; null for a null body, empty when nothing is new."""

    @F.pandas_udf("string")
    def reduce(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in bodies:
            yield pd.Series([new_text(x, limits) for x in b], dtype=object)

    return mails.withColumn(out, reduce(F.col(body)))
