"""Personal details in free text (problem 2): detection.

Rules per type, tried in the order e-mail, identity number, phone, address, person; what
one rule took is hidden from the next. Names come from a directory of people: its given
and family names are combined freely, so people who are not listed are found as long as
their names are made of known parts; after words that announce a person any capitalised
full name counts. One Aho-Corasick pass over the folded text finds the name parts, from
which full names are put together, and tells whether the rules of addresses can match.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

TYPES = ("email", "id_number", "phone", "address", "person")

_EMAIL = re.compile(
    r"(?<![\w.+%-])[\w][\w.+%-]*(?:@|\s?[\[(]\s?at\s?[\])]\s?)[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[\w-]+)*(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[^\W\d_]{2,}(?![\w@-])",
    re.I,
)
_ID_DIGITS = re.compile(r"(?<![\w.,/+-])(?:\d{11}|\d{6} \d{5})(?![\w/-]|[.,]\d)")
_ID_OTHER = re.compile(
    r"(?<![\w-])(?:\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2}\d{7}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{3} ?\d{6})(?![\w-])"
)
_EXT = r"(?:\s?(?:ext|x|wewn|Durchwahl|poste)\.?\s?\d{1,5})?"
_PHONE = re.compile(
    r"(?<![\w./+-])(?:"
    r"(?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(\d{1,4}\))?(?:[ .\-/]?\d{1,5}){2,6}"
    r"|\(0?\d{2,4}\)[ ]?\d{3,4}[ .-]?\d{3,4}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r"|0\d{2,4}/\d{5,9}"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{2,4} \d{3,4} \d{3,4}"
    r"|\d{3} \d{3} \d{3}"
    r")" + _EXT + r"(?![\w/]|-\d|\.\d)",
    re.I,
)
_PHONE_BARE = re.compile(r"(?<![\w./+-])1?[2-9]\d{2}[2-9]\d{6}(?![\w/-]|\.\d)")
_PHONE_CUE = re.compile(
    r"\b(?:phone|tel|call|dial|ring|reach|mobile|cell|fax|extension|hotline|contact number|numer(?:em)? (?:kontaktowy|telefonu|tel)|kontaktowy|dzwoń|zadzwoń|telefonicznie|komórka"
    r"|erreichbar|rückruf|rufnummer|rufen|anrufen|handy|durchwahl|joignable|joindre|appel|appelez|portable|numéro)\w*\W[^.\n]{0,25}$|\b(?:tele[fp]|télép)\w*\W[^.\n]{0,25}$",
    re.I,
)

_UP = "[A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻČŠŽŘĚŐŰ]"
_CAP = rf"{_UP}[\w'’-]*"
_TOWN = rf"(?:,?\s(?:\d{{2}}-\d{{3}}|\d{{4,5}})\s{_CAP}(?:\s{_CAP})?|,?\s{_CAP}(?:\s{_CAP})?)?"
_NUMBER = r"\d{1,4}[a-zA-Z]?(?:/\d{1,4})?"
_EN_KIND = r"Street|Road|Lane|Avenue|Close|Hill|Way|Drive|Court|Square|Terrace|Crescent|Row|Gardens|Place|Walk|Mews|Boulevard|Rd|Ave"
_FLAT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|m|lok|Wohnung|Appt)\.?\s\d{1,4}[a-zA-Z]?,?\s)?"
_ADDRESS = re.compile(
    r"(?<![\w/-])(?:"
    rf"{_FLAT}{_NUMBER}\s(?:{_CAP}\s){{1,3}}(?:{_EN_KIND})\b{_TOWN}"
    rf"|{_FLAT}{_NUMBER},?\s(?:rue|avenue|chemin|boulevard|impasse|allée|place|quai|route|cours)\s(?:(?:de|du|des|la|le|les|aux?)\s|[dl]['’])*{_CAP}(?:[\s-](?:{_CAP}|de|du|des|la)){{0,3}}{_TOWN}"
    rf"|(?:[Uu]l\.|[Uu]lica|[Aa]l\.|[Aa]leja|[Oo]s\.|[Pp]l\.|[Pp]lac)\s{_CAP}(?:\s{_CAP}){{0,2}}\s{_NUMBER}(?:\sm\.\s?\d+)?{_TOWN}"
    rf"|(?:{_UP}\w*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|markt)|(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Hintere[rs]?|Vordere[rs]?|Alte[rs]?|Neue[rs]?|Untere[rs]?|Obere[rs]?|Große[rs]?|Kleine[rs]?)\s{_CAP})\s{_NUMBER}{_TOWN}"
    r")"
)
#: What makes a bare run of digits a number to call: brackets after a name, or a mail address just before.
_AFTER_NAME = re.compile(r"([^\W\d_][\w'’-]*),?\s?\($")
_COUNTED = frozenset("job byte bytes bajt row rows wiersz zeile ligne offset port build page run id line item ticket sequence record version serial".split())
_AFTER_MAIL = re.compile(r"\0[>)\]]?[,;:]?\s?\(?$")
_ADDRESS_WORDS = (
    "street road lane avenue close hill way drive court square terrace crescent row gardens place walk mews boulevard rue chemin impasse allée quai route cours "
    "ul. ulica al. aleja os. pl. plac straße strasse str. gasse weg platz allee ring damm ufer steig markt"
).split()
_ANNOUNCED = re.compile(
    r"(?:Assigned to|Author:|Signed-off-by:|Co-authored-by:|Reviewed with|Reviewed-by:|[Ll]oop in|Escalate to|Contact person:|Przypisane do:|Zgłasza|Zuständig ist|Affecté à)"
    rf"\s+({_CAP}(?:\s{_UP}\.)?\s{_CAP})(?=[\s,.;<(]|$)"
)


def fold(text: str) -> str:
    """Lower case without marks, one character for each of ``text``."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    if low.isascii():
        return low
    out = []
    for c in low:
        if c < "\x80":
            out.append(c)
        else:
            out.append(_FOLDS.get(c) or _fold_one(c))
    return "".join(out)


# fixed values: letters whose plain form is no decomposition
_FOLDS = dict(zip("łøđæœßðþı", ["l", "o", "d", "a", "o", "s", "d", "t", "i"], strict=True))


def _fold_one(c: str) -> str:
    d = unicodedata.normalize("NFD", c)
    _FOLDS[c] = d[0]
    return d[0]


def spellings(name: str) -> set[str]:
    """Folded forms of a name: letter for letter, and with digraphs for special letters."""
    # fixed values: digraphs that stand for letters with marks
    wide = str.maketrans({"æ": "ae", "ø": "oe", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "å": "aa", "œ": "oe", "þ": "th"})
    return {fold(name), fold(name.lower().translate(wide))}


def valid_pesel(digits: str) -> bool:
    """Checksum and date part of an 11-digit national number."""
    # fixed values: weights of the check digit
    weights = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
    month, day = int(digits[2:4]) % 20, int(digits[4:6])
    if not (1 <= month <= 12 and 1 <= day <= 31):
        return False
    return (10 - sum(w * int(d) for w, d in zip(weights, digits, strict=False)) % 10) % 10 == int(digits[10])


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    text: str


_MIDDLE, _GAP, _COMMA, _INITIAL = re.compile(r"\s+\w\.\s+"), re.compile(r"\s+"), re.compile(r",\s+"), re.compile(r"\s+\w\.")


def people(folded: str, given: dict[int, list[int]], family: dict[int, list[int]]) -> Iterator[tuple[int, int]]:
    """Spans of full names in a folded text, left to right, from the name parts found in it.

    ``given`` and ``family`` map where a part starts to where it may end, longest first.
    Forms: given (middle initial) family; family, given (initial); initial family. Both parts
    may be double-barrelled.
    """

    def parts(table: dict[int, list[int]], at: int) -> Iterator[int]:
        for e in table.get(at, ()):
            if folded[e : e + 1] == "-":
                yield from table.get(e + 1, ())
            yield e

    def free(at: int) -> bool:
        c = folded[at : at + 1]
        return not c or not (c.isalnum() or c in "_@-")

    def whole(at: int) -> int | None:
        for e in parts(given, at):
            for rx in (_MIDDLE, _GAP):
                if m := rx.match(folded, e):
                    for end in parts(family, m.end()):
                        if free(end):
                            return end
        for e in family.get(at, ()):
            if m := _COMMA.match(folded, e):
                for end in parts(given, m.end()):
                    # an initial belongs here unless a family name follows it, which is then another person
                    if (i := _INITIAL.match(folded, end)) and not ((g := _GAP.match(folded, i.end())) and g.end() in family) and free(i.end()):
                        return i.end()
                    if free(end):
                        return end
        if folded[at + 1 : at + 2] == ".":
            for end in parts(family, at + 3 if folded[at + 2 : at + 3].isspace() else at + 2):
                if free(end):
                    return end
        return None

    initials = {f - k for f in family for k in (2, 3) if f >= k and folded[f - k].isalnum()}
    done = 0
    for at in sorted({*given, *family, *initials}):
        if at >= done and (at == 0 or free(at - 1)) and (end := whole(at)):
            yield at, end
            done = end


@dataclass
class Detector:
    """Finds mentions; ``given`` and ``family`` are names of the directory (see ``MAX_DIRECTORY``)."""

    given: list[str]
    family: list[str]
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"given": self.given, "family": self.family, "_ready": {}}

    def _setup(self) -> dict:
        if not self._ready:
            import ahocorasick

            words: dict[str, set[str]] = {}
            for kind, names in (("address", _ADDRESS_WORDS), ("given", self.given), ("family", self.family)):
                for w in names:
                    for v in {fold(w)} if kind == "address" else spellings(w) if w and len(w) > 1 else ():
                        words.setdefault(v, set()).add(kind)
            auto = ahocorasick.Automaton()
            for v, kinds in words.items():
                auto.add_word(v, (len(v), tuple(kinds)))
            auto.make_automaton()
            self._ready.update(auto=auto)
        return self._ready

    def name_kinds(self, word: str) -> tuple[str, ...]:
        """Whether a folded word is a given or a family name of the directory."""
        hit = self._setup()["auto"].get(word, (0, ()))
        return tuple(k for k in ("given", "family") if k in hit[1])

    def find(self, text: str | None) -> list[Mention]:
        """Mentions in order of their start; NULL and empty texts have none."""
        if not text:
            return []
        ready, out = self._setup(), []
        masked = text

        def take(kind: str, spans) -> None:
            nonlocal masked
            spans = list(spans)
            for a, b in spans:
                out.append(Mention(a, b, kind, text[a:b]))
            if spans:
                cells, at = [], 0
                for a, b in spans:
                    cells += [masked[at:a], "\0" * (b - a)]
                    at = b
                masked = "".join([*cells, masked[at:]])

        low = text.lower()
        if "@" in text or "(at" in low or "[at" in low or "( at" in low or "[ at" in low:
            take("email", (m.span() for m in _EMAIL.finditer(masked)))
        digits = sum(c.isdigit() for c in text) if len(text) < 200 else 99
        if digits >= 6:
            ids = [m.span() for m in _ID_OTHER.finditer(masked)]
            ids += [m.span() for m in _ID_DIGITS.finditer(masked) if valid_pesel(m[0].replace(" ", ""))]
            take("id_number", sorted(ids))
            spans = []
            for m in _PHONE.finditer(masked):
                n = sum(c.isdigit() for c in re.sub(r"(?i)(?:ext|x|wewn|durchwahl|poste).*", "", m[0]))
                if 9 <= n <= 15 and (not re.fullmatch(r"\d{3} \d{3} \d{3}", m[0]) or _PHONE_CUE.search(masked[max(0, m.start() - 40) : m.start()])):
                    spans.append(m.span())
            take("phone", spans)
            take(
                "phone",
                (m.span() for m in _PHONE_BARE.finditer(masked) if self.is_called(masked[max(0, m.start() - 40) : m.start()], masked[m.end() : m.end() + 1])),
            )
        folded = fold(masked)
        found: dict[str, dict[int, list[int]]] = {"address": {}, "given": {}, "family": {}}
        for last, (n, kinds) in ready["auto"].iter(folded):
            for k in kinds:
                found[k].setdefault(last - n + 1, []).insert(0, last + 1)
        if digits and (found["address"] or re.search(r"\b(?:A[mnu]|Im|In|Z[u][mr]|[HVANUOGK]\w+e[rs]?)\b.{1,30}\d", masked)):
            taken = [m.span() for m in _ADDRESS.finditer(masked)]
            take("address", taken)
            if taken and found["family"]:
                hidden = lambda a, b: any(x < b and a < y for x, y in taken)
                for k in ("given", "family"):
                    found[k] = {a: keep for a, ends in found[k].items() if (keep := [b for b in ends if not hidden(a, b)])}
                folded = fold(masked)
        if found["family"]:
            take("person", people(folded, found["given"], found["family"]))
        take("person", (m.span(1) for m in _ANNOUNCED.finditer(masked) if "\0" not in m[1]))
        return sorted(out, key=lambda m: m.start)

    def is_called(self, before: str, after: str) -> bool:
        """Whether the text around a bare run of digits says that it is a number to call.

        A cue word before it, a mail address just before it, or brackets after a name (a
        capitalised word or a part of a known name).
        """
        if _PHONE_CUE.search(before) or _AFTER_MAIL.search(before):
            return True
        name = _AFTER_NAME.search(before) if after == ")" else None
        return bool(name) and fold(name[1]) not in _COUNTED and (name[1][0].isupper() or any(self.name_kinds(w) for w in re.findall(r"[^\W\d_]+", fold(name[1]))))
