"""Keyed surrogates for personal details (problem 2): replacement.

Every entity gets a replacement made from a keyed hash of its normal form, so the same
entity has the same replacement everywhere, whatever its spelling. Replacements keep type,
order of name parts, gender, script, case, separators and length.

* numbers: letters and digits go through a keyed permutation of all strings of that shape,
  walked on until the result is valid (check digit, date, area), so two numbers can never
  share a replacement and valid ones stay valid;
* names, mail addresses and streets are drawn from large spaces, and a distributed check
  finds entities that meet; all but one of them are drawn again until none meet. Drawn
  words are written in Latin letters and put into the script of the original by a map that
  gives every letter its own sign, so what differs when drawn differs when written;
* a mail address that holds the names of its owner gets the names of the owner's surrogate.

Texts are searched once: the mentions found are written, and everything after reads those.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.llm.genders import gender_of
from corvidex.llm.pii import Detector, Mention, fold, spellings, valid_pesel

_ONSETS = "b c d f g h j k l m n p r s t v w z br dr".split()
_VOWELS = "a e i o".split()
# fixed values: words of an address that are not a name
_PLAIN_WORDS = frozenset(
    (
        "street road lane avenue close hill way drive court square terrace crescent row gardens place walk mews boulevard rd ave flat apt apartment unit suite "
        "lok wohnung appt rue chemin impasse allee quai route cours de du des la le les au aux d l ul ulica al aleja os pl plac m am an der den auf dem im in "
        "zum zur"
    ).split()
)
_STREET_ENDS = re.compile(r"(straße|strasse|str|gasse|weg|platz|allee|ring|damm|ufer|steig|markt)$", re.I)
_LATIN = "abcdefghijklmnopqrstuvwxyz"
# fixed values: one sign of the script for each Latin letter, none twice
SCRIPTS = {"cyrillic": dict(zip(_LATIN, "абцдефгхийклмнопќрстувўњыз", strict=True)), "greek": dict(zip(_LATIN, "αβψδεφγηιϳκλμνοπϙρστυϝωξϋζ", strict=True))}
_SCRIPT_OF = (("cyrillic", re.compile("[Ѐ-ӿ]")), ("greek", re.compile("[Ͱ-Ͽἀ-῿]")))
#: Endings of drawn names; no two kinds share one, so a given name never meets another word.
ENDINGS = {"f": "a", "m": "n", "?": "y", "family": "er", "word": "u"}


def _hash(key: bytes, *parts: object) -> int:
    text = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=16).digest(), "big")


def _syllables(h: int, n: int) -> str:
    out = []
    for _ in range(n):
        h, a = divmod(h, len(_ONSETS))
        h, b = divmod(h, len(_VOWELS))
        out.append(_ONSETS[a] + _VOWELS[b])
    return "".join(out)


def permute(key: bytes, text: str, tweak: str = "", valid: Callable[[str], bool] | None = None) -> str:
    """A keyed permutation of all strings of capitals and digits of one shape.

    The string is a number in mixed base; a Feistel network over the next even number of
    bits is applied until the result is such a number again and, where ``text`` is valid,
    until it is ``valid`` (the walk ends: the permutation returns to ``text`` at last).
    """
    bases = [26 if c.isalpha() else 10 for c in text]
    size, number = 1, 0
    for c, base in zip(text, bases, strict=True):
        number, size = number * base + (ord(c) - 65 if base == 26 else int(c)), size * base
    if size < 2:
        return text
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    shape = "".join("A" if b == 26 else "0" for b in bases)
    wanted = valid if valid and valid(text) else None
    while True:
        left, right = number >> half, number & mask
        for r in range(6):
            left, right = right, left ^ (_hash(key, "f", tweak, shape, r, right) & mask)
        number = left << half | right
        if number < size:
            out, rest = [], number
            for base in reversed(bases):
                rest, d = divmod(rest, base)
                out.append(chr(65 + d) if base == 26 else str(d))
            made = "".join(reversed(out))
            if wanted is None or wanted(made):
                return made


def permute_digits(key: bytes, digits: str, tweak: str = "") -> str:
    return permute(key, digits, tweak) if digits else ""


def valid_number(original: str) -> Callable[[str], bool] | None:
    """What a replacement of a national number must satisfy beyond its shape."""
    if re.fullmatch(r"\d{11}", original):
        return lambda t: valid_pesel(t) and int(t[9]) % 2 == int(original[9]) % 2  # the tenth digit tells the sex
    if re.fullmatch(r"\d{9}", original):
        return lambda t: t[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000"
    return None


def script_of(word: str) -> str | None:
    return next((name for name, rx in _SCRIPT_OF if rx.search(word)), None)


def _like(shape: str, word: str) -> str:
    """``word`` in the case and script of ``shape``."""
    signs = SCRIPTS.get(script_of(shape) or "")
    if signs:
        word = "".join(signs.get(c, c) for c in word)
    letters = [c for c in shape if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word if letters and letters[0].islower() else word[:1].upper() + word[1:]


@functools.lru_cache(maxsize=200_000)
def _part(key: bytes, kind: str, name: str, attempt: int) -> str:
    """Surrogate of one folded name part; initials of a name keep belonging to it."""
    first = _initial(key, name[0])
    body = _syllables(_hash(key, kind, name, attempt), 3 + attempt)
    if kind == "given":
        end = ENDINGS[gender_of(name)]
        body = body[:-1] + end if end in "ay" else body + end
    else:
        polish = re.search(r"(?:sk|ck|dzk)([aiy])$", name)
        body += f"sk{polish[1]}" if polish else "ova" if name.endswith("ova") else ENDINGS["family"]
    return first + (body if first in "aeiouy" else "aeio"[_hash(key, kind, name, "v") % 4] + body)


@functools.lru_cache(maxsize=4096)
def _order(key: bytes) -> str:
    return "".join(sorted(_LATIN, key=lambda c: _hash(key, "initial", c)))


def _initial(key: bytes, letter: str) -> str:
    """The letter that stands for ``letter`` at the start of names, in Latin."""
    at = _LATIN.find(letter)
    if at < 0:
        back = {c: k for signs in SCRIPTS.values() for k, c in signs.items()}
        at = _LATIN.index(back.get(letter) or _LATIN[_hash(key, "sign", letter) % 26])
    return _order(key)[at]


def _national(digits: str) -> tuple[str, str]:
    """Country and trunk prefix, and the significant number."""
    # fixed values: country codes whose national forms are known, with their trunk prefix
    for code in ("49", "33", "44", "48"):
        for prefix in ("00" + code, code if len(digits) >= 11 else ""):
            if prefix and digits.startswith(prefix) and not digits.startswith("0" + code):
                return prefix, digits[len(prefix) :]
    if len(digits) == 11 and digits[0] == "1":
        return "1", digits[1:]
    if digits.startswith("0") and not digits.startswith("00"):
        return "0", digits[1:]
    return "", digits


_AT = re.compile(r"@|\s*[\[(]\s*at\s*[\])]\s*", re.I)
_DOT = re.compile(r"\.|\s*[\[(]\s*dot\s*[\])]\s*", re.I)


def _mail_parts(text: str, detector: Detector | None) -> tuple[str, str, str, list[tuple[str, str]]]:
    """Local part, sign, domain of an address, and what each word of the local part is."""
    sign = _AT.search(text)
    local, at, domain = (text[: sign.start()], sign[0], text[sign.end() :]) if sign else (text, "", "")
    words = []
    for w in re.findall(r"[^\W\d_]+|\d+", local):
        kinds = detector.name_kinds(fold(w)) if detector and w.isalpha() else ()
        words.append((kinds[0] if kinds else "digits" if w.isdigit() else "word", fold(w)))
    return local, at, domain, words


def entities_of(m: Mention, detector: Detector | None = None) -> list[tuple[str, str]]:
    """Normal forms (kind, key) of what a mention names; numbers are permuted, not drawn.

    The words of a mail address that are no names are one entity: the names around them are
    part of its key, as two addresses meet only if all of their words do.
    """
    if m.kind == "email":
        local, _, domain, words = _mail_parts(m.text, detector)
        out = [("domain", _DOT.sub(".", domain).lower())]
        own = [(k, w) for k, w in words if k in ("given", "family")]
        return [*own, ("mailbox", mail_key(local, words)), *out]
    if m.kind == "address":
        return [("place", fold(w)) for w in _place_words(m.text)]
    if m.kind == "person":
        given, family = _name_parts(m.text)
        return [("given", g) for g in given if len(g) > 1] + [("family", f) for f in family]
    return []


def mail_key(local: str, words: list[tuple[str, str]]) -> str:
    """A local part with its names marked, in lower case."""
    it = iter(words)
    return re.sub(r"[^\W\d_]+|\d+", lambda _: (lambda k, w: f"<{k}:{w}>" if k in ("given", "family") else w)(*next(it)), local.lower())


def _stem(word: str) -> str:
    """The name in a word of an address: without a street ending, '' for plain words."""
    stem = _STREET_ENDS.sub("", word) if len(word) > 6 else word
    return "" if fold(word) in _PLAIN_WORDS or not stem else stem


def _place_words(text: str) -> list[str]:
    return [s for w in re.findall(r"[^\W\d_]+", text) if len(w) > 1 and (s := _stem(w))]


def _name_parts(text: str) -> tuple[list[str], list[str]]:
    t = fold(text)
    if "," in t:
        fam, _, giv = t.partition(",")
    else:
        giv, _, fam = t.strip().rpartition(" ") if " " in t.strip() else t.rpartition(".")
    words = lambda x: re.findall(r"[^\W\d_]+", x)
    return words(giv), words(fam)


def surrogate(key: bytes, m: Mention, attempts: dict[tuple[str, str], int] | None = None, detector: Detector | None = None) -> str:
    """Replacement text of a mention."""
    tries = attempts or {}
    if m.kind == "email":
        return _mail(key, m.text, tries, detector)
    if m.kind == "phone":
        body, ext = m.text, ""
        if x := re.search(r"\s?(?:ext|x|wewn|durchwahl|poste)\.?\s?\d+$", body, re.I):
            body, ext = body[: x.start()], re.sub(r"\d+", lambda d: permute_digits(key, d[0], "ext"), x[0])
        prefix, number = _national(re.sub(r"\D", "", body))
        new = iter(prefix + permute_digits(key, number, "phone"))
        return re.sub(r"\d", lambda _: next(new), body) + ext
    if m.kind == "id_number":
        plain = re.sub(r"[^A-Z0-9]", "", m.text)
        new = iter(permute(key, plain, "id_number", valid_number(plain)))
        return re.sub(r"[A-Z0-9]", lambda _: next(new), m.text)
    if m.kind == "address":

        def other(w: re.Match) -> str:
            if w[0].isdigit():
                return permute_digits(key, w[0], "address")
            stem = _stem(w[0]) if len(w[0]) > 1 else ""
            if not stem:
                return w[0]
            drawn = draw(key, "place", fold(stem), tries.get(("place", fold(stem)), 0))
            return _like(stem, drawn) + w[0][len(stem) :]

        return re.sub(r"\d+|[^\W\d_]+", other, m.text)
    given, family = _name_parts(m.text)
    swap: list[str] = []
    for word in re.findall(r"[^\W\d_]+", m.text):
        w = fold(word)
        if len(w) == 1:
            swap.append(_like(word, _initial(key, w)).upper())
        else:
            kind = "family" if w in family and w not in given else "given"
            swap.append(_like(word, _part(key, kind, w, tries.get((kind, w), 0))))
    it = iter(swap)
    return re.sub(r"[^\W\d_]+", lambda _: next(it), m.text)


def _mail(key: bytes, text: str, tries: dict, detector: Detector | None) -> str:
    local, at, domain, words = _mail_parts(text, detector)
    box = mail_key(local, words)
    drawn = iter(draw(key, "mailbox", box, tries.get(("mailbox", box), 0)).split("|"))
    it = iter(words)

    def other(w: re.Match) -> str:
        kind, name = next(it)
        if kind in ("given", "family"):
            made = _part(key, kind, name, tries.get((kind, name), 0))
        else:
            made = next(drawn)
        return made.upper() if w[0].isupper() else made

    new = re.sub(r"[^\W\d_]+|\d+", other, local)
    d = _DOT.sub(".", domain).lower()
    host = draw(key, "domain", d, tries.get(("domain", d), 0))
    dot = _DOT.search(domain)
    out = f"{host}{dot[0] if dot else '.'}invalid"
    return f"{new}{at}{out.upper() if domain.isupper() else out}"


def draw(key: bytes, kind: str, name: str, attempt: int) -> str:
    """What an entity is replaced by, in the form in which two replacements must differ."""
    if kind in ("given", "family"):
        return _part(key, kind, name, attempt)
    if kind == "mailbox":
        words = re.findall(r"<\w+:[^>]*>|[^\W\d_]+|\d+", name)
        loose = [w for w in words if w[0] != "<"]
        return "|".join(_loose(key, w, name, i, attempt) for i, w in enumerate(loose))
    return _syllables(_hash(key, kind, name, attempt), 4 + attempt)


def _loose(key: bytes, word: str, box: str, place: int, attempt: int) -> str:
    """Surrogate of a word of a mail address that is no name: digits stay digits."""
    if word.isdigit():
        return permute(key, word, f"mail|{attempt}")
    return _syllables(_hash(key, "mailbox", box, place, attempt), 3 + attempt)[:-1] + ENDINGS["word"]


def meeting_form(key: bytes, kind: str, name: str, attempt: int, draw_with=draw) -> str:
    """Two entities of a kind meet if these are equal: for mail addresses with the names and signs around the drawn words."""
    drawn = draw_with(key, kind, name, attempt)
    return re.sub(r"(?<![<:\w])[^\W\d_]+(?![\w:>])|(?<![<:\w])\d+(?![\w:>])", "*", name) + "\x1f" + drawn if kind == "mailbox" else drawn


def render(key: bytes, text: str, mentions: list[Mention], attempts=None, typed: bool = True, detector: Detector | None = None) -> str:
    """``text`` with each mention replaced, typed as ``<PERSON:...>`` if ``typed``."""
    return splice(text, [(m.start, m.end, m.kind, surrogate(key, m, attempts, detector)) for m in mentions], typed)


def splice(text: str, spans: list[tuple[int, int, str, str]], typed: bool = True) -> str:
    out, at = [], 0
    for start, end, kind, made in spans:
        out += [text[at:start], f"<{kind.upper()}:{made}>" if typed else made]
        at = end
    return "".join([*out, text[at:]])


def text_rows(df: DataFrame, table: str, id_column: str, fields: tuple[str, ...]) -> DataFrame:
    """Long rows ``tbl, row_id, field_name, text``."""
    items = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    return df.select(F.lit(table).alias("tbl"), F.col(id_column).cast("long").alias("row_id"), F.inline(items))


ROW = ["tbl", "row_id", "field_name", "stamp"]
_ROW_SCHEMA = "tbl string, row_id long, field_name string, stamp long"
_SPANS = "array<struct<start:int,end:int,kind:string,item_no:int,text:string>>"
_ENTITIES = "array<struct<kind:string,name:string>>"


#: Entities drawn again up to which all tasks get the whole list; more of them meet their texts in a join.
MOST_REDRAWN = 50_000


def _stamped(texts: DataFrame) -> DataFrame:
    """``stamp`` tells texts apart that stand under one id."""
    return texts.withColumn("stamp", F.xxhash64("text"))


_NAMES = "array<struct<name:string,kind:string>>"


def with_names(texts: DataFrame, people: DataFrame) -> DataFrame:
    """Adds ``names``: the names of ``people`` (``given_name, family_name``) that may occur in each text.

    For directories that are too large to be carried to every task: texts and spellings of
    names meet on the first word of a spelling, so each text gets the few names it needs.
    """

    def spelled(frames):
        for f in frames:
            out = [(name, kind, m[0]) for name, kind in zip(f["name"], f["kind"], strict=True) for v in spellings(name) if (m := _WORD.search(v))]
            yield pd.DataFrame(out, columns=["name", "kind", "head"])

    def words(frames):
        for f in frames:
            out = [(*row, w) for *row, text in zip(*(f[c] for c in (*ROW, "text")), strict=True) for w in set(_WORD.findall(fold(text)))]
            yield pd.DataFrame(out, columns=[*ROW, "head"])

    one = lambda c, kind: people.where(F.length(c) > 1).select(F.col(c).alias("name"), F.lit(kind).alias("kind"))
    names = one("given_name", "given").unionByName(one("family_name", "family")).distinct().mapInPandas(spelled, "name string, kind string, head string").distinct()
    rows = _stamped(texts)
    heads = rows.where("length(text) > 0").select(*ROW, "text").mapInPandas(words, f"{_ROW_SCHEMA}, head string")
    found = heads.join(names, "head").groupBy(*ROW).agg(F.collect_set(F.struct("name", "kind")).alias("names"))
    return rows.join(found, ROW, "left").drop("stamp")


_WORD = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=10_000)
def _detector_of(names: tuple[tuple[str, str], ...]) -> Detector:
    return Detector([n for n, k in names if k == "given"], [n for n, k in names if k == "family"])


def _row_detector(names) -> Detector:
    return _detector_of(tuple(sorted((x["name"], x["kind"]) for x in names)) if names is not None else ())


def detect(texts: DataFrame, detector: Detector | None) -> DataFrame:
    """``tbl, row_id, field_name, stamp, spans, entities, names`` of the texts that mention anything.

    The one pass over the texts. Without a ``detector`` each text brings its own ``names`` (see
    ``with_names``). ``item_no`` of a span counts the mentions of a type in a field from its
    start. NULL and empty texts have none; whole texts are read, of any length; repeated rows
    each come out.
    """

    def run(frames):
        for f in frames:
            out = []
            for *row, text, names in zip(*(f[c] for c in (*ROW, "text", "names")), strict=True):
                own = detector or _row_detector(names)
                if found := own.find(text):
                    n: dict[str, int] = {}
                    spans = []
                    for m in found:
                        n[m.kind] = n.get(m.kind, 0) + 1
                        spans.append({"start": m.start, "end": m.end, "kind": m.kind, "item_no": n[m.kind], "text": m.text})
                    named = dict.fromkeys(e for m in found for e in entities_of(m, own))
                    out.append((*row, spans, [{"kind": k, "name": x} for k, x in named], names))
            yield pd.DataFrame(out, columns=[*ROW, "spans", "entities", "names"])

    rows = _stamped(texts.where("length(text) > 0"))
    rows = rows.select(*ROW, "text", F.lit(None).cast(_NAMES).alias("names") if detector else "names")
    return rows.mapInPandas(run, f"{_ROW_SCHEMA}, spans {_SPANS}, entities {_ENTITIES}, names {_NAMES}")


def redraw_until_distinct(entities: DataFrame, key: bytes, draw_with=draw) -> DataFrame:
    """``kind, name, attempt`` of the entities that must be drawn again (attempt > 0).

    ``entities``: ``kind, name``. Every attempt draws from a larger space, so the rounds end.
    """
    from corvidex.session import cut_lineage, forget

    def drawn(df: DataFrame) -> DataFrame:
        def run(frames):
            for f in frames:
                f["drawn"] = [meeting_form(key, k, n, a, draw_with) for k, n, a in zip(f["kind"], f["name"], f["attempt"], strict=True)]
                yield f

        return df.mapInPandas(run, "kind string, name string, attempt int, drawn string")

    now = cut_lineage(drawn(entities.select("kind", "name", F.lit(0).alias("attempt")).distinct()))
    while True:
        met = now.groupBy("kind", "drawn").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("keeps")).where("n > 1")
        again = now.join(met, ["kind", "drawn"]).where("name <> keeps").select("kind", "name", "attempt")
        if not again.limit(1).count():
            return now.where("attempt > 0").select("kind", "name", "attempt")
        redrawn = drawn(again.withColumn("attempt", F.col("attempt") + 1))
        kept = now.join(again.select("kind", "name"), ["kind", "name"], "left_anti")
        old, now = now, cut_lineage(kept.unionByName(redrawn))
        forget(old)


def replacements(texts: DataFrame, detector: Detector | None, key: bytes, draw_with=draw) -> DataFrame:
    """``tbl, row_id, field_name, stamp, spans`` with a ``surrogate`` in each span.

    One detection pass; only mentions and entities move. Entities that meet are drawn again
    over all data, so distinct entities have distinct surrogates everywhere.
    """
    from corvidex.session import cut_lineage

    found = cut_lineage(detect(texts, detector))
    entities = found.select(F.explode("entities").alias("e")).select("e.*")
    again = redraw_until_distinct(entities, key, draw_with)
    few = again.limit(MOST_REDRAWN + 1).collect()
    everywhere = {(r.kind, r.name): r.attempt for r in few}
    no_marks = F.lit(None).cast("array<struct<kind:string,name:string,attempt:int>>")
    if len(few) <= MOST_REDRAWN:  # they travel with the function; nothing is moved
        found = found.withColumn("marks", no_marks)
    else:
        everywhere = {}
        named = found.select(*ROW, F.explode("entities").alias("e")).select(*ROW, "e.*").distinct()
        marks = named.join(again, ["kind", "name"]).groupBy(*ROW).agg(F.collect_list(F.struct("kind", "name", "attempt")).alias("marks"))
        found = found.join(marks, ROW, "left")

    def run(frames):
        for f in frames:
            made = []
            for spans, marks, names in zip(f["spans"], f["marks"], f["names"], strict=True):
                own = detector or _row_detector(names)
                tries = {(m["kind"], m["name"]): m["attempt"] for m in marks} if marks is not None else everywhere
                made.append([{"start": s["start"], "end": s["end"], "kind": s["kind"], "item_no": s["item_no"], "surrogate": surrogate(key, Mention(s["start"], s["end"], s["kind"], s["text"]), tries, own)} for s in spans])
            f["spans"] = made
            yield f[[*ROW, "spans"]]

    return found.select(*ROW, "spans", "marks", "names").mapInPandas(run, f"{_ROW_SCHEMA}, spans array<struct<start:int,end:int,kind:string,item_no:int,surrogate:string>>")


def find_mentions(texts: DataFrame, detector: Detector | None, key: bytes) -> DataFrame:
    """One row per mention with its surrogate: ``tbl, row_id, field_name, pii_type, item_no, surrogate``."""
    rows = replacements(texts, detector, key).select("tbl", "row_id", "field_name", F.explode("spans").alias("s"))
    return rows.select("tbl", "row_id", "field_name", F.col("s.kind").alias("pii_type"), "s.item_no", "s.surrogate")


def redact(texts: DataFrame, detector: Detector | None, key: bytes, typed: bool = True, draw_with=draw) -> DataFrame:
    """``tbl, row_id, field_name, text`` with every mention replaced.

    NULL stays NULL, texts without mentions come out as they are. Each text meets its own
    mentions in a join on its id; repeated rows each come out.
    """
    spans = replacements(texts, detector, key, draw_with).dropDuplicates(ROW)
    rows = _stamped(texts).join(spans, ROW, "left")

    def run(frames):
        for f in frames:
            f["text"] = [t if s is None else splice(t, [(x["start"], x["end"], x["kind"], x["surrogate"]) for x in s], typed) for t, s in zip(f["text"], f["spans"], strict=True)]
            yield f[["tbl", "row_id", "field_name", "text"]]

    return rows.select("tbl", "row_id", "field_name", "text", "spans").mapInPandas(run, "tbl string, row_id long, field_name string, text string")
