"""Text expressions of the engine: folding, tokens, tickets, front matter, hashes, snippets.

All of them are column expressions and stay inside the JVM.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: stop words of the relaxed query form, compared without marks
ENGLISH_STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could "
    "did do does doing done down during each few for from further had has have having he her here hers him his how i if in into is it its "
    "just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their "
    "theirs them then there these they this those through to too under until up us very was we were what when where which while who whom why "
    "will with would you your yours tell show find give please anything something"
).split()
POLISH_STOP_WORDS = (
    "a aby albo ale bardzo bez bo by byc byl byla bylo byly co czy czyli dla dlaczego do gdy gdzie i ich ile im ja jak jaka jakie jaki jako je "
    "jego jej jest jestem jestesmy jeszcze jesli juz kiedy ktora ktore ktory ktorzy lub mam mamy mi mnie moj moja moje my na nam nas nasz nasza "
    "nasze nie o od on ona one oni ono po poniewaz przed przez przy sa sie tak takze tam te tego ten to ta tu ty tylko tym u w wam was wiec "
    "wszystko wy z za ze zeby zrobilismy powiedz pokaz znajdz prosze cos czegos ustalilismy zdecydowalismy rozwiazalismy dotyczaca dotyczacy "
    "dotyczace dotyczacej"
).split()
# fixed values: words of a query that ask for nothing in particular
GENERIC_QUERY_WORDS = "summary of status overview state about for the what is on ticket current latest update updates tell me give show".split()
# fixed values: markers of hand-off noise
HANDOFF_MARKERS = (
    "commit handoff", "commit_handoff", "commit-handoff", "commit hook", "commit-hook", "require-commit-handoff", "capture-agent-response",
    "semantic git commit", "git add --",
)
HANDOFF_OWNER = "ai-vault"
# fixed value: ticket keys
TICKET = r"\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b"

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


@functools.cache
def _fold_table() -> tuple[str, str]:
    """Lower-case letters with marks and the letters they become; marks alone vanish."""
    src, dst = [], []
    for cp in range(0xA0, 0x2000):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and unicodedata.category(c)[0] == "L":
            src.append(c)
            dst.append(base)
    marks = [chr(cp) for cp in range(0x300, 0x370)]
    return "".join(src) + "".join(marks), "".join(dst)


def fts_fold(c: Column) -> Column:
    """Lower case without diacritics, as the index folds; letters such as ``ł`` stay."""
    low = F.lower(c)
    # plain ASCII, the common case, needs no look at every letter
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, *_fold_table()))


def ascii_fold(c: Column) -> Column:
    """As ``fts_fold``, and ``ł``, ``đ``, ``ø`` become plain letters too."""
    src, dst = _fold_table()
    return F.translate(F.lower(c), "łđø" + src, "ldo" + dst)


def tokens(c: Column) -> Column:
    """Index tokens in order; NULL has none."""
    return F.filter(F.split(fts_fold(F.coalesce(c, F.lit(""))), TOKEN_BREAK), lambda t: t != "")


def tickets(c: Column) -> Column:
    """Distinct ticket keys of a text in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({TICKET})")))


def ticket_facet(c: Column) -> Column:
    """Path form of a ticket key: lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def front_matter(c: Column) -> Column:
    """The block between the two ``---`` lines at the start, or NULL."""
    block = F.regexp_extract(c, r"^---[ \t]*\n(?s:(.*?))\n---[ \t]*(?:\n|$)", 1)
    return F.when(block != "", block)


def strip_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"^---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|$)", "")


def front_matter_map(c: Column) -> Column:
    """Front matter as a map; quotes around values are dropped, the last of equal keys wins."""
    lines = F.filter(F.split(front_matter(c), "\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    pair = lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("key"),
        F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r'^"|"$', "").alias("value"),
    )
    items = F.transform(lines, pair)
    names = F.array_distinct(F.transform(items, lambda i: i["key"]))
    last = lambda k: F.element_at(F.filter(items, lambda i: i["key"] == k), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def search_body(c: Column) -> Column:
    """What of a document is indexed: its user, assistant and detail parts, else all of it."""
    body = F.trim(F.regexp_replace(strip_front_matter(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", ""))
    part = lambda rx: F.regexp_replace(F.regexp_extract(body, rx, 1), r"^\s+|\s+$", "")
    user = part(r"(?s)## User\s*(.*?)(?:\n## Assistant|\z)")
    assistant = part(r"(?s)## Assistant\s*(.*?)(?:\n## Details|\n## Assistant|\z)")
    details = part(r"(?s)## Details\s*(.*)")
    found = F.filter(F.array(user, assistant, details), lambda x: x != "")
    joined = F.array_join(found, "\n")
    return F.when(joined != "", joined).otherwise(body)


def is_handoff_noise(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    marks = F.lit(False)
    for m in HANDOFF_MARKERS:
        marks = marks | low.contains(m)
    return low.contains(HANDOFF_OWNER) & marks


def normal_for_hash(c: Column) -> Column:
    """Text as the turn hash sees it: no role labels, no dates, lower case, single spaces."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?im)^\s*(?:user|assistant|human|model)\s*:\s*", "")
    t = F.regexp_replace(t, r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?Z?)?", "")
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def turn_hash(user: Column, assistant: Column) -> Column:
    return F.sha2(F.concat_ws("\n", normal_for_hash(user), normal_for_hash(assistant)), 256)


def content_hash(user: Column, assistant: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(user, F.lit("")), F.lit("\n"), F.coalesce(assistant, F.lit(""))), 256)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _marked(c: Column, terms: list[str]) -> Column:
    import re

    for t in terms:
        c = F.regexp_replace(c, f"(?i)({re.escape(t)})", ">>>$1<<<")
    return c


def snippet(content: Column, terms: list[str], size: int = 64) -> Column:
    """Window around the first occurrence of any term (``2*size`` before, ``4*size`` after), terms marked.

    Without terms or occurrences: the start of the text. NULL gives the empty text.
    """
    text = F.coalesce(content, F.lit(""))
    low = F.lower(text)
    places = [F.when(F.instr(low, t.lower()) > 0, F.instr(low, t.lower())) for t in terms]
    first = F.least(*places) if len(places) > 1 else (places[0] if places else F.lit(None).cast("int"))
    start = F.greatest(F.lit(0), first - 1 - 2 * size)
    end = F.least(F.char_length(text), first - 1 + 4 * size)
    window = one_line(F.substring(text, start + 1, end - start))
    window = F.concat(F.when(start > 0, "...").otherwise(""), window, F.when(end < F.char_length(text), "...").otherwise(""))
    head = one_line(F.substring(text, 1, size * 4))
    head = F.concat(head, F.when(F.char_length(text) > F.char_length(head), "...").otherwise(""))
    return F.when(first.isNull(), head).otherwise(_marked(window, terms))


def preview(content: Column, terms: list[str], size: int = 320) -> Column:
    """One line of ``size`` characters around the first term, with ellipses where text is cut."""
    text = one_line(F.coalesce(content, F.lit("")))
    low = F.lower(text)
    places = [F.when(F.instr(low, t.lower()) > 0, F.instr(low, t.lower())) for t in terms]
    first = F.least(*places) if len(places) > 1 else (places[0] if places else F.lit(None).cast("int"))
    start = F.greatest(F.lit(0), F.coalesce(first, F.lit(1)) - 1 - size // 3)
    end = F.least(F.char_length(text), start + size)
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.char_length(text), "…").otherwise(""))


def like(c: Column, pattern: str) -> Column:
    """SQLite's LIKE: without regard to case."""
    return c.ilike(pattern)


def contains_ci(c: Column, needle: str) -> Column:
    """Literal containment without regard to case (wildcards have no meaning)."""
    return F.contains(F.lower(c), F.lit(needle.lower()))
