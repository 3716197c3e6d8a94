"""What counts as no content (problems 4 and 5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that stand for no content, without their brackets
NO_CONTENT = (
    "none null nil nan n/a na empty blank void undefined missing tbd todo"
    "|no response|no output|no answer|no content|no text|no reply|no result|not available"
    "|brak|pusto|puste|brak odpowiedzi|brak treści|brak tresci|nie dotyczy"
    "|leer|keine antwort|keine ausgabe|kein inhalt|entfällt"
    "|vide|aucune réponse|aucune sortie|sans objet|pas de réponse"
)
NO_CONTENT_WORDS = tuple(w for i, part in enumerate(NO_CONTENT.split("|")) for w in (part.split() if i == 0 else [part]))


def is_blank(c: Column) -> Column:
    """NULL, or nothing but white space and invisible characters."""
    return ~F.coalesce(c.rlike(r"[^\s\p{Z}\p{C}]"), F.lit(False))


#: A text that begins like a word and holds this many letters before any fence says something.
_PLAIN_TEXT = r"^[\p{L}\p{N}](?:[^`~\p{L}\p{N}]*[\p{L}\p{N}]){40}"


def is_empty(c: Column) -> Column:
    """NULL, blank, or only a mark or heading that stands for no content.

    Plain texts are told by their first letters; the full rule is for the others.
    """
    return F.when(c.rlike(_PLAIN_TEXT), F.lit(False)).otherwise(_stands_for_nothing(c))


def _stands_for_nothing(c: Column) -> Column:
    text = F.regexp_replace(c, r"[\p{Cf}\p{Cc}&&[^\n\r\t]]", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(```|~~~)[\w-]*[ \t]*$", "")
    text = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    word = F.lower(F.regexp_replace(text, r"^[\s\[\](){}<>*_`\"'|:-]+|[\s\[\](){}<>*_`\"'|:.!-]+$", ""))
    drawn = F.coalesce(text.rlike(r"[\p{L}\p{N}\p{So}]"), F.lit(False))
    heading = text.rlike(r"^#{1,6}[^\n]*$")
    return is_blank(c) | ~drawn | F.coalesce(word.isin(*NO_CONTENT_WORDS) | heading, F.lit(False))


def is_empty_list(c: Column) -> Column:
    """No value in a text that holds a JSON array: empty text, or an array of no real items."""
    return is_empty(c) | F.coalesce(c.rlike(r'^\s*\[[\s,]*((""|null)[\s,]*)*\]\s*$'), F.lit(False))
