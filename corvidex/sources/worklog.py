"""Worklogs: sections between ruled headings, split at natural boundaries when large."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, count, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = "=" * 80
TARGET_BYTES = 12_288
#: In the kinds of lines (rule, text, blank): a line between two rules.
_HEADING = re.compile("(?==[x=]=)")
_BOUNDARY = re.compile(r"(?:\d+\.|F\d+\s+-|FINDING\s+\d+|OPTION\s+[A-Z0-9]+|20\d{2}-\d{2}-\d{2})")
# fixed values: categories of headings, in order of precedence
CATEGORIES = (
    ("related-ticket", "RELATED TICKET"), ("delivery", "DELIVERY|VERDICT"), ("next-action", "NEXT ACTION"), ("blockers", "BLOCKER"),
    ("manual-actions", "MANUAL ACTION"), ("action-log", "ACTION LOG"), ("status", "STATUS|CURRENT STATE"), ("plan", "IMPLEMENTATION PLAN|STAGE PLAN"),
    ("checklist", "CHECKLIST"), ("decisions", "DECISION|RECOMMENDATION"), ("findings", "FINDING|ANALYSIS"), ("solutions", "SOLUTION|OPTION"),
    ("risks", "RISK"), ("actions", "PROPOSED ACTION|ACTIONS"), ("repositories", "REPOSITOR|REFERENCE"), ("comments", "COMMENT"), ("time", "TIME"),
    ("summary", "SUMMARY|TICKET|WORKLOG"),
)


def category(heading: Column) -> Column:
    """Category of a section heading; ``other`` if nothing fits, also for NULL."""
    up = F.upper(F.coalesce(heading, F.lit("")))
    out = F.lit("other")
    for name, rx in reversed(CATEGORIES):
        out = F.when(up.rlike(rx), name).otherwise(out)
    return out


def split_sections(text: str) -> list[tuple[str, int, int, list[str]]]:
    """(heading, first line, last line, body lines) of each section.

    Every line gets the number of headings begun so far; lines of one number are a section.
    Number 0 is what stands before the first heading: a summary, or all there is (evidence).
    """
    lines = text.removesuffix("\n").split("\n")
    kinds = "".join("=" if x == RULE else "x" if x.strip() else "." for x in lines)
    begins = {m.start() for m in _HEADING.finditer(kinds)}
    number = accumulate(i in begins for i in range(len(lines)))
    out = []
    for n, run in groupby(zip(number, count(1), lines, kinds, strict=False), key=itemgetter(0)):
        _, at, own, kind = zip(*run, strict=True)
        if n:
            heading, rest = lines[at[0]].strip(), len("".join(kind[3:]).rstrip("="))
            out.append((heading, at[0], at[-1], list(own[3 : 3 + rest])))
        elif "x" in kind or (not begins and "=" in kind):
            out.append(("TICKET SUMMARY" if begins else "EVIDENCE", at[0], at[-1], [x for x in own if x != RULE]))
    return out


def split_large(section: tuple[str, int, int, list[str]], target: int = TARGET_BYTES) -> list[tuple[str, int, int, list[str]]]:
    """Parts of a section, cut before the first numbered or dated line with which ``target`` bytes are exceeded.

    Works on running sums of bytes: the line that exceeds is found by bisection, the cut is the
    next line that may be cut at.
    """
    heading, first, last, lines = section
    upto = [0, *accumulate(len(x.encode()) + 1 for x in lines)]
    if upto[-1] - 1 <= target:
        return [section]
    may_cut = [i for i, x in enumerate(lines) if _BOUNDARY.match(x)]
    cuts = [0]
    while True:
        full = bisect_right(upto, upto[cuts[-1]] + target + 1) - 1
        k = bisect_left(may_cut, max(full, cuts[-1] + 1))
        if k == len(may_cut):
            break
        cuts.append(may_cut[k])
    ends = [first + c - 1 for c in cuts[1:]] + [last]
    return [(heading, first + a, end, lines[a:b]) for a, b, end in zip(cuts, [*cuts[1:], len(lines)], ends, strict=True)]


def parse_worklogs(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Chunks of worklogs: ``source_path, ticket, source_order, heading, category, start_line,
    end_line, body``. The ticket comes from the file name, else from the first 80 lines."""
    schema = "source_path string, ticket string, source_order int, heading string, start_line int, end_line int, body string"
    ticket = re.compile(r"\b(?:SCTASK\d+|[A-Z][A-Z0-9]{1,9}-\d{1,8})\b")

    def run(frames):
        for f in frames:
            out = []
            for p, t in zip(f["path"], f["text"], strict=True):
                found = ticket.search(p.rsplit("/", 1)[-1]) or ticket.search("\n".join(t.split("\n")[:80]))
                for i, s in enumerate(split_sections(t)):
                    out += [(p, found and found[0], i * 1000 + k, h, a, b, "\n".join(x)) for k, (h, a, b, x) in enumerate(split_large(s))]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    rows = files.where(f"length({text}) > 0").selectExpr(f"{path} as path", f"{text} as text")
    return rows.mapInPandas(run, schema).withColumn("category", category(F.col("heading")))


def latest_time(text: Column) -> Column:
    """Latest date or time on lines that can be trusted to record one (microseconds)."""
    from corvidex.operators.timestamps import _read  # the same cascade as everywhere

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*\d{4}-\d{2}-\d{2}") | x.rlike(r"(?i)\b(UPDATED|CURRENT|STATUS|ACTION|DELIVERY|VERIFIED|COMPLETED|RESOLVED|BLOCKER|EXECUTED|MERGED|DEPLOYED)\b"))
    found = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?)"))
    none = F.lit(None).cast("long")
    times = F.transform(found, lambda x: _read(x, F.lit("Europe/Warsaw"), none))
    end_of_day = lambda r: F.when(r["confidence"] == "date_only", r["us"] + 86_400_000_000 - 1).otherwise(r["us"])
    return F.array_max(F.transform(times, end_of_day))
