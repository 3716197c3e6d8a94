"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvidex.llm.emptiness import NO_CONTENT_WORDS, is_empty, is_empty_list
from corvidex.llm.survivors import field_winners, survivors
from corvidex.session import load_table

FIELDS = {"user_text": is_empty, "assistant_text": is_empty, "outcome_summary": is_empty, "mode": is_empty, "tickets_json": is_empty_list}


def _winners(rows: DataFrame) -> DataFrame:
    return field_winners(rows, "logical_turn_key", FIELDS, "source_fidelity_rank", "sequence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _winners(load_table(spark, sf_dir, "journal_observations"))
    return w.select("first_sequence", "field_name", "sequence")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every group."""
    rows = load_table(spark, sf_dir, "journal_observations")
    return survivors(rows, _winners(rows), list(FIELDS), "sequence")


def p5_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners and how many rows had their value."""
    w = _winners(load_table(spark, sf_dir, "journal_observations"))
    return w.select("first_sequence", "field_name", "sequence", "votes")


_WORDS = ", ".join("'" + w + "'" for w in NO_CONTENT_WORDS)


def _empty_sql(c: str) -> str:
    """The emptiness rule in SQL, for the texts of these tables."""
    text = rf"regexp_replace(regexp_replace(regexp_replace({c}, '[\x{{200B}}\x{{FEFF}}\x{{2060}}\x{{00AD}}]', '', 'g'), '(?m)^[ \t]*(```|~~~)[\w-]*[ \t]*$', '', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    word = rf"lower(regexp_replace({text}, '^[\s\[\](){{}}<>*_`\"''|:-]+|[\s\[\](){{}}<>*_`\"''|:.!-]+$', '', 'g'))"
    return rf"({c} IS NULL OR NOT regexp_matches({text}, '[\p{{L}}\p{{N}}\p{{So}}]') OR {word} IN ({_WORDS}) OR regexp_matches({text}, '^#{{1,6}}[^\n]*$'))"


_KEY = r"lower(regexp_replace(replace(logical_turn_key, '\', '/'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
_VALUE = r"lower(trim(regexp_replace(%s, '[\s\p{Z}]+', ' ', 'g'), ' '))"


def _ctes() -> str:
    """``w``: the winning row of every group and field, ``v``: all values in their normal form."""
    parts, values = [], []
    for f in FIELDS:
        empty = _empty_sql(f) + (rf" OR regexp_matches({f}, '^\s*\[[\s,]*((\"\"|null)[\s,]*)*\]\s*$')" if f == "tickets_json" else "")
        parts.append(f"SELECT k, '{f}' AS field_name, arg_min(sequence, (coalesce(source_fidelity_rank, 2147483648), -sequence)) AS sequence FROM j WHERE NOT ({empty}) GROUP BY 1")
        values.append(f"SELECT k, '{f}' AS field_name, sequence, {_VALUE % f} AS v FROM j WHERE NOT ({empty})")
    return f"""WITH j AS (SELECT *, {_KEY} AS k FROM journal_observations WHERE {_KEY} <> ''), g AS (SELECT k, min(sequence) AS first_sequence FROM j GROUP BY 1 HAVING count(*) > 1),
 w AS ({" UNION ALL ".join(parts)}), v AS ({" UNION ALL ".join(values)})"""


_FOUND = f"""{_ctes()}
 SELECT first_sequence, field_name, w.sequence FROM g JOIN w USING (k)"""
_VOTES = f"""{_ctes()}, c AS (SELECT k, field_name, v, count(*) AS votes FROM v GROUP BY ALL)
 SELECT first_sequence, w.field_name, w.sequence, votes FROM g JOIN w USING (k) JOIN v ON v.k = w.k AND v.field_name = w.field_name AND v.sequence = w.sequence
 JOIN c ON c.k = w.k AND c.field_name = w.field_name AND c.v = v.v"""
_RECORDS = f"""{_ctes()}, x AS (SELECT first_sequence, w.field_name, w.sequence FROM g JOIN w USING (k))
 SELECT first_sequence, {", ".join(f"max(CASE WHEN field_name = '{f}' THEN {f} END) AS {f}, max(CASE WHEN field_name = '{f}' THEN x.sequence END) AS {f}_from" for f in FIELDS)}
 FROM x JOIN journal_observations o ON o.sequence = x.sequence GROUP BY 1"""

ORACLE = {"p5_found": _FOUND, "p5_records": _RECORDS, "p5_votes": _VOTES}
QUERIES = {"p5_found": p5_found, "p5_records": p5_records, "p5_votes": p5_votes}
