import random

import pytest

from corvidex.llm.defects import PairJudge, is_copy, is_open, is_refusal, is_truncated, pair_defects
from corvidex.llm.language import EndingModel, LanguageModel, clean_prose, fit_ending_model, fit_language_model, shapes
from corvidex.session import load_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judge(spark):
    return PairJudge(fit_language_model(load_table(spark, SF, "documents"), "doc_id", "content", "lang"), fit_ending_model(load_table(spark, SF, "journal_observations"), "assistant_text"))


def test_language_held_out(spark):
    rows = load_table(spark, SF, "documents").where("length(content) > 200 and lower(lang) in ('en','pl','de','fr')").orderBy("doc_id").collect()
    fit, held = rows[::2], rows[1::2]
    m = LanguageModel.fit([r.content for r in fit], [r.lang.lower() for r in fit])
    best, _ = m.best([clean_prose(r.content) for r in held])
    right = sum(m.labels[b] == r.lang.lower() for b, r in zip(best, held))
    assert right / len(held) > 0.95


def test_endings_held_out(spark):
    texts = [r[0] for r in load_table(spark, SF, "journal_observations").where("length(assistant_text) > 120").select("assistant_text").orderBy("sequence").collect()]
    whole = [t for t in texts[1::2] if t.rstrip()[-1] in ".!?"]
    m = EndingModel.fit(texts[::2])
    rng = random.Random(4)
    cut = [t[: rng.randrange(60, len(t) - 15)].rstrip() for t in whole]
    cut = [t for t in cut if t[-1].isalpha()]
    assert sum(is_truncated(t, m) for t in cut) / len(cut) > 0.95
    assert sum(is_truncated(t, m) for t in whole) / len(whole) < 0.01


def test_endings_are_counted_over_all_texts(spark, monkeypatch):
    """The distributed counts are those of one pass over all texts, and shapes are those of a plain reading."""
    import re

    texts = [r[0] for r in load_table(spark, SF, "journal_observations").where("length(trim(assistant_text)) > 0").select("assistant_text").collect()]
    texts += ["x", "²a", "a_b  c\t\n", "12 3x ½", "w" * 5000, "(((( " * 900, "", "   ", "żółw 7.", "\x02 odd"]
    one = EndingModel.fit([t for t in texts if t.strip(" ")])  # blank texts have no end
    many = fit_ending_model(spark.createDataFrame([(t,) for t in texts], "t string").repartition(5), "t")
    assert len(one.orders) == len(many.orders) == 8
    for a, b in zip(one.orders, many.orders):
        assert all((x == y).all() for x, y in zip(a, b))
    assert one.orders[0][2].sum() == sum(bool(t.strip(" ")) for t in texts)
    for t in texts[-60:]:
        plain = re.sub(r"[^\W_]+", lambda m: "w" if m[0].isalpha() else "0" if m[0].isdecimal() else "x", re.sub(r"[^\S\n]+", " ", "\x02" + t.rstrip()))
        assert "".join(chr(int(c)) for c in shapes([t])[0]) == plain, t
    assert fit_ending_model(spark.createDataFrame([], "t string"), "t").probability("abc") == 0.01


def test_rules():
    for t in ("I'm sorry, but I can't help with X-1.", "Przykro mi, ale nie mogę w tym pomóc.", "Diese Anfrage muss ich ablehnen.", "Je dois refuser cette demande.", "My guidelines prevent me from working on ZoneTable.", "I don't feel comfortable giving advice. You may want to ask the owner instead."):
        assert is_refusal(t), t
    assert is_refusal("I can't help with X-1. " * 3 + "I'm sorry. Please ask the owner. I must decline. We are not allowed to do this.")  # of any length
    for t in ("Done.", "No, nothing else is open.", "I can't reproduce the stall any more, so here is what I found. It works.", "I won't touch the schema here; the smaller change is enough. Both agree.", "Sorry for the noise in the last run; the fix is in.", "I cannot help with X. The fix is in core/A.java now."):
        assert not is_refusal(t), t
    p = "Why does the sieve fail when late rows arrive twice?"
    for a in (p, p.upper(), "You asked: " + p, p[:-1] + ".", "Why does the fail when late rows arrive twice?", p + " " + p, "  Why does  the sieve fail when late rows arrive twice? \n"):
        assert is_copy(p, a), a
    for a in ("> " + p + "\n\nBecause the cursor moved without a gap and the filter was off.", "The sieve fails because of late rows."):
        assert not is_copy(p, a), a
    assert not is_copy("ok", "ok, done") and is_copy("ok", "OK")
    assert is_open("text\n```java\nx") and is_open("The next steps are:") and is_open("a (see b") and is_open("1. one\n2.")
    assert not is_open("text\n```\nx = (\n```") and not is_open("a (see b)") and not is_open("- core/x.java")


def test_pairs(spark, judge):
    en, pl = "Please check the diff of the reader and tell me what changed since the last run.", "Sprawdź proszę różnice i powiedz, co się zmieniło od ostatniego przebiegu."
    en_a, pl_a = "Both readers agree on the window length after the fix and the nightly run is stable.", "Oba odczyty są już zgodne, a nocny przebieg nie zatrzymuje się po zmianie kolejności."
    rows = [
        (1, en, en_a, None), (2, en, pl_a, None), (3, pl, en_a, None), (4, en + " Answer in Polish please.", pl_a, None), (5, None, None, None), (6, " ", "Done.", None), (7, en, "", "x"), (8, en, "​", None),
        (9, en, en, None), (10, en, "I am not able to assist with this request.", None), (11, en, "Both readers agree on the window length and the nigh", None), (12, en, "Done.", None), (13, en, "Done.", None),
        (14, None, "Both readers agree on the win", None), (15, "ok", en_a, None), (16, en, (en_a + " ") * 3000, None), (17, "Sprawdz prosze roznice i powiedz, co sie zmienilo od ostatniego przebiegu.", pl_a, None), (18, en, "[empty]", None),
    ]
    df = spark.createDataFrame(rows, "sequence long, u string, a string, defect_type string")
    got = {r.sequence: r.defect_type for r in pair_defects(df, "sequence", "u", "a", judge).collect()}
    assert got == {2: "language", 3: "language", 5: "empty", 7: "empty", 8: "empty", 9: "copy", 10: "refusal", 11: "truncated", 18: "empty"}
    assert pair_defects(df.limit(0), "sequence", "u", "a", judge).count() == 0
