import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corvidex.llm.textform import LOOKALIKE_FROM, look_alike_classes, look_alike_pairs, unify_array, unify_text


def one(s):
    return unify_array(pa.array([s])).to_pylist()[0]


PLAIN = "".join(chr(c) for c in [*range(32, 127), *range(0xC0, 0x180), *range(0x300, 0x315), 0x323, 0x328, 0x1EA5, 0x1E69, 0x434, 0x439, 0x438, 0xD7] if chr(c) not in LOOKALIKE_FROM and unicodedata.decomposition(chr(c))[:1] != "<")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(PLAIN, max_size=12), min_size=1, max_size=6))
def test_canonical_composition_is_nfc(texts):
    want = [unicodedata.normalize("NFC", x) for x in texts]
    assert unify_array(pa.array(texts)).to_pylist() == want
    assert unify_array(pa.array([unicodedata.normalize("NFD", x) for x in texts])).to_pylist() == want


def test_same_look():
    assert one("ｆｕｌｌ－ｗｉｄｔｈ　１２＝") == "full-width 12="
    assert one("ofﬁce‑x a b c­​﻿") == "office-x a b c"
    assert one("Сору") == one("Copy") == "Copy"
    assert one("ę́ ż") == one("ę́ ż")
    assert one("a\r\nb\rc d") == "a\nb\nc\nd"
    assert one("ё") == one("ë") == one("ë")


def test_visible_differences_stay():
    for a, b in [("x2", "x²"), ("l", "ł"), ("a–b", "a-b"), ("A", "a"), ("o", "0"), ("a  b", "a b"), ("a b", "ab"), ("ß", "ss"), ("é", "e")]:
        assert one(a) != one(b), (a, b)


def test_edges():
    long = "ﬁ́" * 100_000
    got = unify_array(pa.array([None, "", "​", long, "́a", "e"])).to_pylist()
    assert got[:3] == [None, "", ""] and len(got[3]) == 200_000 and got[4:] == ["́a", "e"]
    assert unify_array(pa.array(["x", "́"])).to_pylist() == ["x", "́"]  # rows do not run together
    assert unify_array(pa.array(["zz", "é", None])[1:]).to_pylist() == ["é", None]
    assert unify_array(pa.array([], pa.string())).to_pylist() == []


def test_pairs_against_brute_force(spark):
    rng = random.Random(7)
    base = ["alpha ﬁx", "beta Copy", "gamma é", "only one", ""]
    swap = {"ﬁ": "fi", "C": "С", "é": "é", " ": " "}
    rows = [(i, "".join(swap.get(c, c) if rng.random() < 0.5 else c for c in rng.choice(base)), None) for i in range(60)]
    rows += [(100, None, None), (101, "​", None), (102, "​​", None), (103, "x²", None), (104, "x2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, f string")
    got = sorted(tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect())
    forms = {i: one(t) for i, t, _ in rows if t}
    stored = {i: t for i, t, _ in rows}
    want = sorted((a, b) for a in forms for b in forms if a < b and forms[a] == forms[b] and stored[a] != stored[b])
    assert got == want and want
    assert look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    rows = look_alike_classes(df, "doc_id", "text").collect()
    assert {r.doc_id: r.n_links for r in rows} == links and len(rows) == len(links)
    for r in rows:
        assert r.class_id == min(i for i in forms if forms[i] == forms[r.doc_id]) and r.variant_id == min(i for i in forms if stored[i] == stored[r.doc_id])
    assert look_alike_classes(df.limit(0), "doc_id", "text").count() == 0
    assert unify_text(df, "text", "text2").columns == ["doc_id", "text", "f", "text2"]


def test_one_form_of_a_third_of_all_rows(spark):
    """Copies cost one row each in the classes, however many there are."""
    rows = [(i, "Copy" if i % 3 == 0 else f"text {i}") for i in range(6000)] + [(9000, "Сopy"), (9001, "Copy\u00ad")]
    got = look_alike_classes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert len(got) == 2002 and {r.class_id for r in got} == {0}
    assert {(r.variant_id, r.n_links) for r in got} == {(0, 2), (9000, 2001), (9001, 2001)}


def test_large_batches_are_halved(monkeypatch):
    import corvidex.llm.textform as t

    b = pa.record_batch({"x": ["ab" * 50, None, "", "é" * 40, "z"], "n": [1, 2, 3, 4, 5]})
    monkeypatch.setattr(t, "BATCH_BYTES", 60)
    parts = t._small(b, "x")
    assert len(parts) > 2 and pa.Table.from_batches(parts).to_pydict() == b.to_pydict()
