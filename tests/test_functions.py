from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexgrid.functions import paths as P
from lexgrid.functions import scan as C
from lexgrid.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("text, want", [("354A and 80C", ["354a", "and", "80c"]), ("co­op a b", ["coop", "a", "b"]), ("Straße", ["strasse"]), ("…!?", []), ("", []), (None, None)])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("x")), x=text) == want


@pytest.mark.parametrize("text, want", [("2,00,000", [200000]), ("2 lakh and 3 crore", [200000, 30000000]), ("12.50", [12.5]), ("dated 12.04.2031", []), ("7 7 7.0", [7]), ("Nil", [])])
def test_numbers(spark, text, want):
    assert [float(v) for v in one(spark, T.numbers_in(F.col("x")), x=text)] == want


@pytest.mark.parametrize("text, want", [("Rs. 730,000", 730000), ("-27 lakh rupees", -2700000), ("₹ 24 crore", 240000000), ("12k", 12000), ("INR 5,500.50", 5500.5), ("about 5", None), (None, None)])
def test_money(spark, text, want):
    got = one(spark, T.money(F.col("x")), x=text)
    assert (None if got is None else float(got)) == want


def test_other_texts(spark):
    assert one(spark, T.tax_year(F.col("x")), x="2026-27") == "2026-27" and one(spark, T.tax_year(F.col("x")), x="2026-28") is None and one(spark, T.tax_year(F.col("x")), x="1999-2000") == "1999-00"
    assert one(spark, T.redact(F.col("x")), x="ABCDE1234F 1234 5678 9012 123456789") == "[PAN] [AADHAAR] [ACCOUNT]"
    assert one(spark, T.defined_term(F.col("x")), x='\n(12A) "levy" means') == "levy"
    assert one(spark, T.omitted_only(F.col("x")), x="(a)  [***] ") is True
    assert one(spark, T.find_phrase(T.tokens(F.col("x")), T.tokens(F.col("y"))), x="a b c b c d", y="b c d") == 3
    assert one(spark, T.token_estimate(F.col("x")), x="Straße, 30½ %") == 4
    assert one(spark, T.line_type(F.col("x")), x="[fact] [2]") == "malformed"


@pytest.mark.parametrize("raw, path, depth", [("Section 277(1) (i)", "277(1)(i)", 3), ("Schedule XV(A1)", "Schedule XV(A1)", 2), ("u/s 80C", "80C", 1), ("12-A", None, None), ("", None, None)])
def test_paths(spark, raw, path, depth):
    got = P.canonical(F.col("x"))
    assert one(spark, got, x=raw) == path
    if path:
        assert one(spark, P.depth(got), x=raw) == depth


def test_credit(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, P.credits(a, b), a="70(1)", b="70(1)(a)") is True and one(spark, P.credits(a, b), a="70(1)(a)", b="70(1)") is False
    assert one(spark, P.credits(a, b), a="7", b="70") is False and one(spark, P.same_line(a, b), a="70(1)(a)", b="70(1)") is True
    assert one(spark, P.prefixes(a), a="70(1)(a)") == ["70", "70(1)", "70(1)(a)"] and one(spark, P.parent(a), a="70") is None
    assert one(spark, P.number_range(a, b), a="71", b="73") == ["71", "72", "73"] and one(spark, P.number_range(a, b), a="9", b="1") == ["9", "1"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("section 70(1)(a), (c) and (d)", ["70(1)(a)", "70(1)(c)", "70(1)(d)"]), ("sections 71 to 75", ["71", "72", "73", "74", "75"]), ("clause (a) of section 80(6)", ["80(6)(a)"]),
        ("sub-clause (ii) of clause (b) of section 9(1)", ["9(1)(b)(ii)"]), ("Schedule II and IV", ["Schedule II", "Schedule IV"]), ("section 12 (1)\n(a)", ["12(1)(a)"]), ("nothing here", []), (None, []),
    ],
)
def test_reference_scan(text, want):
    assert [c for r in C.references(text) for c in r["citations"]] == want


def test_reference_kinds():
    assert [r["ref_type"] for r in C.references("this Act and this sub-section")] == ["this_act", "this_subsection"]
    assert C.references("section 5 of the Old Levy Act")[0]["act_name"] == "Old Levy Act"


@pytest.mark.parametrize("text, want", [("twenty one lakh", [2100000]), ("one such", []), ("two hundred and five", [205]), ("three crore five lakh", [30500000]), ("lakh", []), (None, []), ("five, six", [5, 6])])
def test_word_numbers(text, want):
    assert C.words_to_numbers(text) == want


@pytest.mark.parametrize("text, want", [("3 ÷ 4 × 100", "75"), ("(2 + 3) * 4", "20"), ("10% x 2 lakh", "20000"), ("1 / 0", None), ("2 +", None), ("(1", None), ("", None), ("8 - 3 - 2", "3")])
def test_arithmetic(text, want):
    assert C.evaluate(text) == (None if want is None else Decimal(want))


def test_outline():
    got = C.outline("(1) x\n(a) y\n(b) z\n(i) roman\n(ii) two\n(2) next\n(zz) no\n(1) again")
    assert [(o["path"], o["anomaly"]) for o in got] == [("(1)", None), ("(1)(a)", None), ("(1)(b)", None), ("(1)(b)(i)", None), ("(1)(b)(ii)", None), ("(2)", None), (None, "not_a_marker"), (None, "not_a_marker")]


def test_case_folding_of_every_sign_as_far_as_tokens_show_it(spark):
    import re

    signs = [c for c in map(chr, range(1, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c not in "\xad\xa0"]
    lines = ["".join(f"{c}x\n" for c in signs[i : i + 500]) for i in range(0, len(signs), 500)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(lines)), "i int, t string").orderBy("i").select(T.tokens(F.col("t"))).collect()]
    assert got == [re.findall("[a-z0-9]+", t.casefold()) for t in lines]


def test_furniture(spark):
    lines = ["Income Tax Department", " Ministry of Finance,\xa0Government of India ", "Downloaded/Printed on 3 May", "The Income Tax Department", "Income\xad Tax Department", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(T.is_furniture(F.col("t"))).collect()] == [True, True, True, False, True, False, None]
    assert [r[0] for r in df.select(T.is_furniture(F.col("t"), ["x"], [])).collect()] == [False] * 6 + [None]


def test_breadcrumbs(spark):
    rows = [("I", "Levies", "5(1)", "Rates"), ("I", None, "5", None), (None, "Levies", "Schedule II(1)", "Rates"), ("", "Levies", "5", "Rates")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, c string, p string, t string").orderBy("i")
    got = [r[0] for r in df.select(P.breadcrumb(F.col("n"), F.col("c"), F.col("p"), F.col("t"))).collect()]
    assert got == ["Chapter I — Levies / Section 5(1) — Rates", "Chapter I / Section 5", "Schedule II(1) — Rates", "Section 5 — Rates"]
