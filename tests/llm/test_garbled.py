import pytest

from lexgrid.llm import garbled as G

CLEAN = {
    "fr": "Âge, état civil et résidence doivent être précisés. L’entrepôt coopératif a été exonéré à hauteur de 40 €.",
    "ru": "Каждый плательщик подаёт отчёт в течение дней. Согласно разделу склад освобождается от сбора.",
    "pl": "Każdy współwłaściciel zgłasza decyzję. Księgi należy przechowywać. Za opóźnienie należą się odsetki.",
    "tr": "Küçük işyeri sahipleri için ayrı ölçüt geçerlidir. Kullanılmayan zarar yıl ileriye taşınır.",
    "ja": "倉庫組合の修繕費は半額のみ認められる。審査会は理由を付して決定する。",
    "de": "Die Prüfstelle schließt das Verfahren, sobald die Größe der Fläche geklärt ist. Rückzahlungen über 9 €.",
}
TRAPS = ["PÃO E MAÇÃ, SÃO JOÃO", "ÐÞý in Icelandic: Ýmir, Þórður", "Row Â, column Ã, code ¤", "r&eacute;sum&Atilde;&copy; and \\u00e9", "Ratio 3 ÷ 4 × 100 = 75 % ± ½", "zero​width‍join", "The levy officer", "emoji 🧾👍🏽", "§§ 4–9 «ibid.» ‘single’", "plain", "", None]
WRONG = [("fr", "utf-8", "cp1252"), ("fr", "mac_roman", "cp1252"), ("fr", "utf-8", "cp437"), ("ru", "cp1251", "latin-1"), ("ru", "koi8_r", "cp1251"), ("ru", "utf-8", "cp1251"), ("pl", "cp1250", "latin-1"), ("pl", "utf-8", "cp1250"), ("tr", "cp1254", "latin-1"), ("ja", "utf-8", "cp850"), ("de", "utf-8", "gbk"), ("de", "cp1252", "cp437")]


@pytest.fixture(scope="module")
def repaired(spark):
    rows, k = [], 0
    for text in CLEAN.values():
        rows += [(k := k + 1, text) for _ in range(60)]
    clean = k
    rows += [(k := k + 1, t) for t in TRAPS for _ in range(6)]
    good = k
    cases = {}
    for lang, written, read in WRONG:
        rows.append((k := k + 1, CLEAN[lang].encode(written).decode(read, "replace")))
        cases[k] = (CLEAN[lang], rows[-1][1])
    rows.append((k := k + 1, CLEAN["de"].encode("cp1252").decode("utf-8", "replace")))
    cases[k] = (CLEAN["de"], rows[-1][1])
    twice = CLEAN["fr"].encode().decode("latin-1").encode().decode("latin-1")
    rows.append((k := k + 1, twice))
    cases[k] = (CLEAN["fr"], twice)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r for r in G.repair(df, "doc_id", "text").collect()}, good, cases


def test_all_garbled_texts_are_found_and_no_other(repaired):
    found, good, cases = repaired
    assert {k for k in found if k <= good} == set()
    assert set(cases) <= set(found)


def test_restored(repaired):
    found, _, cases = repaired
    whole = [k for k, (want, given) in cases.items() if G.LOST not in given]
    assert sum(found[k]["restored"] == cases[k][0] for k in whole) >= len(whole) - 1
    for k, r in found.items():
        for s in r["spans"]:
            assert cases[k][1][s["start_char"] : s["end_char"]]


def test_bytes_and_parts():
    assert G.to_bytes("Ã©", "cp1252") == b"\xc3\xa9" and G.to_bytes("日", "cp1252") is None and G.to_bytes("�a", "cp1252") == b"\0a"
    assert G._partly("cafÃ©’s", "cp1252") == "café’s" and G._partly("plain", "cp1252") == "plain"


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ascii")], "doc_id long, text string")
    assert G.repair(df, "doc_id", "text").count() == 0 and G.repair(df.limit(0), "doc_id", "text").count() == 0
