import random
from collections import Counter

import numpy as np
import pytest

from lexgrid.llm import personal as P

GIVEN = ["Anil", "Mark", "Hope", "Priya", "Talia"]
FAMILY = [a + b for a in ("Bhar", "Dras", "Torn", "Var", "Kes") for b in ("adkar", "anzi", "enthal", "karni")]
CASES = [
    ("Call me on +91 55533 75946 after six.", "phone", "+91 55533 75946"), ("WhatsApp (060) 555-018181; thanks", "phone", "(060) 555-018181"), ("phone 07700 900 576.", "phone", "07700 900 576"),
    ("mail mina.velovic at co dot ondapur dot example, please", "email", "mina.velovic at co dot ondapur dot example"), ("<a_b+c@firm-books.test>, cc", "email", "a_b+c@firm-books.test"), ("from: x-y @ kessar-mills.test", "email", "x-y @ kessar-mills.test"),
    ("My PAN is ABCQE-1234-K.", "identity_number", "ABCQE-1234-K"), ("national id 1140.9725.2141", "identity_number", "1140.9725.2141"), ("passport Z1 319 423, resident", "identity_number", "Z1 319 423"), ("account 7192 2640 883.", "identity_number", "7192 2640 883"),
    ("I live at Door 208b, Old Granary Road,\nVexford.", "street_address", "Door 208b, Old Granary Road,\nVexford"), ("came back from P.O. Box 195, Drasova 005847, what now?", "street_address", "P.O. Box 195, Drasova 005847"),
    ("from 141 Larkspur St., Apt 40, Quillhaven, ZZ1 5QT is let", "street_address", "141 Larkspur St., Apt 40, Quillhaven, ZZ1 5QT"),
    ("tenant Anil R. Varkarni pays Rs 5", "person_name", "Anil R. Varkarni"), ("Talked to Keskarni, Priya and Talia about section 3", "person_name", "Keskarni, Priya"), ("this is hope bharanzi, age 43.", "person_name", "hope bharanzi"), ("Dr. Zoya, phone 1", "person_name", "Zoya"),
    ("D.K. Tornanzi-Varadkar's employer withheld 8k", "person_name", "D.K. Tornanzi-Varadkar"),
]
LEFT_ALONE = [
    "Turnover came to 12501510000 rupees.", "Invoice INV-2031-001821 was for Rs. 940,000", "order dated 12.04.2031, para 5.3.2", "The ratio is 12/3 and the street value is lower.", "I hope to grow a rose nursery",
    "will the bill for repairs mark a new block?", "see page 221 table 5, Road cess included", "Does clause (a) of section 76A(3) cover a street vendor?", "asset code ABCDE1234 and lot QX-77-2030", "I paid ₹9,00,000 as rent in Ondapur.", "", "  ", None, "x" * 20_000,
]
KEY = ["source_table", "row_key"]
#: Sentences of no test table, with a place for one item each.
SENTENCES = {
    "person_name": [
        "Please ask {} about the roof.", "{} wrote to us in May.", "The keys are with {} until Friday.", "We met {} at the fair, it rained.", "Yesterday {} paid half of it.", "Letter from {}: all is well.",
        "My cousin {} agrees with that.", "Signed, {}", "The form was filled in by {} last week.", "Is {} allowed to vote?", "Mrs {} has the file.", "the caretaker, {}, saw nothing",
    ],
    "phone": ["Ring the desk, tel {} before noon", "my mobile: {}", "Please call {} or write.", "Contact {} for the keys."],
    "email": ["send it to {} today", "cc {}, please", "My address is {} for now."],
    "identity_number": ["the passport is {} and still valid", "pay into account {} by Monday", "my tax number {} is on file", "card number {} was lost"],
    "street_address": ["We moved to {} last year.", "Deliver it to {}.", "The shop at {} is closed."],
}
PLAIN = ["The fair is on again, rain or shine.", "Half of it went to the bank in April.", "Is the roof tight?", "We paid 1,200 for 40 units.", "Nothing of note happened.", "The file has 300 pages, see page 12.", "Dear Sir, all is well.", "Yesterday it rained in Lisbon."]


def made(kind, rng):
    """An item, and whether a list has all of its name."""
    given, family = GIVEN + ["Rosamund", "Ulf", "Tamsin"], FAMILY + ["Ferndale", "Okonjo"]
    g, f = (rng.choice(x[:-3] if rng.random() < 0.85 else x[-3:]) for x in (given, family))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    return {
        "person_name": lambda: rng.choice([f"{g} {f}", f"{g} {f}", f"{g} K. {f}", f"{f}, {g}"]),
        "phone": lambda: rng.choice([f"+91 {digits(5)} {digits(5)}", f"0{digits(4)} {digits(3)} {digits(3)}", f"(0{digits(2)}) {digits(3)}-{digits(6)}"]),
        "email": lambda: rng.choice([f"{f.lower()}.{g.lower()}@post.test", f"{g.lower()} [at] mills [dot] example"]),
        "identity_number": lambda: rng.choice([f"{''.join(rng.choices('ABCDEF', k=5))}{digits(4)}Z", f"K{digits(7)}", f"{digits(4)} {digits(4)} {digits(6)}"]),
        "street_address": lambda: f"Flat {rng.randrange(9)}B, {rng.choice(['Heron', 'Old Well', 'Salt'])} {rng.choice(['Road', 'Lane', 'Street'])}, {rng.choice(['Marlstone', 'Penhurst'])} {digits(3)} {digits(3)}",
    }[kind]()


def corpus(seed, n):
    rng, rows, truth = random.Random(seed), [], {}
    for i in range(n):
        kind = rng.choice([*SENTENCES, *["person_name"] * 4, None, None])
        if kind is None:
            rows.append(("made", f"m{i}", rng.choice(PLAIN)))
            truth[f"m{i}"] = set()
            continue
        item, frame = made(kind, rng), rng.choice(SENTENCES[kind])
        text = frame.format(item)
        rows.append(("made", f"m{i}", text))
        truth[f"m{i}"] = {(kind, frame.index("{"), frame.index("{") + len(item))}
    return rows, truth


@pytest.fixture(scope="module")
def results(spark):
    rows, truth = corpus(1, 2500)
    rows += [("case", f"c{i}", t) for i, (t, _, _) in enumerate(CASES)] + [("alone", f"a{i}", t) for i, t in enumerate(LEFT_ALONE)] + [("emoji", "e", "🙂🙂 mail a@b.test")]
    texts = spark.createDataFrame(rows, "source_table string, row_key string, text string")
    lexicon = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY], "name_part string, part_kind string")
    return {r["row_key"]: (r["text"], {tuple(s) for s in r["spans"]}) for r in P.find(texts, lexicon, KEY).collect()}, truth


@pytest.mark.parametrize("i", range(len(CASES)))
def test_finds(results, i):
    text, spans = results[0][f"c{i}"]
    assert CASES[i][1:] in {(k, text[a:b]) for k, a, b in spans}


@pytest.mark.parametrize("i", range(len(LEFT_ALONE)))
def test_leaves_alone(results, i):
    assert results[0][f"a{i}"][1] == set()


def test_positions_count_code_points(results):
    assert results[0]["e"][1] == {("email", 8, 16)}


def test_sentences_of_no_test_table(results):
    got, truth = results
    right, wanted, found = Counter(), Counter(), 0
    for key, items in truth.items():
        found += len(got[key][1])
        for item in items:
            wanted[item[0]] += 1
            right[item[0]] += item in got[key][1]
    assert sum(right.values()) >= 0.95 * sum(wanted.values()), (right, wanted)
    assert all(right[k] >= 0.9 * n for k, n in wanted.items()), (right, wanted)
    assert sum(right.values()) >= 0.95 * found
    unknown = [(k, items) for k, items in truth.items() if any(x in got[k][0] for x in ("Rosamund", "Ulf", "Tamsin"))]
    hit = sum(items <= got[k][1] for k, items in unknown if items)
    assert len(unknown) > 50 and hit >= 0.8 * len(unknown)  # given names that no list has


def test_em_learns_who_is_reliable():
    # two labelers agree on most cases, a third one votes at random
    found = P.reliabilities(Counter({"+++": 400, "++0": 400, "00+": 200, "--+": 300, "--0": 300}))
    assert found["++0"] > 0.9 and found["--+"] < 0.1


def test_classifier_learns_without_votes():
    rng = np.random.default_rng(0)
    mail = "+0000"
    rows = [([1, 10 + int(y), 20 + int(rng.integers(5))], P.vote_features("email", mail) if y and rng.random() < 0.8 else [], float(y)) for y in rng.integers(0, 2, 400)]
    w = P.train(rows)
    assert w[[1, 11, 22]].sum() > 1.4 and w[[1, 10, 22]].sum() < -1.4 and P.probability(w, "email", mail, [1, 11, 22]) > 0.9
    assert P.probability(w, "email", "00000", [1, 11, 22]) == 0
    assert not P.train([]).any()


def test_overlaps():
    name = lambda a, b, p: ("person_name", a, b, p)
    assert P.choose([name(0, 10, 0.9), name(5, 10, 0.95)]) == [("person_name", 0, 10)]
    assert P.choose([name(0, 10, 0.6), name(5, 10, 0.95)]) == [("person_name", 5, 10)]
    assert P.choose([name(0, 10, 0.9), ("email", 5, 12, 0.6)]) == [("email", 5, 12)] and P.choose([name(0, 3, 0.4)]) == []


def test_tables(spark):
    rows = [("t", str(i), t) for i, t in enumerate([None, "", "mail Anil Varkarni at a@b.test now", "mail Anil Varkarni at a@b.test now", "nothing"] + ["tenant Anil Varkarni pays; a@b.test"] * 20)]
    texts = spark.createDataFrame(rows, "source_table string, row_key string, text string")
    lexicon = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY], "name_part string, part_kind string")
    done = {r["row_key"]: r["redacted"] for r in P.redact(P.find(texts, lexicon, KEY), KEY).collect()}
    assert done["0"] is None and done["1"] == "" and done["4"] == "nothing" and done["2"] == done["3"] == "mail [PERSON_NAME] at [EMAIL] now" and done["9"] == "tenant [PERSON_NAME] pays; [EMAIL]"
    assert P.find(texts.limit(0), lexicon, KEY).count() == 0
