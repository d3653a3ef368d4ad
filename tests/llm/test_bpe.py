import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrid.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
try:
    PAIRS = bpe.load(bpe.vocabulary_path())
except ImportError:
    pytest.skip("no vocabulary files", allow_module_level=True)
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=PAIRS.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_public_encoder(text):
    ids = PAIRS.encode(text)
    assert ids == REFERENCE.encode_ordinary(text) and "".join(PAIRS.decode(ids)) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab '\n s l1é!", max_size=12), max_size=30))
def test_any_blocks_give_the_same(blocks):
    t = bpe.Transducer(PAIRS)
    ids = [i for b in blocks for i in t.feed(b)] + list(t.finish())
    assert ids == REFERENCE.encode_ordinary("".join(blocks))


def small(seed):
    """A vocabulary with a short lookahead, from merges of random pairs."""
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    letters = [b"a", b"b", b"c"]
    for _ in range(12):
        new = rng.choice(letters) + rng.choice(letters)
        if new not in tokens and len(new) <= 4:
            letters.append(new)
            tokens.append(new)
    return bpe.BytePairs({t: i for i, t in enumerate(tokens)})


@pytest.mark.parametrize("seed", range(8))
def test_lookahead_is_sufficient(seed):
    pairs = small(seed)
    assert pairs.lookahead < 200
    rng = random.Random(seed)
    word = "".join(rng.choices("abc", k=6000))
    t, ids, most = bpe.Transducer(pairs), [], 0
    for i in range(0, len(word), 50):
        ids += t.feed(word[i : i + 50])
        most = max(most, len(t.held))
    assert ids + list(t.finish()) == pairs.merge(word.encode())
    assert most <= 3 * pairs.lookahead + 60  # memory does not grow with the word


def test_long_words_cut_between_characters():
    pairs = small(1)
    word = "aé日b" * 800
    t = bpe.Transducer(pairs)
    ids = [i for k in range(0, len(word), 37) for i in t.feed(word[k : k + 37])] + list(t.finish())
    assert ids == pairs.merge(word.encode()) and "".join(pairs.decode(ids)) == word


def test_decoder_waits_for_whole_characters():
    ids = [PAIRS.ranks[bytes([b])] for b in "é".encode()]
    assert list(PAIRS.decode(ids)) == ["é"] and "".join(PAIRS.decode(ids[:1])) == "�"


def test_table(spark):
    df = spark.createDataFrame([(1, "levy on rent"), (2, None), (3, ""), (4, " \n\n "), (5, "<|endoftext|>"), (6, "x" * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and all(got[k] == REFERENCE.encode_ordinary(t) for k, t in ((1, "levy on rent"), (4, " \n\n "), (5, "<|endoftext|>"), (6, "x" * 100_000)))
    back = bpe.decode_column(bpe.encode_column(df, "doc_id", "text"), "doc_id", "ids")
    assert {r["doc_id"]: r["text"] for r in back.collect()}[4] == " \n\n "
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_every_document_runs_through_the_transducer(spark, monkeypatch):
    fed, most = [], []

    class Counting(bpe.Transducer):
        def feed(self, text):
            fed.append(len(text))
            out = super().feed(text)
            most.append(len(self.held))
            return out

    monkeypatch.setattr(bpe, "Transducer", Counting)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert PAIRS.encode(t) == (REFERENCE.encode_ordinary(t) if t else [])
    assert sum(fed) == sum(len(t or "") for t in texts) and max(fed) <= bpe.BLOCK and len(fed) > len(texts)
    assert max(most) <= 2 * PAIRS.longest  # what waits is part of one word, whatever the length of the text


def test_long_texts_keep_a_bounded_buffer():
    t, most, n = bpe.Transducer(PAIRS), 0, 0
    for _ in range(300):
        n += len(t.feed("levy on rent, 25% of it\n" * 20))
        most = max(most, len(t.held))
    assert n + len(t.finish()) == len(REFERENCE.encode_ordinary("levy on rent, 25% of it\n" * 6000)) and most < 16


@pytest.mark.parametrize("text", ["a\ud83d\ude00b", "x\ud83d", "\ude00y", "a\ud83d\ud83d\ude00", "é\udc00" * 30])
def test_surrogates(text):
    want = REFERENCE.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    assert all(PAIRS.encode(text, block) == want for block in (1, 2, 3, 512))
    assert [i for c in small(1).stream(text * 2000, 64) for i in c] == small(1).encode((text * 2000).encode("utf-16", "surrogatepass").decode("utf-16", "replace"), 10**6)
