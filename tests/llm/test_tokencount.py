import random

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from quillon.llm import tokencount as C
from quillon.llm.bpe import encoder
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")
FULL = Tokenizer.from_file(PATH)


def full(t):
    return len(FULL.encode(t, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "\n", "it's", "42", "é", "!", "<|endo", "ftext|>", "\x1c"]), max_size=400), st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 40), st.sampled_from(["", " ", "new", " x\n", "ftext|>"])), max_size=5))
def test_counts_stay_right(words, edits):
    text = " ".join(words)
    own = C.Counted(text, encoder(PATH))
    assert own.n_tokens == full(text)
    for a, n, new in edits:
        a = min(a, len(text))
        text = text[:a] + new + text[min(len(text), a + n) :]
        own.edit(a, a + n, new)
        assert own.text == text and own.n_chars == len(text) and own.n_tokens == full(text)


def test_an_edit_looks_at_little():
    """In a text of a megabyte, with a control character and a special token in it, an edit looks at a few leaves."""
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["some", "words,", "and\n", "more", "é", "42"]) for _ in range(260_000))
    text = text[:5000] + "\x1c <|endoftext|> " + text[5000:]
    own = C.Counted(text, encoder(PATH))
    assert len(text) > 1_000_000 and own.n_tokens == full(text)
    for a, n, new in ((len(text) // 2, 12, "changed"), (4990, 30, " in <|endoftext|> here "), (10, 3, ""), (len(text), 0, " end"), (700_000, 3000, "x"), (300_000, 0, "long " * 2000)):
        text = text[:a] + new + text[a + n :]
        before = own.looked, own.encoded
        own.edit(a, a + n, new)
        assert own.n_tokens == full(text) and own.n_chars == len(text)
        assert own.looked - before[0] < n + len(new) + 8 * C.LEAF and own.encoded - before[1] < n + len(new) + 8 * C.LEAF
    assert own.text == text


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(900, None), (None, ""), (901, "long words " * 20000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = C.counts(df).collect()
    assert sorted(r.n_tokens for r in got) == sorted(full(t or "") for _, t in rows)
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        t = t or ""
        for num, den, n, new in C.EDITS:
            at = len(t) * num // den
            t = t[:at] + new + t[at + n :]
        assert (r.edited_chars, r.edited_tokens) == (len(t), full(t))
    assert next(r for r in got if r.doc_id == 901).reencoded_chars < 5000
    assert C.counts(df.limit(0)).count() == 0
