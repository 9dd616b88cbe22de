import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathkin.llm.bpe import VOCABULARY, encode_decode, loaded, merge
from pathkin.llm.common import vocabulary_file

PATH = vocabulary_file(VOCABULARY)
REFERENCE = Tokenizer.from_file(PATH)


def test_equals_the_library(docs, rows):
    got = {r.doc_id: r for r in encode_decode(docs, PATH, digests=True).collect()}
    for r in rows:
        ids = REFERENCE.encode(r[1] or "", add_special_tokens=False).ids
        one = got[r[0]]
        assert one.n_tokens == len(ids) and one.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert one.decoded_sha256 == hashlib.sha256(REFERENCE.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_and_texts(docs, none):
    assert all(r.decoded == (r.text or "") and len(r.ids) == r.n_tokens for r in encode_decode(docs, PATH).join(docs.select("doc_id", "text"), "doc_id").collect())
    assert encode_decode(none, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    ids = REFERENCE.encode(text, add_special_tokens=False).ids
    coded = loaded(PATH).encode(text)
    assert coded == np.array(ids, "<u4").tobytes() and loaded(PATH).decode(coded) == REFERENCE.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_merges_equal_a_plain_scan(symbols):
    ranks = {0 << 32 | 1: (2, 4), 1 << 32 | 1: (0, 5), 4 << 32 | 5: (1, 6), 2 << 32 | 2: (3, 7), 7 << 32 | 7: (4, 8), 5 << 32 | 5: (5, 9)}
    want = list(symbols)
    while True:
        found = [(ranks[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a << 32 | b in ranks]
        if not found:
            break
        _, i = min(found)
        want[i : i + 2] = [ranks[want[i] << 32 | want[i + 1]][1]]
    assert merge(list(symbols), ranks) == want
