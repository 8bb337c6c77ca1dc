"""SentencePiece scan: cut anywhere, same ids; exact round trip."""

import random

import numpy as np
import public_tokenizers
import pytest

from llm import pieces


@pytest.fixture(scope="module")
def words():
    return pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def scanned(words, text, size):
    parts = [text[i : i + size] for i in range(0, len(text), size)]
    chunks = [pieces.Chunk(words, p, (parts[i + 1] if i + 1 < len(parts) else "")[: words.longest], i == 0) for i, p in enumerate(parts)]
    now, entries = np.full((1, words.longest), pieces.NONE, np.int64), []
    now[0, 0] = 0
    for c in chunks:
        entries.append(now[0].tolist())
        now = pieces.combine(now, c.transfer())
    state, exits = 0, []
    for o in reversed([c.origins(e) for c, e in zip(chunks, entries, strict=True)]):
        exits.append(state)
        state = o[state]
    assert state == 0
    return [i for c, e, x in zip(chunks, entries, exits[::-1], strict=True) for i in c.ids(e, x)[0]]


def plain(words, text):
    s = pieces.lattice_text(text, True)
    _, back = words.forward(s, [0], len(s))
    return words.trace(s, back, len(s))[0]


def test_any_cut_gives_the_same_ids(words):
    rng = random.Random(3)
    for letters in ("abcdethe  \n▁éß漢字aaaa.", "a", "ab", "the ", "漢字を", "abc d "):
        for _ in range(12):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))
            want = plain(words, text)
            assert words.encode(text) == want and words.encode(text) == want and words.decode(want) == text
            assert all(scanned(words, text, size) == want for size in (32, 45, 128))


def test_products_are_associative(words):
    rng = np.random.default_rng(5)
    a, b, c = (rng.integers(-1000, 0, (16, 16)) for _ in range(3))
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


def test_documents_whole_and_cut(edge, sample, nothing):
    for docs in (edge, sample):
        columns = ["doc_id", "n_tokens", "ids_sum", "ids_check", "exact"]
        whole, cut = pieces.measured(docs, chunk=1 << 20), pieces.measured(docs, chunk=200)
        assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, cut.select(columns).collect()))
        assert whole.count() == docs.count() and whole.where("not exact").count() == 0
    assert pieces.measured(nothing).count() == 0


def test_decoding(words, sample):
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(sample, chunk=300)).collect()}
    assert back == {r.doc_id: r.text or "" for r in sample.collect()}


def test_checksum_of_ids(words, sample):
    got = {r.doc_id: r for r in pieces.measured(sample, chunk=300).collect()}
    for r in sample.limit(30).collect():
        ids = words.encode(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sum) == (len(ids), sum(ids))
        assert got[r.doc_id].ids_check == sum((k + 1) * i for k, i in enumerate(ids)) % pieces.PRIME
