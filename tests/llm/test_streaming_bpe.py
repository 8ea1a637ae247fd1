"""The streaming transducer against the library, its lookahead against brute force, and the decoder."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from unicodedata import normalize

from burnline.llm import queries, streambpe, wordbpe

HARD = ["a", "b", "s", "'", "'s", "'re", "e", "x", "!", ".", "1", "İ", "é", "́", "̣", "ㅏ", "가", "ᅡ", "ᆨ", "漢", "Σ", "😀", "<|endoftext|>", "<|startoftext|>", "<|end", "\t", " ", "゙", "か", " ", "\n", "ing", "the", "²", "ǅ", "া", "ক", "\x00"]
TURKISH = ["BİZİ, KİŞİ.", "İ.", "aİ,", "İ", "DİYARBAKIR'İ!", "Kİ; Lİ: Mİ?", "क़.", "aक़,"]


@pytest.fixture(scope="module")
def tables():
    return streambpe.Transducer(queries.WORD_BPE)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def in_blocks(tables, text, size):
    return ids_of(b"".join(tables.stream(text[a : a + size] for a in range(0, len(text), size))))


def test_random_texts_in_blocks(tables, monkeypatch):
    monkeypatch.setattr(streambpe, "RUN", 16)
    rng = random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choices(rng.sample(HARD, rng.choice([3, 6, 12])), k=rng.choice([3, 10, 60, 300])))
        want = tables.tok.encode(text, add_special_tokens=False).ids
        for size in (7, 64, 1 << 20):
            assert in_blocks(tables, text, size) == want, repr(text)


@pytest.mark.parametrize("text", ["x" * 90_000, "abc" * 30_000, "漢字" * 20_000, "'" * 9_000, "!?" * 20_000, "lo" * 3000 + "'ll" + "ha" * 3000 + "<|endoftext|>" + "z" * 5000])
def test_long_runs(tables, text):
    want = tables.tok.encode(text, add_special_tokens=False).ids
    assert in_blocks(tables, text, 1 << 14) == want
    assert ids_of(tables.encode(text)) == want


def test_a_long_pretoken_is_held_only_as_far_as_the_window(tables):
    piece, most, out = streambpe.Piece(tables), 0, []
    symbols = [tables.vocab[c] for c in random.Random(3).choices("etaoinshrdlu", k=60_000)]
    for a in range(0, len(symbols), 500):
        out += piece.feed(symbols[a : a + 500])
        most = max(most, len(piece.open))
    assert most <= piece.window + 500
    assert out + piece.close() == tables.merges.merge([*symbols[:-1], tables.last[symbols[-1]]])


def merges_of(rng, alphabet, n):
    tokens, seen, out = list(alphabet), set(alphabet), []
    for _ in range(50 * n):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in seen and len(out) < n and len(a + b) <= 6:
            seen.add(a + b)
            tokens.append(a + b)
            out.append((a, b))
    vocab = {t: i for i, t in enumerate(tokens)}
    return streambpe.Merges(vocab, out), {i: len(t) for t, i in vocab.items()}, vocab


def test_the_lookahead_suffices_for_every_continuation():
    rng, seen = random.Random(11), 0
    for _ in range(60):
        merges, length, vocab = merges_of(rng, "ab", rng.choice([2, 4, 6]))
        need = merges.lookahead
        for n in range(need + 1, min(need + 4, 10)):
            for w in itertools.product("ab", repeat=n):
                ids = [vocab[c] for c in w]
                settled, at = [], 0
                for t in merges.merge(ids):
                    at += length[t]
                    if at > n - need:
                        break
                    settled.append(t)
                seen += len(settled)
                for k in (1, 2, 3):
                    for v in itertools.product("ab", repeat=k):
                        assert merges.merge(ids + [vocab[c] for c in v])[: len(settled)] == settled
    assert seen > 1000


def test_merging_by_heap_is_merging_by_rank(tables):
    rng = random.Random(5)
    for _ in range(300):
        ids = [tables.vocab[c] for c in rng.choices("thersingofa", k=rng.randrange(1, 64))]
        assert tables.merges._merge_long(ids) == tables.merges.merge(ids)


@pytest.mark.parametrize("merges", [[("a", "b"), ("ab", "a"), ("a", "ba")], [("ab", "a"), ("a", "b")], [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")]])
def test_lists_without_a_proven_lookahead_are_refused(merges):
    with pytest.raises(ValueError):
        streambpe.Merges({t: i for i, t in enumerate(["a", "b", "ab", "ba", "aba"])}, merges)


@pytest.mark.parametrize("kind", [wordbpe.Runs, streambpe.Transducer])
def test_letters_that_normalise_to_a_mark(kind):
    runs = kind(queries.WORD_BPE)
    odd = [c for c in map(chr, range(0x110000)) if c.isalnum() and not normalize("NFC", c).lower()[-1].isalnum()]
    assert len(odd) > 20
    for text in [*TURKISH, *(f.format(c) for c in odd for f in ("{}", "a{},", "{}.", "{}a", "é{}!"))]:
        assert ids_of(runs.encode(text)) == runs.tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_decoding_id_by_id(tables):
    text = "Hello wörld 漢字 😀! <|endoftext|> x"
    ids = tables.tok.encode(text, add_special_tokens=False).ids
    as_library = streambpe.Decoder(tables.names, b" ")
    assert "".join([*(as_library.feed([i]) for i in ids), as_library.close()]) == tables.tok.decode(ids, skip_special_tokens=False)
    plain = streambpe.Decoder(streambpe.plain_names(tables.names))
    assert "".join([*(plain.feed([i]) for i in ids), plain.close()]) == "hello wörld 漢字 😀! <|endoftext|>x "
    cut = streambpe.Decoder(streambpe.plain_names(tables.names))  # a character that never ends is marked once closed
    assert cut.feed([tables.vocab["ð"]]) == "" and cut.close() == "�"


def test_rows(spark, tables):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "漢字 é 😀 <|endoftext|> " * 30), (5, "x" * 70_000), *((10 + i, t) for i, t in enumerate(TURKISH))]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, ids string, n_tokens int")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    want, texts = [], []
    for d, t in rows:
        ids = tables.tok.encode(t or "", add_special_tokens=False).ids
        said = tables.tok.decode(ids, skip_special_tokens=False)
        texts.append((d, said))
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    got = [tuple(r) for r in streambpe.round_trip_digests(docs, queries.WORD_BPE).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    decoded = streambpe.decode(streambpe.encode(docs, queries.WORD_BPE), queries.WORD_BPE)
    assert sorted(((r.doc_id, r.decoded) for r in decoded.collect()), key=key) == sorted(texts, key=key)
    assert streambpe.round_trip_digests(docs.limit(0), queries.WORD_BPE).count() == 0
