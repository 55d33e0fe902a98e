"""BPE against tiktoken, the block coder's round trip, and token files against the tokenizers library."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from albumen.llm import bpe, tokenbin
from texts import corpus

P = pytest.importorskip("public_tokenizers")
ODD = [(1, "  \n x"), (2, None), (3, ""), (4, "a" * 5000), (5, "don't  we'll 漢字漢字 é É İ"), (6, "\U0001f600" * 9), (7, "same"), (7, "same"), (8, "<|endoftext|> # ## \x1c tab\there")]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(None, P.path("byte_bpe_multi_50k.tiktoken"))


def test_ids_are_those_of_tiktoken(spark, documents, ranks):
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    rows = corpus(4) + ODD
    got = bpe.roundtrip_digest(documents(rows), ranks, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = coder.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_very_long_pieces_are_those_of_tiktoken(spark, documents, ranks):
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choices(letters, k=n)) for letters, n in (("acgt", 200_000), ("etaoinshrdlu", 60_000), ("漢字語文日本", 20_000), ("a", 9_999), ("ab", bpe.LONG + 1))]
    rows = [(i, f"so {t} it, {t[:3000]}") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.roundtrip_digest(documents(rows), ranks, P.PATTERN).collect()}
    for i, t in rows:
        ids = coder.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_folded_pieces_in_vocabularies_whose_longer_tokens_come_first():
    import tiktoken

    rng = random.Random(3)
    for _ in range(100):
        tokens = [bytes([b]) for b in range(256)]
        more = sorted({bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(40)})
        rng.shuffle(more)
        tokens += more
        coder = tiktoken.Encoding("odd", pat_str="[a-c]+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        table, piece = bpe.PairTable(tokens), bytes(rng.choices(b"abc", k=rng.choice([2, 300, 3000])))
        assert bpe._merge_folded(table.byte[np.frombuffer(piece, np.uint8)], table).tolist() == coder.encode_ordinary(piece.decode())


def test_token_columns_may_clash(documents, ranks):
    df = documents([(1, "hello there")])
    more = df.selectExpr("*", "1 AS n_tokens", "2 AS ids_sha256", "3 AS decoded_sha256", "4 AS ids", "5 AS n")
    assert bpe.roundtrip_digest(more, ranks, P.PATTERN).collect() == bpe.roundtrip_digest(df, ranks, P.PATTERN).collect()
    path = P.path("word_bpe_49k.json")
    more = df.selectExpr("*", "1 AS start", "2 AS n_tokens", "3 AS ids_crc32", "4 AS ids", "5 AS part")
    assert tokenbin.written_digest(more, path).collect() == tokenbin.written_digest(df, path).collect()


def test_encode_and_decode(spark, documents, ranks):
    df = documents([(1, "hello there"), (2, None)])
    back = {r.doc_id: bytes(r.text_bytes) for r in bpe.decode(bpe.encode(df, ranks, P.PATTERN), ranks).collect()}
    assert back == {1: b"hello there", 2: b""}
    assert bpe.roundtrip_digest(documents([]), ranks, P.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 7000])
@pytest.mark.parametrize("top", [2, 700, 65536])
def test_blocks_come_back(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n)
    blocks, sums = tokenbin.encode_blocks(ids)
    assert (tokenbin.decode_blocks(blocks, sums, n) == ids).all()


def test_repetitive_ids_get_small():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_000, 40), 300)
    blocks, _ = tokenbin.encode_blocks(ids)
    assert sum(map(len, blocks)) < len(ids)


def test_a_broken_block_is_noticed():
    ids = np.random.default_rng(5).integers(0, 3000, 3000)
    blocks, sums = tokenbin.encode_blocks(ids)
    bad = bytearray(blocks[1])
    bad[30] ^= 4
    with pytest.raises(ValueError, match="block 1"):
        tokenbin.decode_blocks([blocks[0], bytes(bad), blocks[2]], sums, len(ids))


def test_files_hold_the_librarys_ids(spark, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = corpus(5) + [r for r in ODD if r[0] != 7] + [(7, "same"), (7, "same")]
    rows = [(i + 10_000 * (t == "twice under one id"), t) for i, t in rows]
    got = tokenbin.written_digest(documents(rows), P.path("word_bpe_49k.json")).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    drop = lambda rs: collections.Counter(r for r in rs if r[0] not in (1, 7))  # noqa: E731  ids of several rows: their order is free
    assert drop(map(tuple, got)) == drop(want)
    assert tokenbin.written_digest(documents([]), P.path("word_bpe_49k.json")).count() == 0


def test_words_are_looked_up_once_and_have_the_librarys_ids():
    import pyarrow as pa

    words = tokenbin._Words(P.path("word_bpe_49k.json"))
    texts = ["don't. x's, ’s. É. É, İ. क़. Σ, ΑΣ. ﬁ. Å. ... ,. a.. a., ,a .b", "<|endoftext|>a á. e\u0301. a\xa0b. 한. ab\tcd. \x1cx. KK. ß. ǅ, ½.", None, "", " ", "it's' THE!!&&& the== ª. º, ʰ. ͅ. ŉ. привет, ЁЖ: λόγος; a1. 漢."]
    texts += [t for _, t in corpus(3)]
    want = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time every word is known
        ids, sizes = words.ids(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert tokenbin._words(P.path("word_bpe_49k.json")) is tokenbin._words(P.path("word_bpe_49k.json"))  # kept from task to task


def test_slices_with_more_words_than_are_kept(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokenbin, "CACHE_WORDS", 7)
    words = tokenbin._Words(P.path("word_bpe_49k.json"))
    for text in ["one two three", "four five six seven eight", " ".join(f"w{i}" for i in range(30)), "one w3 nine"]:
        ids, sizes = words.ids(pa.array([text, None, "one."]))
        want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "", "one.")]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


def test_words_that_differ_by_case_and_marks_are_one_lookup():
    import pyarrow as pa

    words = tokenbin._Words(P.path("word_bpe_49k.json"))
    texts = ["Straße straße. STRAßE, x", "straßE! Привет привет?? ПРИВЕТ.", "straße... x."]
    ids, _ = words.ids(pa.array(texts))
    assert ids.tolist() == [x for t in texts for x in words.tokenizer.encode(t, add_special_tokens=False).ids]
    assert sorted(words.memo) == sorted(["straße", "x", "привет", ".", ",", "!", "??", "..."])


def test_letters_that_the_model_is_asked_for_have_the_librarys_ids():
    import pyarrow as pa

    words = tokenbin._Words(P.path("word_bpe_49k.json"))
    letters = list(map(chr, range(0x80, 0x600)))
    texts = [form.format(c) for c in letters for form in ("{0}", "x{0}y.", "{0}{0}!", "A{0}", "{0}\u0301e,")]
    ids, sizes = words.ids(pa.array(texts))
    want = [x.ids for x in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_frequencies_of_every_context_sum_up_to_a_power_of_two():
    model = tokenbin._Model(3)
    model.seen[:] = np.random.default_rng(2).integers(0, 64, model.seen.shape)
    model.seen[:, 3], model.seen[4, 3] = 0, 1000
    model.refresh()
    of_each = np.diff(model.run[: tokenbin._SYMBOLS + 1].astype(int), axis=0)
    assert (of_each > 0).all() and (of_each.sum(0) == 1 << tokenbin._SCALE).all()
