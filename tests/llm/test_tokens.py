import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.bpe_stream import Bpe, Decoder, bpe_digests, bpe_round_trip, digests, lookahead
from plumbline.llm.common import tokenizer_path
from plumbline.llm.packing import ByteLevelIds, merge_windows, pack
from plumbline.llm.token_counts import _load, pretokens, token_counts

ODD = ["", " ", "  ", "a", " a b", "a  b ", "\n\n", "naïve Ünïcode ΣΑΣ", "x<|endoftext|>y <|startoftext|>", "日本語 テキスト", "▁a▁▁b", "it's we'll I'M", "é ﬁ", "12345 1a2b", "!!??...", "a\x00b", " x\x85y　z", "🙂👍🏽 ok", "a" * 3000, "<s>[INST]</s>"]
words = st.text(alphabet=st.sampled_from(list("abcdeinorstuyABEΣßéö '\n\t .,!?<|>▁0129🙂日́")), max_size=80)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


BPE = Bpe(tokenizer_path("word_bpe_49k.json"))
SP = _load(tokenizer_path("piece_bpe_32k.model"))


def ids(bpe, text):
    return list(memoryview(bpe.encode(text)).cast("I"))


@settings(max_examples=300, deadline=None)
@given(st.one_of(words, st.text(max_size=60)))
def test_bpe_equals_library(text):
    from tokenizers import Tokenizer

    if not hasattr(test_bpe_equals_library, "t"):
        test_bpe_equals_library.t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    expected = test_bpe_equals_library.t.encode(text, add_special_tokens=False).ids
    assert ids(BPE, text) == expected
    assert BPE.decode(BPE.encode(text)) == test_bpe_equals_library.t.decode(expected, skip_special_tokens=False)


def test_streaming_of_long_words_keeps_little(library):
    rng = random.Random(1)
    small = Bpe(tokenizer_path("word_bpe_49k.json"), block=64)
    for alphabet in ("ab", "thein", "aaab", "nio"):
        word = "".join(rng.choice(alphabet) for _ in range(20_000))
        assert ids(small, word) == library.encode(word, add_special_tokens=False).ids
    assert small.ahead < 10_000


def bounds(bpe, word):
    at, out = 0, []
    for token in bpe.merged(list(word)):
        at += len(token)
        out.append(at)
    return out


def test_lookahead_is_sufficient_for_random_merge_lists():
    rng = random.Random(1)
    for t in range(120):
        tokens, merges = list("ab" if t % 2 else "abc"), []
        for _ in range(rng.choice([2, 3, 5, 8, 14])):
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair not in merges and len(pair[0] + pair[1]) <= 6:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        small = object.__new__(Bpe)
        small.ranks, ahead = {m: i for i, m in enumerate(merges)}, lookahead(merges)
        for _ in range(3):
            word = [rng.choice(tokens[:2]) for _ in range(rng.choice([1, 2, 3, 5, 80]))] * 80
            word = word[:80]
            whole = set(bounds(small, word))
            for cut in range(1, 80):
                assert {x for x in bounds(small, word[:cut]) if x <= cut - ahead} == {x for x in whole if x <= cut - ahead}


def test_ids_and_text_come_in_pieces(library):
    text = " ".join(f"naïve wörd {i} 日本 <|endoftext|>" for i in range(3000))
    ids_ = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    want = len(ids_), hashlib.sha256(ids_.tobytes()).hexdigest(), hashlib.sha256(library.decode(ids_.tolist(), skip_special_tokens=False).encode()).hexdigest()
    assert digests(BPE, text, chunk=7) == digests(BPE, text) == want
    decoder = Decoder(BPE, readable=True)
    readable = "".join(decoder.feed(ids_[i : i + 1].tobytes()) for i in range(len(ids_))) + decoder.end()
    assert readable == BPE.text(ids_.tobytes()) and "naïve wörd 2 9 9 9 日本" in readable


def test_bpe_queries(spark, library):
    texts = [*ODD, None]
    got = {r.doc_id: r for r in bpe_digests(docs_of(spark, texts), tokenizer_path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(e), t
        assert got[i].ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()
    trip = {r.doc_id: r for r in bpe_round_trip(docs_of(spark, texts), tokenizer_path("word_bpe_49k.json")).collect()}
    assert BPE.text(bytes(trip[9].ids)).strip() == "日本語 テキスト"
    assert bpe_digests(docs_of(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_bpe_query_on_long_and_repeated_rows(spark, library):
    texts = ["ab" * 6000 + " x", "ab" * 6000 + " x", "word " * 20_000, "é" * 5000]
    rows = [(7, t, "x") for t in texts]
    got = bpe_digests(spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string"), tokenizer_path("word_bpe_49k.json")).collect()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted((r.n_tokens, r.ids_sha256) for r in got) == sorted((len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()) for e in want)


@settings(max_examples=300, deadline=None)
@given(st.one_of(words, st.text(max_size=60)))
def test_pretokens_add_up(text):
    assert sum(len(SP.encode(p)) if p else 1 for p in pretokens(text)) == len(SP.encode(text))


def test_frequent_pretokens_fit_the_bound(spark, monkeypatch):
    """What reaches the driver is at most `head` rows, whatever the ties."""
    sent = []
    real = type(spark.range(1)).toPandas
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda df: sent.append(real(df)) or sent[-1])
    texts = [" ".join(f"w{j}" for j in range(i % 50, 60)) for i in range(200)]
    token_counts(docs_of(spark, texts), tokenizer_path("piece_bpe_32k.model"), head=20).collect()
    assert 0 < len(sent[-1]) <= 20 and len(sent[0]) < 100


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_token_counts(spark, head):
    texts = [*ODD, None, *ODD, "word " * 5000]
    got = {r.doc_id: r for r in token_counts(docs_of(spark, texts).repartition(3), tokenizer_path("piece_bpe_32k.model"), head=head or 1).collect()}
    for i, t in enumerate(texts):
        n = len(SP.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts(docs_of(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(words, st.text(max_size=60)))
def test_byte_level_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(test_byte_level_ids, "t"):
        test_byte_level_ids.t = (Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), ByteLevelIds(tokenizer_path("byte_bpe_50k.json")))
    slow, own = test_byte_level_ids.t
    assert own.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_merge_windows():
    at = merge_windows([1000, 1000, 48, 2000, 5], 2048)
    ends = {}
    for (head, shift), used in zip(at, [1000, 1000, 48, 2000, 5], strict=True):
        ends.setdefault(head, []).append((shift, used))
    for parts in ends.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 2048
    assert len(ends) == 2


def test_pack(spark):
    import zlib

    rng = random.Random(2)
    texts = [*ODD, None, *(" ".join(rng.choice(["alpha", "beta", "the", "of"]) for _ in range(rng.choice([3, 300, 900, 5000]))) for _ in range(120))]
    own = ByteLevelIds(tokenizer_path("byte_bpe_50k.json"))
    rows = pack(docs_of(spark, texts).repartition(4), tokenizer_path("byte_bpe_50k.json"), open_windows=4).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        e, at = np.append(own.encode(t or ""), 1).astype("<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(e) and bytes(r.ids) == e[at : at + r.length].tobytes() and r.ids_crc32 == zlib.crc32(bytes(r.ids))
            at += r.length
        assert at == len(e)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.padded == (at if at & (at - 1) == 0 else 2048) for r in parts)
    used, padded = sum(r.length for r in rows), sum(p[0].padded for p in by_seq.values())
    assert used / padded > 0.9
    assert pack(docs_of(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0
