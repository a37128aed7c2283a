import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import suffix_dedup
from plumbline.llm.suffix_dedup import BYTES, LENGTH, WORDS, multikey_order, remove_repeats, without_repeats


def plain(texts):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - LENGTH + 1):
            if counts[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        rest = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def plain_of_both(texts, words_only=False):
    """Bytes of repeated strings of 400 bytes and of repeated runs of 51 words, by all windows."""
    raws = [(t or "").encode() for t in texts]
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raws]
    runs = [[tuple(r[a:b] for a, b in w[i : i + 51]) for i in range(len(w) - 50)] for r, w in zip(raws, words, strict=True)]
    in_words = Counter(x for run in runs for x in run)
    in_bytes = Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r, w, run in zip(raws, words, runs, strict=True):
        spans = [(w[i][0], w[i + 50][1]) for i, x in enumerate(run) if in_words[x] > 1]
        spans += [] if words_only else [(i, i + LENGTH) for i in range(len(r) - LENGTH + 1) if in_bytes[r[i : i + LENGTH]] > 1]
        gone = bytearray(len(r))
        for a, b in spans:
            gone[a:b] = b"\x01" * (b - a)
        rest = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(rest).hexdigest()))
    return out


def corpus_of_words(seed):
    rng = random.Random(seed)

    def words(n):
        return [rng.choice(["a", "of", "the", "é", "tion", "wörter", "x" * 12]) + str(rng.randrange(40)) for _ in range(n)]

    shared = [words(n) for n in (30, 49, 50, 51, 52, 60, 75, 130, 400)]
    texts = ["", None, "x", " ".join(["z"] * 400), "zz " * 700, " ".join(words(51)), "\n".join(words(90)), "w" * 900]
    for _ in range(60):
        text = words(rng.randrange(150))
        for _ in range(rng.randrange(4)):
            text += rng.choice(shared)[rng.choice([0, 0, 2, 20]) :] + words(rng.randrange(80))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", " \t "]) for w in text))
    return texts + [texts[-1]] * 3 + ["q " + texts[-2][:-30], "w" * 500 + " end"]


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return "".join(rng.choice("abcdefgh é\nüß") for _ in range(n))

    shared = [words(n) for n in (250, 395, 399, 400, 401, 420, 700, 2500)]
    texts = ["", None, "x", "a" * 399, "a" * 400, "b" * 3000, "ab" * 900, words(500)]
    for _ in range(70):
        text = words(rng.randrange(10, 900))
        for _ in range(rng.randrange(4)):
            text += rng.choice(shared)[rng.choice([0, 0, 3, 50]) :] + words(rng.randrange(300))
        texts.append(text)
    texts += [texts[-1]] * 5 + [texts[-2][:-40] + words(40), words(90) + texts[-3][100:]]
    line = words(60) + "\n"
    texts.append(line * 40 + words(30) + line * 8)
    return texts


@pytest.mark.parametrize(("seed", "partitions"), [(0, 1), (1, 5), (2, 16)])
def test_remove_repeats(spark, seed, partitions):
    texts = corpus(seed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(partitions)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame).collect()}
    assert got == dict(enumerate(plain(texts)))


@pytest.mark.parametrize(("seed", "partitions", "units"), [(0, 1, (BYTES, WORDS)), (1, 7, (BYTES, WORDS)), (2, 4, (WORDS,))])
def test_runs_of_words_go_too(spark, seed, partitions, units):
    """Runs of over 50 words, however few bytes they have and whatever stands between the words; both rules judge the input."""
    texts = corpus_of_words(seed)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame, units=units).collect()}
    want = plain_of_both(texts, words_only=units == (WORDS,))
    assert got == dict(enumerate(want)) and want != plain(texts)


def test_many_buckets(spark):
    texts = corpus(4)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == dict(enumerate(plain(texts)))


def test_rows_stay_whole(spark):
    body = "".join(random.Random(3).choice("abcdé ") for _ in range(600))
    frame = spark.createDataFrame([(1, "q" + body, "en", "s", 9), (2, body + "zü", None, "s", 9), (2, body + "zü", None, "s", 9), (None, None, "x", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = without_repeats(frame)
    assert rows.columns == frame.columns
    assert sorted(((r.doc_id or 0), r.text, r.lang, r.n_chars) for r in rows.collect()) == [(0, "", "x", 0), (1, "q", "en", 1), (2, "", None, 0), (2, "", None, 0)]
    assert remove_repeats(frame.limit(0)).count() == 0


def test_very_long_text(spark):
    """Texts of some hundred thousand bytes, one a repeat of one character, one with passages of the others."""
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh é\n") for _ in range(200_000))
    texts = [long, "z" * 60_000, "q" + long[1000:1900] + "zü" * 300 + long[150_000:150_395] + "w" * 401, long[:500], "short", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_many_equal_rows(spark):
    """100,000 rows equal in id and text are cut alike, and no range holds all of their suffixes."""
    rng = random.Random(8)
    text, other = ("".join(rng.choice("abcdefgh ") for _ in range(450)) for _ in range(2))
    same = spark.range(0, 100_000, 1, 100).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    frame = same.union(spark.createDataFrame([(2, text[20:] + other), (3, other[:399])], "doc_id long, text string"))
    want = plain([text, text, text[20:] + other, other[:399]])[1:]
    got = remove_repeats(frame).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
    assert {(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256), r["count"]) for r in got} == {(i + 1, w, 100_000 if not i else 1) for i, w in enumerate(want)}
    rows = frame.select(F.col("doc_id").alias("key"), "text").mapInArrow(suffix_dedup._suffixes, suffix_dedup._ROWS)
    held = [r["count"] for r in suffix_dedup.ranged(rows, 0).groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) >= 6 and max(held) < sum(held) / 3


def test_order_is_that_of_suffixes():
    """Texts equal in their first eight bytes and more are told apart by the next ones."""
    raws = [b"a" * 31 + bytes([c]) + b"x" * 500 for c in (9, 255, 7, 128, 127, 0)]
    block = suffix_dedup.Block(raws)
    order = multikey_order(suffix_dedup.leading(block, block.starts))
    assert [raws[i] for i in order] == sorted(raws)


def test_multikey_order():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 3, 500) for _ in range(4)]
    order = multikey_order(columns)
    rows = list(zip(*columns, strict=True))
    assert [rows[i] for i in order] == sorted(rows)
