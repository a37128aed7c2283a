import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat_format, quality_classifier, quality_rules, syncmers, warc_audit
from plumbline.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = ["", " \n\t", "a", "a b c d", "x " * 120, "The The The The", "ünï # | <b> $5 & 100%", "line\nline\n\n \nline", "k" * 100_000, "日本語 テキスト です。" * 9]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é#|\n\t\x0b　\x1c")), max_size=60))
def test_statistics(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = text.split("\n")
    dups = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
    expected = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered))
    assert quality_rules.rule_statistics(text)[0] == expected


def test_quality_rules(spark):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    got = quality_rules.quality_rules(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.95
    assert judged[judged.quality == 0].kept.mean() < 0.3
    assert not got[got.base_failed].kept.any()
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality_rules.quality_rules(docs, labels).filter("kept").count()


def test_rules_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None, *ODD])], "doc_id long, text string, kept string")
    none = spark.createDataFrame([], "doc_id long, quality long")
    rows = quality_rules.quality_rules(docs, none).collect()
    assert len(rows) == len(ODD) * 2 + 1 and all(r.kept != r.base_failed for r in rows)
    assert quality_rules.quality_rules(docs.limit(0), none).count() == 0
    scores = quality_classifier.quality_scores(docs, none).collect()
    assert len(scores) == len(rows) and {r.score for r in scores} == {0.5}


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    fm = quality_classifier.FactorisationMachine()
    fm.w[:] = rng.normal(size=fm.w.shape)
    at, x = np.array([3, 8, 11, 400]), rng.normal(size=4).astype(np.float32)
    slow = fm.b + fm.w[at] @ x + sum(fm.v[at[i]] @ fm.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert fm.raw([(at, x)])[0] == pytest.approx(slow, rel=1e-4)


def plain_features(text):
    """Bucket to value, by definition."""
    words = [w for w in __import__("re").split(b"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    tf = {}
    for w in words:
        k = zlib.crc32(w) % quality_classifier.BUCKETS
        tf[k] = tf.get(k, 0) + 1
    tf = {k: math.log1p(n) for k, n in tf.items()}
    norm = math.sqrt(sum(v * v for v in tf.values())) or 1.0
    out = {k: v / norm for k, v in tf.items()}
    for i, v in enumerate(quality_rules.rule_statistics(text or "")[1]):
        out[quality_classifier.BUCKETS + i] = min(max(v * quality_classifier.SCALES[i], 0), 3)
    out[quality_classifier.BUCKETS + quality_rules.N_FEATURES + min(int(2 * math.log1p(len(text or ""))), quality_classifier.LENGTHS - 1)] = 1.0
    return out


def plain_raw(fm, x):
    """All pairs of features, one by one."""
    items = list(x.items())
    pairs = sum(float(fm.v[i] @ fm.v[j]) * a * b for n, (i, a) in enumerate(items) for j, b in items[:n])
    return fm.b + sum(float(fm.w[i]) * a for i, a in items) + pairs


def test_trained_scores_equal_all_pairs_on_odd_rows(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    texts = [*ODD, None, "word " * 30_000, "same text twice", "same text twice"]
    odd = spark.createDataFrame([(10**6 + i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    frame = docs.unionByName(odd).selectExpr("doc_id", "text", "'x' score", "'y' held_out", "'z' predicted", "'q' quality")
    machine = quality_classifier.train(frame, labels)
    got = quality_classifier.quality_scores(frame, labels).filter("doc_id >= 1000000").collect()
    want = sorted(1 / (1 + math.exp(-(plain_raw(machine, plain_features(t)) + machine.shift))) for t in texts)
    assert sorted(r.score for r in got) == pytest.approx(want, abs=1e-4)
    assert all(r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    kept = quality_classifier.keep_predicted(frame, labels)
    assert kept.columns == frame.columns and kept.filter("doc_id >= 1000000").count() == sum(r.predicted for r in got)
    assert quality_classifier.keep_predicted(frame.limit(0), labels).count() == 0


def test_training_equals_plain_steps():
    texts, y = ["a b c", "a b d d", "x y | z", "x # y", "b c a a", "z z y"], np.array([1.0, 1, 0, 0, 1, 0])
    rows = [quality_classifier.Features()(t) for t in texts]
    got = quality_classifier.FactorisationMachine().fit(rows, y, epochs=2, batch=2)
    fm = quality_classifier.FactorisationMachine()
    w, v, b = np.zeros_like(fm.w, float), fm.v.astype(float), 0.0
    gb, gw, gv = 1e-6, np.full(w.shape, 1e-6), np.full(v.shape, 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(2):
        order = rng.permutation(6)
        for k in range(0, 6, 2):
            dw, dv, db, used = np.zeros_like(w), np.zeros_like(v), 0.0, set()
            for r in order[k : k + 2]:
                x = dict(zip(rows[r][0].tolist(), rows[r][1].astype(float).tolist(), strict=True))
                z = b + sum(w[i] * a for i, a in x.items()) + sum(v[i] @ v[j] * x[i] * x[j] for i in x for j in x if i < j)
                g = (1 / (1 + math.exp(-z)) - y[r]) / 2  # both labels are equally frequent
                db += g
                for i in x:
                    used.add(i)
                    dw[i] += g * x[i]
                    dv[i] += g * x[i] * sum(v[j] * x[j] for j in x if j != i)
                    if x[i]:
                        dv[i] += 0
            at = sorted(used)
            dw[at] += 1e-5 * w[at]
            dv[at] += 1e-5 * v[at]
            gb, gw[at], gv[at] = gb + db**2, gw[at] + dw[at] ** 2, gv[at] + dv[at] ** 2
            b -= 0.08 * db / math.sqrt(gb)
            w[at] -= 0.08 * dw[at] / np.sqrt(gw[at])
            v[at] -= 0.04 * dv[at] / np.sqrt(gv[at])
    for row, t in zip(rows, texts, strict=True):
        x = dict(zip(row[0].tolist(), row[1].tolist(), strict=True))
        fm.w, fm.v, fm.b = w, v, b
        assert got.raw([row])[0] == pytest.approx(plain_raw(fm, x), rel=0.02, abs=0.02), t


def test_forest_scores_equal_walks():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    forest = quality_rules.IsolationForest(x, np.ptp(x, axis=0), trees=20, rows=64)
    odd = np.vstack([x[:20], rng.normal(size=(5, 4)) * 9])

    def depth(tree, row):
        f, cut, left, path = tree
        at = 0
        while np.isfinite(cut[at]):
            at = left[at] + (row[f[at]] > cut[at])
        return path[at]

    mean = np.array([np.mean([depth(t, r) for t in forest.trees]) for r in odd])
    assert forest.scores(odd) == pytest.approx(2.0 ** (-mean / float(quality_rules.average_path(64))))
    assert forest.scores(odd)[20:].mean() > forest.scores(odd)[:20].mean()


def test_forest_and_threshold_count_all_labelled_rows(spark):
    words = F.transform(F.sequence(F.lit(1), 60 + F.pmod(F.xxhash64("doc_id"), F.lit(90)).cast("int")), lambda i: F.substring(F.md5(F.concat_ws("-", "doc_id", i)), 1, 1 + i % 9))
    docs = spark.range(12_000).select(F.col("id").alias("doc_id")).select("doc_id", F.array_join(words, " ").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = quality_rules.quality_rules(docs, labels).toPandas()
    assert not got.base_failed.any()
    assert (got.kept == (got.anomaly <= np.quantile(got.anomaly, 0.99, method="higher"))).all()
    again = quality_rules.quality_rules(docs.repartition(3), labels.repartition(5)).toPandas()
    assert got.sort_values("doc_id").anomaly.tolist() == again.sort_values("doc_id").anomaly.tolist()


def test_nodes_add_up_over_parts():
    x = np.random.default_rng(5).normal(size=(500, 3))
    forest, tree = quality_rules.IsolationForest(x, np.ptp(x, axis=0), trees=4, rows=100), np.arange(500) % 4
    for depth in range(forest.depth + 1):
        whole = {(t, i): (n, low, high) for t, i, n, low, high in zip(*forest.held(x, tree, depth), strict=True)}
        parts = {}
        for at in range(0, 500, 77):
            for t, i, n, low, high in zip(*forest.held(x[at : at + 77], tree[at : at + 77], depth), strict=True):
                m, a, b = parts.get((t, i), (0, np.inf, -np.inf))
                parts[t, i] = (m + n, min(a, low), max(b, high))
        assert parts == whole


def test_parts_of_every_kind_in_a_query(spark):
    from plumbline.llm import queries as llm

    rows = llm.chat_content_parts(spark, SF).collect()
    assert rows and all(r.placeholders == r.n_attachments for r in rows) and {r.kinds for r in rows} >= {"", "image", "image,audio", "image,document"}


def test_classifier_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    labels = table(spark, sf, "labels")
    got = quality_classifier.quality_scores(table(spark, sf, "documents"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    out = got[got.held_out]
    assert len(out) > 500 and (out.predicted == out.quality).mean() > 0.97


@given(st.text(alphabet=st.sampled_from(list("\\n<s>/[INST]imageé\n ")), max_size=40), st.text(max_size=12))
def test_escape_is_reversible(text, role):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert not any(c in chat_format.escape(text) for c in chat_format.CONTROLS)
    segment, start, length, _ = chat_format.render(role, [{"kind": "text", "text": text}], chat_format.Visitor())
    assert chat_format.parse(segment) == (role, text)
    assert (chat_format.unescape(segment[start : start + length]) == text) if role == "assistant" else length == 0


def test_parts_become_placeholders():
    parts = [{"kind": "text", "text": "see <image>"}, {"kind": "image", "ref": "a.png", "width": 28, "height": 30}, {"kind": "audio", "ref": "b.wav", "seconds": 1.5}, {"kind": "document", "ref": "c.pdf", "pages": 3}]
    body, attachments = chat_format.Visitor().flatten(parts)
    assert body == "see <\\image><image><audio><document>"
    assert attachments == [(0, "image", "a.png", 6), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1536)]


def test_chat_digests(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", None), (1, 1, "assistant", "é\\n"), (1, 1, "assistant", "é\\n"), (2, None, None, "x"), (None, 0, "user", "y"), *((3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)), *((4, i, role, "</s>é [INST]" * 40_000) for i, role in enumerate(("user", "assistant")))]
    rng = random.Random(0)
    frame = spark.createDataFrame([(*r, 1, "p", "s", 2) for r in rng.sample(rows, len(rows))], "conv_id long, turn long, role string, text string, start int, segment string, parts string, length int").repartition(5)
    turns = chat_format.format_turns(chat_format.as_parts(frame))
    got = {r.conv_id: r for r in chat_format.digests(turns).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1]))
        loss = "".join(r[3] for r in mine if r[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = "".join(r.segment for r in turns.filter("conv_id = -7").orderBy("start").collect())
    assert len(whole) == got[-7].formatted_chars and whole.count("[INST]") == 1
    assert chat_format.digests(chat_format.format_turns(chat_format.as_parts(frame.limit(0)))).count() == 0


def test_warc_audit(spark):
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", "é" * rng.randrange(50)) for i in [*range(0, 9000, 7), *range(500, 504), 500, 500]]
    left = warc_audit.to_records(spark.createDataFrame([*pages, (None, "u", "h")], "page_id long, url string, html string"))
    gone, hurt = {700, 8995}, {500, 504, 4095 // 7 * 7}
    right = warc_audit.to_records(spark.createDataFrame([(i, u, ("X" + h if i in hurt else h)) for i, u, h in pages if i not in gone] + [(20_000, "u", None)], "page_id long, url string, html string"))
    got = {r.key: r for r in warc_audit.audit(left, right).collect()}
    assert {k for k, r in got.items() if r.status != "ok"} == {k for k in gone | hurt if k in {p[0] for p in pages}} | {20_000}
    assert got[20_000].status == "extra" and got[700].status == "missing" and got[500].copies == 3 and got[504].status == "corrupt"
    sizes = {r["key"]: len(r["record"]) for r in left.dropDuplicates(["key"]).collect()}
    at = {}
    for k in sorted(sizes):
        assert got[k].offset == at.get(k // 4096, 0)
        assert got[k].copies > 1 or got[k].bytes == sizes[k]
        at[k // 4096] = got[k].offset + got[k].bytes
    assert warc_audit.audit(left.limit(0), right.limit(0)).count() == 0


def test_warc_audit_of_odd_rows(spark):
    """Null url and html, negative and very large keys, other columns with the operator's own names."""
    big = 2**60
    rows = [(-1, None, None), (-4097, "u", ""), (big, "u", "h"), (big + 1, "u", "h"), (big + 1, "u", "h")]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, node string, digest string, archive string")
    records = warc_audit.to_records(frame)
    got = {r.key: r for r in warc_audit.audit(records, warc_audit.to_records(frame.filter("page_id <> -1"))).collect()}
    assert {k: r.status for k, r in got.items()} == {-1: "missing", -4097: "ok", big: "ok", big + 1: "ok"}
    assert (got[-1].archive, got[-4097].archive, got[big].archive) == (-1, -2, big // 4096) and got[big + 1].offset == got[big].bytes and got[big + 1].copies == 2


def plain_audit(left, right):
    """Status and found offset by comparing all records of each key: (archive, key, offset, record) rows."""
    out = {}
    for key in {r[1] for r in left + right}:
        a, b = (Counter((*r[:1], r[2], r[3]) for r in rows if r[1] == key) for rows in (left, right))
        content = [Counter(x[2] for x in c.elements()) for c in (a, b)]
        gone, new = a - b, b - a
        if not gone and not new:
            out[key] = ("ok", None)
        elif not a:
            out[key] = ("extra", None)
        elif content[0] == content[1]:
            out[key] = ("moved", min(x[1] for x in new))
        else:
            out[key] = ("corrupt" if b else "missing", None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_warc_audit_of_observed_offsets(spark, seed):
    """Records swapped, sent far off or to another archive, damaged, dropped, doubled and added; one replica written anew without a record."""
    rng = random.Random(seed)
    left, at = [], Counter()
    for key in range(700):
        for _ in range(rng.choice([1, 1, 1, 3])):
            record = bytes(rng.randrange(97, 100) for _ in range(rng.choice([1, 40, 3000])))
            left.append((key // 300, key, at[key // 300], record))
            at[key // 300] += len(record)
    right = list(left)
    for i in rng.sample(range(len(right) - 1), 12):
        a, b = right[i], right[i + 1]
        right[i], right[i + 1] = (*b[:2], a[2], b[3]), (*a[:2], b[2], a[3])
    for i in rng.sample(range(len(right)), 40):
        archive, key, offset, record = right[i]
        right[i] = rng.choice([(archive, key, offset + 2**33, record), (archive + 1, key, offset, record), (archive, key, offset, record[:-1] + b"X"), None, None]) or right[i][:1] + (10_000 + i,) + right[i][2:]
    right = [r for r in right if rng.random() > 0.01] + right[5:6]
    anew, place = [], Counter()
    for archive, key, _, record in left:
        if key != 350:
            anew.append((archive, key, place[archive], record))
            place[archive] += len(record)
    frame = lambda rows: warc_audit.observed(spark.createDataFrame([(*r, "x") for r in rows], "archive long, key long, offset long, record binary, sha string").repartition(5))
    for other in (right, anew):
        got = {r.key: (r.status, r.found_offset) for r in warc_audit.audit(frame(left), frame(other)).collect()}
        assert got == plain_audit(left, other)
    assert len({s for s, _ in plain_audit(left, right).values()}) == 5
    assert {k: s[0] for k, s in plain_audit(left, anew).items() if s[0] != "ok" and k < 351 or k > 599 and s[0] != "ok"} == {350: "missing"}


def test_warc_audit_of_a_hot_key(spark):
    """A third of all records under one key, of which one is damaged; records without an offset."""
    rows = [(5, "u", f"text {i}") for i in range(6000)] + [(i, "u", "h") for i in range(10, 12_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    left = warc_audit.lay_out(warc_audit.to_records(pages))
    right = left.withColumn("sha", F.when(F.expr("archive = 0 and offset = 0"), F.reverse("sha")).otherwise(F.col("sha")))
    ends = left.filter("archive = 0").selectExpr("max(offset + bytes * copies)", "sum(bytes * copies)", "count(distinct offset)", "count(*)").first()
    assert ends[0] == ends[1] and ends[2] == ends[3]
    got = {r.key: r for r in warc_audit.audit(left, right).filter("status <> 'ok'").collect()}
    assert {k: (r.status, r.copies) for k, r in got.items()} == {5: ("corrupt", 6000)}
    lost = left.withColumn("offset", F.when(F.col("key") % 5000 != 11, F.col("offset")))
    got = {r.key: (r.status, r.found_offset) for r in warc_audit.audit(left, lost).filter("status <> 'ok'").collect()}
    assert got == {k: ("moved", -1) for k in (11, 5011, 10_011)}


def test_syncmers(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "é", "of", "the", "to"]
    texts = [*ODD, None, *(" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.choice([4, 60, 300, 4000]))) for _ in range(60))]
    frame = spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(6)
    got = {r.doc_id: r for r in syncmers.fingerprints(frame).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        r = got[3 * i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if i > len(ODD) + 1 and len(t) > 100:
            assert r.near_edited > 0.35 and r.near_next < 0.2
    assert syncmers.fingerprints(frame.limit(0)).count() == 0
    plan = syncmers.fingerprints(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_units(word):
    units, at = [], ""
    for c in word:
        at += c
        if ord(c) >= 128 or ord(c) % 6 == 1 or len(at) == 12:
            units.append(at)
            at = ""
    return [*units, at] if at else units


@pytest.mark.parametrize("alphabet", ["的一是不了人我在有他这中大来上个国", "абвгдежзийклмн", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGH(){};=+", "\U0001f600\U0001f601\U0001f923é"])
def test_anchors_are_context_free_without_spaces(spark, alphabet):
    """One code point dropped at the start or put in the middle of an unspaced text moves few anchors."""
    rng = random.Random(8)
    text = "".join(rng.choice(alphabet) for _ in range(2000))
    rows = [(1, text), (2, text[1:]), (3, text), (4, text[:1000] + "x" + text[1000:]), (5, text)]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].near_next >= 0.9 for i in (1, 2, 3, 4)) and got[1].fingerprint == got[3].fingerprint


@pytest.mark.parametrize("names", [("x", "both_x"), ("c", "i")])
def test_likeness_of_columns_of_any_name(spark, names):
    a, b = names
    row = spark.createDataFrame([([1, 2], [2, 3])], f"{a} array<long>, {b} array<long>").select(syncmers.likeness(a, b).alias("v")).first()
    assert row.v == pytest.approx(1 / 3)


def test_syncmers_by_definition(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcé日xz") for _ in range(rng.choice([1, 3, 4, 5, 9]))) for _ in range(300))
    units = [u for w in text.split(" ") for u in plain_units(w)]
    row = syncmers.syncmer_columns(spark.createDataFrame([(text,)], "t string"), "t", "own").first()
    inner = sorted({tuple(units[i : i + 3]) for i in range(len(units) - 2)})
    h = {(r.a, r.b, r.c): r.h for r in spark.createDataFrame(inner, "a string, b string, c string").select("*", F.xxhash64("a", "b", "c").alias("h")).collect()}
    s = [h[tuple(units[i : i + 3])] for i in range(len(units) - 2)]
    chosen = [i for i in range(len(units) - 6) if min(s[i], s[i + 4]) <= min(s[i + 1 : i + 4])]
    assert list(row.own_places) == chosen
    spans = spark.createDataFrame([(i, s[i], s[i + 3], s[i + 4]) for i in chosen], "i long, a long, b long, c long").select("i", F.xxhash64("a", "b", "c").alias("h"))
    assert list(row.own_anchors) == [r.h for r in spans.orderBy("i").collect()]


def test_likeness_is_of_all_anchors_and_near_copies_are_near_at_any_length(spark):
    rng = random.Random(6)
    pairs = []
    for n in (12, 20, 60, 66, 400, 5000):
        words = [f"w{rng.randrange(10**4)}" for _ in range(n)]
        pairs.append((" ".join(words), " ".join(words[:-2])))
    letters = "".join(rng.choice("日本語文章例題") for _ in range(405))
    pairs.append((letters, letters[:395]))
    rows = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprints(frame).collect()}
    sets = {}
    for r in syncmers.anchors(frame).collect():
        sets.setdefault(r.doc_id, set()).add(r.anchor)
    for i in range(len(rows)):
        a, b = sets[i], sets[(i + 1) % len(rows)]
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b))
        assert got[i].fingerprint == "".join(f"{x % 2**64:016X}" for x in sorted(a))
    assert all(got[2 * i].near_next > 0.6 for i in range(len(pairs)))
    assert all(0.4 < got[2 * i].aligned_edited < 0.9 for i in range(2, len(pairs)))
    fallen = spark.createDataFrame([(1, pairs[2][0]), (2, "z" * 10)], "doc_id long, text string")  # the edited text of 1 is shorter
    assert syncmers.fingerprints(fallen).filter("doc_id = 1").first().near_edited > 0.5
    empty = spark.createDataFrame([(1, ""), (2, " " * 500), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.near_next for r in syncmers.fingerprints(empty).collect()} == {1: 1.0, 2: 1.0, 3: 1.0}


def test_matches_find_a_passage_and_its_shift(spark):
    rng = random.Random(7)
    other = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = other(60)
    left = spark.createDataFrame([(1, " ".join(passage))], "doc_id long, text string")
    right = spark.createDataFrame([(7, " ".join([*other(100), *passage, *other(30)])), (8, " ".join(other(200))), (9, None)], "doc_id long, text string")
    found = syncmers.matches(syncmers.anchors(left), syncmers.anchors(right)).collect()
    assert [(r.left_id, r.right_id) for r in found] == [(1, 7)] and found[0].n_anchors > 20 and found[0].last - found[0].first > 80


def test_next_with_tied_and_null_ids(spark):
    a, b, c = ("x" + "ab" * 50, "y" + "cd" * 50, "z" + "ef" * 50)
    rows = [(None, b), (5, c), (5, a), (5, a), (9, None), (None, None)]
    got = syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    order = ["", b, a, a, c, ""]  # nulls first, equal ids by text
    want = sorted((len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()) for t, n in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == want


def test_place_among_many_cuts(spark):
    cuts = list(range(0, 3000, 7))
    rows = spark.range(-5, 3100).select("id", syncmers._place(cuts, "id").alias("at")).collect()
    assert all(r["at"] == sum(c <= r["id"] for c in cuts) for r in rows)
