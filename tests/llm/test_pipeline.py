import random

import corpus_pipeline
from plumbline.llm import packing
from plumbline.llm.common import table

from test_near import plain_components
from test_suffix import plain

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_the_schema_and_clean_rows(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").toPandas().set_index("doc_id").quality
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns and kept.dtypes == docs.dtypes, name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(ids & good) > 0.8 * len(good)


def test_one_of_each_group_stays(spark):
    """Against components by all pairs; rows without words stay."""
    rng = random.Random(0)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(200)]
        for _ in range(rng.choice([1, 2, 5])):
            near = [*base]
            near[rng.randrange(200)] = "changed"
            rows.append(" ".join(near))
    rows += [rows[0], rows[0], None, "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    found = plain_components(list(enumerate(rows)))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({root for _, root in found.values()})


def test_repeats_are_cut_and_counted(spark):
    """Against removal by all windows."""
    rng = random.Random(1)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = words(700)
    texts = [words(300) + shared[: rng.choice([350, 450, 700])] + words(200) for _ in range(12)] + ["", None, words(900)]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    for i, (n, gone, _, _) in enumerate(plain(texts)):
        assert got[i].n_chars == len(got[i].text) == n - gone


def test_repeated_passages_of_over_50_words_are_cut(spark):
    """Passages of 51 words and over go though they have under 400 bytes; 50 words and what is not repeated stay."""
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    shared = [words(51), words(59), words(50)]
    own = [[words(40), words(40)] for _ in range(9)]
    assert all(len(x) < 400 for x in shared)
    texts = ["\n".join([own[i][0], shared[i % 3], own[i][1]]) for i in range(9)] + [words(300)]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert got == {i: t if i % 3 == 2 or i == 9 else "\n\n".join(own[i]) for i, t in enumerate(texts)}


def test_packed_pieces_cover_every_document(spark):
    docs = spark.createDataFrame([(i % 7, t, None, None, None) for i, t in enumerate([None, "", "a b", "word " * 3000, *["same"] * 8, "x" * 250_000])], SCHEMA)
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    lengths = sorted(len(packing.ByteLevelIds(corpus_pipeline.tokenizer_path("byte_bpe_50k.json")).encode(r.text or "")) + 1 for r in docs.collect())
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == lengths and sum(r.length for r in rows) == sum(lengths)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_every_stage_on_odd_tables(spark):
    """Nulls in every column, repeated rows and ids, columns with the operators' own names; then an empty table."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (1, text + " more", None, None, None), (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("row_key", "set_id", "component_id", "key", "text_key", "rest", "score", "kept", "quality", "n", "bits", "spans"):
        docs = docs.withColumn(name, docs["lang"])
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, frame, SF)
            assert kept.dtypes == frame.dtypes, name
            n = kept.count()
            assert n <= frame.count(), name
        assert corpus_pipeline.drop_near_copies(spark, frame, SF).count() == (3 if frame is docs else 0)
        assert corpus_pipeline.cut_repeats(spark, frame, SF).count() == (6 if frame is docs else 0)
        assert corpus_pipeline.pack(spark, frame, SF).filter("start = 0").count() == (6 if frame is docs else 0)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 50
