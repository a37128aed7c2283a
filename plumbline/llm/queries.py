"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe_stream, chat_format, embedding_near, hard_negatives, jaccard_join, lexical_nra, packing, quality_classifier, quality_rules, suffix_dedup, syncmers, token_counts, warc_audit
from plumbline.llm.common import table, tokenizer_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.digests(chat_format.format_turns(chat_format.as_parts(rows)))


def chat_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of `conversations`, user turns with an image, every third turn of theirs with audio, every fourth with a document."""
    rows = chat_format.as_parts(table(spark, sf_dir, "conversations"))
    user, n, turn = F.col("role") == "user", F.size("parts"), F.col("turn")
    ref = lambda kind: F.concat(F.lit(f"{kind}/"), F.col("conv_id").cast("string"), F.lit("/"), turn.cast("string"))

    def part(kind: str, **fields) -> Column:
        empty = {"text": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
        return F.struct(F.lit(kind).alias("kind"), *((fields[k] if k in fields else F.lit(None)).cast(t).alias(k) for k, t in empty.items()))

    image = part("image", ref=ref("image"), width=F.lit(28) + turn, height=F.lit(14))
    audio = part("audio", ref=ref("audio"), seconds=turn + F.lit(0.5))
    document = part("document", ref=ref("document"), pages=turn)
    none = F.slice("parts", n + 1, 1)
    media = F.concat(F.when(user, F.array(image)).otherwise(none), F.when(user & (turn % 3 == 0), F.array(audio)).otherwise(none), F.when(user & (turn % 4 == 2), F.array(document)).otherwise(none))
    turns = chat_format.format_turns(rows.withColumn("parts", F.concat(media, "parts")))
    kinds = F.array_join(F.transform("attachments", lambda a: a["kind"]), ",")
    refs = F.array_join(F.transform("attachments", lambda a: a["ref"]), ",")
    return turns.select("conv_id", "turn", F.size("attachments").alias("n_attachments"), kinds.alias("kinds"), refs.alias("refs"), "expanded_tokens", F.size(F.regexp_extract_all("segment", F.lit("<(image|audio|document)>"), F.lit(0))).alias("placeholders"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits records of `pages` against a replica in which some records are damaged, some are gone and some lie 2^30 bytes on."""
    pages = table(spark, sf_dir, "pages")
    damaged = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("X"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = pages.filter(F.col("page_id") % 389 != 5).withColumn("html", damaged)
    first = warc_audit.lay_out(warc_audit.to_records(pages))
    second = warc_audit.lay_out(warc_audit.to_records(replica), first)
    moved = F.when(F.col("key") % 101 == 7, F.col("offset") + (1 << 30)).otherwise(F.col("offset"))
    found = warc_audit.audit(first, second.withColumn("offset", moved))
    return found.withColumn("moved_by", F.coalesce(F.col("found_offset") - F.col("offset"), F.lit(0))).withColumnRenamed("key", "page_id").drop("found_offset")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every seventh vector is the next one."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_nra.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_chat_format, op3_jaccard_join, op4_syncmers, op5_packing, op6_quality_classifier, op7_bpe, op8_suffix_dedup, op9_warc_audit, op10_token_counts, op11_hard_negatives, op12_lexical_search, op13_embedding_near, chat_content_parts)}
ORACLES: dict[str, str] = {
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS ints FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])),
        scored AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label, list_inner_product(a.ints, b.ints)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        positives AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM scored WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id) WHERE label <> positives.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
    """,
    "op12_lexical_search": r"""
        WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id), all_ AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
        counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, all_ GROUP BY term, docs),
        parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS part FROM counts JOIN weights USING (term) JOIN sizes USING (doc_id), all_),
        scored AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored QUALIFY rank <= 20
    """,
    "op13_embedding_near": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([coalesce(isfinite(e), false) FOR e IN embedding]) AND list_bool_or([coalesce(e <> 0, false) FOR e IN embedding])),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
        reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degree USING (vec_id)
    """,
    "chat_content_parts": """
        SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, len(kinds)::INTEGER AS n_attachments, array_to_string(kinds, ',') AS kinds, array_to_string([k || '/' || conv_id || '/' || turn FOR k IN kinds], ',') AS refs,
               (CASE WHEN list_contains(kinds, 'image') THEN (28 + turn + 13) // 14 ELSE 0 END + CASE WHEN list_contains(kinds, 'audio') THEN ceil((turn + 0.5) * 25)::BIGINT ELSE 0 END + CASE WHEN list_contains(kinds, 'document') THEN greatest(turn, 1) * 512 ELSE 0 END)::BIGINT AS expanded_tokens,
               len(kinds)::INTEGER AS placeholders
        FROM (SELECT conv_id, turn, list_filter([CASE WHEN role = 'user' THEN 'image' END, CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'audio' END, CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'document' END], lambda k: k IS NOT NULL) AS kinds FROM conversations)
    """,
    "op9_warc_audit": """
        WITH r AS (
            SELECT page_id, page_id // 4096 AS archive, html,
                   strlen('WARC/1.1') + 2 + strlen('WARC-Type: response') + 2 + strlen('WARC-Record-ID: <urn:page:' || page_id || '>') + 2
                   + strlen('WARC-Target-URI: ' || url) + 2 + strlen('Content-Type: text/html') + 2 + strlen('Content-Length: ' || strlen(html)) + 4
                   + strlen(html) + 4 AS bytes
            FROM pages),
        placed AS (SELECT *, COALESCE(SUM(bytes) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
               CASE WHEN page_id % 389 = 5 THEN 'missing' WHEN page_id % 97 = 13 AND html <> '' AND html NOT LIKE 'X%' THEN 'corrupt' WHEN page_id % 101 = 7 THEN 'moved' ELSE 'ok' END AS status
            FROM r)
        SELECT page_id, archive, "offset", bytes, 1::BIGINT AS copies, status, CASE WHEN status = 'moved' THEN 1073741824 ELSE 0 END::BIGINT AS moved_by FROM placed
    """,
}
