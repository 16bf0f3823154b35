"""The registered queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import (
    bpe, decontaminate, fim, html_extract, labelled, line_dedup, ngram_join, pq_dedup, quality, sharding, spelling,
    token_counts, toxicity, warc,
)
from tidegauge.llm.common import table
from tidegauge.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 8
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "word_bpe_49k.json"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register(
    "op1_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(p.h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)), '')
               AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM p JOIN f USING (h)""",
)
def op1_warc(spark, sf_dir):
    read = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_shard")
def op2_shard(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return sharding.uniform_shuffle(sized, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register(
    "op3_ngram_join",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS gram FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b USING (gram)
          WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * shared >= 8 * (x.n + y.n - shared)),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    m AS (SELECT a, min(b) AS low FROM r GROUP BY a), k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
    SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(k, 0)::BIGINT AS n_links
    FROM documents LEFT JOIN m ON m.a = doc_id LEFT JOIN k ON k.a = doc_id""",
)
def op3_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@register("op4_html_text")
def op4_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_text(pages, html_extract.learn(pages))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    rows = labelled.sample(
        docs, table(spark, sf_dir, "labels"), "quality", labelled.remainder(3) != 1, quality.TRAIN_ROWS
    )
    return quality.train(rows)


@register("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.classify(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(labelled.remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@register(
    "op6_line_dedup",
    f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (SELECT doc_id, pos, line,
          {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
    f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.*, coalesce(keeper <> doc_id, FALSE) AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id""",
)
def op6_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register(
    "op7_pq_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
            AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    m AS (SELECT a, min(b) AS low FROM r GROUP BY a), k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
    SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
           vec_id <= coalesce(low, vec_id) AS kept
    FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN k ON k.a = vec_id""",
)
def op7_pq_dedup(spark, sf_dir):
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op8_bpe")
def op8_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


@register("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = labelled.sample(docs, table(spark, sf_dir, "labels"), "toxic", labelled.remainder(5) != 0, toxicity.TRAIN_ROWS)
    scored = toxicity.classify(docs, toxicity.train(rows))
    return scored.select("doc_id", F.coalesce(labelled.remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@register(
    "op10_decontaminate",
    f"""
    WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    s AS (SELECT item_id, w, least(13, len(w)) AS size FROM i WHERE len(w) > 0),
    k AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(len(w) - size + 1),
              lambda j: array_to_string(w[j + 1 : j + size], ' '))) AS key FROM s),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    p AS (SELECT doc_id, size, unnest(range(len(w) - size + 1)) AS start, w FROM d, (SELECT DISTINCT size FROM s) WHERE len(w) >= size),
    x AS (SELECT doc_id, start, p.size, item_id FROM p JOIN k ON k.size = p.size AND k.key = array_to_string(w[start + 1 : start + p.size], ' ')),
    h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + size)) AS pos FROM x) GROUP BY doc_id),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM x GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
)
def op10_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The crc32 of a text's bytes: its table from the rule of the polynomial, then one step a byte.
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k:
              CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_CRC = """xor(list_reduce([4294967295] || list_transform(range(strlen({0})), lambda k:
              ('0x' || substr(hex({0}), 2 * k + 1, 2))::BIGINT),
              lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"""


@register(
    "op11_spelling",
    f"""
    WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS crc),
    r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    l AS (SELECT doc_id, {_LOWER.format("run")} AS run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY ALL),
    h AS (SELECT run, k, {_CRC.format("(doc_id || ':' || run)")} AS h FROM l, t),
    w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                      ELSE run END AS word, k FROM h),
    v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    y AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
          FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
    p AS (SELECT a.word AS a, b.word AS b FROM y a JOIN y b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT y.word, v.word FROM y JOIN v ON y.rest = v.word
          UNION SELECT v.word, y.word FROM y JOIN v ON y.rest = v.word),
    q AS (SELECT a, b, x.n AS n, z.n AS m, row_number() OVER (PARTITION BY a ORDER BY z.n DESC, b) AS turn,
                 count(*) OVER (PARTITION BY a) AS n_near
          FROM p JOIN v x ON x.word = a JOIN v z ON z.word = b),
    f AS (SELECT a AS word, b AS form, m AS form_n FROM q WHERE turn = 1 AND m >= 10 * n),
    s(word, last) AS (SELECT word, form FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.last),
    e AS (SELECT word, last FROM s WHERE last NOT IN (SELECT word FROM f))
    SELECT word, form, coalesce(last, word) AS root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
    FROM v LEFT JOIN f USING (word) LEFT JOIN e USING (word)
         LEFT JOIN (SELECT a AS word, n_near FROM q WHERE turn = 1) USING (word)""",
)
def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_DRAW = "('0x' || substr(digest, {}, 8))::BIGINT"


@register(
    "op12_fim",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
                      sha256('7:' || doc_id) AS digest FROM documents),
    c AS (SELECT *, len(lines) AS n, {_DRAW.format(1)} % (len(lines) + 1) AS one, {_DRAW.format(9)} % (len(lines) + 1) AS two,
                 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                           OR {_DRAW.format(17)} % 100 >= 100 THEN 'plain'
                      WHEN {_DRAW.format(25)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, array_to_string(lines[1 : least(one, two)], '') AS prefix,
                 array_to_string(lines[least(one, two) + 1 : greatest(one, two)], '') AS middle,
                 array_to_string(lines[greatest(one, two) + 1 : n], '') AS suffix FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p""",
)
def op12_fim(spark, sf_dir):
    return fim.transform(table(spark, sf_dir, "documents"), with_output=False)


@register("op13_token_counts")
def op13_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
