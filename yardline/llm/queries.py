"""The registered queries of this subpackage, each over its whole table, and their SQL twins.

Without a twin: toxicity, language (trained models), personal data behind
disguises, byte strings across documents, spelling variants and byte-pair ids
(no practical SQL), the pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardline.llm import (
    byte_bpe,
    decontamination,
    hard_negatives,
    itq,
    jaccard,
    langid,
    mixing,
    pii,
    spelling,
    suffix_sort,
    suffix_tree,
    toxicity,
    warc,
)

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    """The remainder by which documents are held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_fold(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold(4) != 2))
    return langid.predict(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("longest")


def op6_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link(_table(spark, sf_dir, "embeddings"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.deduplicate(_table(spark, sf_dir, "documents")).drop("spans", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sort.deduplicate(_table(spark, sf_dir, "documents")).drop("spans", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("finish")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = byte_bpe.Tokenizer.load(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity,
        op2_ngram_jaccard,
        op3_pii,
        op4_language,
        op5_decontamination,
        op6_itq,
        op7_suffix_tree,
        op8_warc,
        op9_suffix_sort,
        op10_mixing,
        op11_spelling,
        op12_hard_negatives,
        op13_byte_bpe,
    )
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_COMPONENTS = """
    reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    components AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

_OP2 = f"""
WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s FROM w),
    n AS (SELECT doc_id, len(s) AS n FROM s),
    g AS (SELECT doc_id, unnest(s) AS g FROM s),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
    ids AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM n JOIN components ON id = doc_id"""

_OP5 = f"""
WITH
    d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
           FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
    m AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_OP6 = f"""
WITH RECURSIVE
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
    ids AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components ON id = vec_id"""

_OP7 = rf"""
WITH
    d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM f WHERE first < doc_id),
    k AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
    r AS (SELECT k.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k.i) AS kept FROM k ANTI JOIN gone ON gone.doc_id = k.doc_id AND gone.i = k.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id"""

_OP8 = """
WITH
    p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to FROM f"""

_OP10 = f"""
WITH
    d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size, md5('mix-' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM d GROUP BY source),
    c AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
    l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
                 / CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM c),
    t AS (SELECT *, least(CAST(cap AS DOUBLE), coalesce(max(CASE WHEN cap / weight > level THEN level END) OVER (), 3.0) * weight) AS target FROM l),
    q AS (SELECT d.*, rank, source_size, target, CAST(sum(size) OVER (PARTITION BY rank ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
          FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
    k AS (SELECT *, (pass * source_size + done) / target AS finish FROM (SELECT *, unnest([0, 1, 2]) AS pass FROM q WHERE target > 0) WHERE pass * source_size + done - size < target),
    o AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, pass ROWS UNBOUNDED PRECEDING) AS sent FROM k),
    x AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM o WHERE sent <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN x ON x.doc_id = q.doc_id"""

_OP12 = """
WITH
    v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score
          FROM v a JOIN v ON len(a.q) = len(v.q) AND a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


def statements() -> dict[str, str]:
    return {
        "op2_ngram_jaccard": _OP2,
        "op5_decontamination": _OP5,
        "op6_itq": _OP6,
        "op7_suffix_tree": _OP7,
        "op8_warc": _OP8,
        "op10_mixing": _OP10,
        "op12_hard_negatives": _OP12,
    }
