"""The registered queries of the corpus operators, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, common, covertree, langid, minhash, packing, quality, suffix, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    rows = warc.read(spark, path, with_payload=False)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).cast("long")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return packing.pack(pieces, docs.count())


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(_table(spark, sf_dir, "documents"), with_text=False)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out().alias("held_out"), "score", "predicted")


def op9_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.groups(_table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.classify(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out().alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_ann": op2_ann,
    "op3_minhash": op3_minhash,
    "op4_langid": op4_langid,
    "op5_packing": op5_packing,
    "op6_suffix": op6_suffix,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_covertree": op9_covertree,
    "op10_toxicity": op10_toxicity,
}

#: Four letters of base 32 for each five digits of a hexadecimal digest.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((({' + '.join(f"(strpos('0123456789abcdef', substr(x, {5 * g + k + 1}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))}) // {32 ** (3 - j)}) % 32 + 1 AS INTEGER), 1)"
    for g in range(8)
    for j in range(4)
)

ORACLES: dict[str, str] = {
    "op1_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM d""",
    "op3_minhash": """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all(lower(text), '[0-9a-z[:^ascii:]]+') AS w FROM documents WHERE text IS NOT NULL),
 h AS MATERIALIZED (SELECT text, any_value(w) AS w, min(doc_id) AS id FROM d WHERE len(w) > 0 GROUP BY text),
 g AS MATERIALIZED (SELECT id, s, CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM h) GROUP BY ALL),
 t AS (SELECT id, sum(n) AS total FROM g GROUP BY 1),
 c AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.s = b.s AND a.id < b.id JOIN t x ON x.id = a.id JOIN t y ON y.id = b.id GROUP BY a.id, b.id HAVING sum(a.n) >= 0.8 * any_value(x.total) - 1e-9 AND sum(b.n) >= 0.8 * any_value(y.total) - 1e-9),
 e AS MATERIALIZED (SELECT c.a, c.b, k.s, coalesce(u.n, 0) AS u, coalesce(v.n, 0) AS v FROM c JOIN (SELECT DISTINCT c.a, c.b, g.s FROM c JOIN g ON g.id IN (c.a, c.b)) k ON k.a = c.a AND k.b = c.b LEFT JOIN g u ON u.id = c.a AND u.s = k.s LEFT JOIN g v ON v.id = c.b AND v.s = k.s),
 q AS (SELECT *, u / v AS r FROM e WHERE u > 0 AND v > 0),
 j AS (SELECT q.a, q.b, q.s, 1 / sum(greatest(e.u / q.u, e.v / q.v)) AS part FROM q JOIN e ON e.a = q.a AND e.b = q.b GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, sum(part) AS p FROM j GROUP BY ALL) WHERE p >= 0.8 - 1e-12), b AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT a AS id, a AS c FROM b UNION SELECT b.b, r.c FROM r JOIN b ON b.a = r.id), m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT o.doc_id, coalesce(h.id, o.doc_id) AS class_id, coalesce(m.c, h.id, o.doc_id) AS component_id, coalesce(m.c, h.id, o.doc_id) = o.doc_id AS kept FROM documents o LEFT JOIN h ON h.text = o.text LEFT JOIN m ON m.id = h.id""",
    "op6_suffix": """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS b, CASE WHEN 2 * i + 98 <= length(h) THEN substr(h, 2 * i - 1, 100) END AS x FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM d)),
 m AS (SELECT x, min(doc_id) AS first FROM p WHERE x IS NOT NULL GROUP BY 1),
 c AS (SELECT p.doc_id, p.i, p.b, max(CASE WHEN m.first < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN m ON m.x = p.x),
 e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
 r AS (SELECT doc_id, count(*) AS n, sum(gone) AS removed, count(*) FILTER (gone = 1 AND before = 0) AS spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(r.n, 0) AS n_bytes, CAST(coalesce(r.removed, 0) AS BIGINT) AS n_removed, coalesce(r.spans, 0) AS n_spans, sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id""",
    "op9_covertree": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_inner_product(e, e) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 r AS (SELECT a AS id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.c, v.vec_id) AS component_id, coalesce(m.c, v.vec_id) = v.vec_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.id = v.vec_id""",
}
