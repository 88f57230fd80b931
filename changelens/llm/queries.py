"""The registered queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_extract, language_id, license_scan, merkle, mixing, quality_classifier, quality_rules, secret_scan, simhash, spelling, vector_search
from .common import documents, fold, small_batches


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = bpe.encode_documents(documents(spark, sf_dir))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("cleaned")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.secret_scan(documents(spark, sf_dir))
    digest = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.language_id(docs, language_id.trained(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shuffled_mix(spark, sf_dir)


OP8_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n_rows, sqrt(count(*)::DOUBLE) AS raw FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * (raw / sum(raw) OVER ()) * sum(n_rows) OVER () / n_rows AS rate FROM n),
u AS (SELECT doc_id, d.source, text, rate,
        ('0x' || substr(md5('42:draw:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT source, rate, 0 AS k, -rate AS log, exp(-rate) AS below FROM r
      UNION ALL SELECT source, rate, k + 1, log + ln(rate) - ln((k + 1)::DOUBLE), below + exp(log + ln(rate) - ln((k + 1)::DOUBLE))
      FROM k WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
times AS (SELECT doc_id, u.source, text, u.rate, count(*) FILTER (WHERE k.below <= u.u) AS n
          FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source GROUP BY ALL)
SELECT doc_id, source, copy, rate,
       ('0x' || substr(md5('42:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key,
       sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT *, unnest(range(n)) AS copy FROM times)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classified(docs, quality_classifier.trained(docs, labels))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, tampering=(fold(docs["doc_id"]) == 0, {"text": merkle.tampered(docs["text"])}))


#: The bytes of a decimal number through the usual table of 256 entries, which the first lines make.
CRC_SQL = """
crc_table AS (SELECT list(list_reduce([i::BIGINT] || list_transform(range(8), lambda x: 0::BIGINT),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i))"""


def crc_sql(bytes_list: str) -> str:
    """The crc32 of a list of byte values, where ``crc_table`` is joined."""
    return f"xor(list_reduce([4294967295::BIGINT] || {bytes_list}, lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
bytes AS (SELECT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS b FROM (SELECT DISTINCT doc_id FROM documents)),
crcs AS (SELECT doc_id, {crc_sql('b')} AS crc FROM bytes, crc_table),
d AS (SELECT documents.*, crc % 5 = 0 AS hit FROM documents LEFT JOIN crcs USING (doc_id)),
leaves AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
  CASE WHEN hit THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql('text')} END AS start FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY coalesce('.' || source, '-')) - 1 AS t FROM leaves),
lower AS (SELECT t, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL SELECT t, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM lower WHERE n > 1 GROUP BY t, level, n, i // 16),
subroots AS (SELECT t, level AS height, h FROM lower WHERE n = 1),
upper AS (SELECT -1 AS t, 0 AS level, t AS i, count(*) OVER () AS n, h FROM subroots
  UNION ALL SELECT t, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY t, level, n, i // 16),
root AS (SELECT h AS root FROM upper WHERE n = 1),
steps AS (SELECT l.t AS leaf_t, l.i AS leaf_i, x.level AS step, x.i AS own, s.i, s.h
    FROM l JOIN lower x ON x.t = l.t AND x.n > 1 AND x.i = l.i // (16::BIGINT ** x.level)::BIGINT JOIN lower s ON s.t = x.t AND s.level = x.level AND s.i // 16 = x.i // 16
  UNION ALL SELECT l.t, l.i, 1000 + x.level, x.i, s.i, s.h
    FROM l JOIN upper x ON x.n > 1 AND x.i = l.t // (16::BIGINT ** x.level)::BIGINT JOIN upper s ON s.level = x.level AND s.i // 16 = x.i // 16),
runs AS (SELECT leaf_t, leaf_i, step, row_number() OVER (PARTITION BY leaf_t, leaf_i ORDER BY step) AS k,
    coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i < own), '') AS before, coalesce(string_agg(h, '' ORDER BY i) FILTER (WHERE i > own), '') AS after
  FROM steps GROUP BY leaf_t, leaf_i, step),
folds AS (SELECT t, i, 0 AS k, start AS folded FROM l
  UNION ALL SELECT t, i, folds.k + 1, sha256(before || folded || after) FROM folds JOIN runs ON leaf_t = t AND leaf_i = i AND runs.k = folds.k + 1),
folded AS (SELECT t, i, arg_max(folded, k) AS folded_root FROM folds GROUP BY t, i),
proofs AS (SELECT leaf_t, leaf_i, string_agg(before || after, '' ORDER BY k) AS siblings FROM runs GROUP BY leaf_t, leaf_i)
SELECT doc_id, leaf, subroots.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN subroots USING (t) JOIN folded ON folded.t = l.t AND folded.i = l.i LEFT JOIN proofs ON leaf_t = l.t AND leaf_i = l.i, root
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
counts AS (SELECT id, w, count(*) AS times FROM runs WHERE length(w) >= 5 GROUP BY ALL),
bytes AS (SELECT w, times, flatten(list_transform(string_split(id || ':' || w, ''), lambda x:
  CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END)) AS b FROM counts),
hashes AS (SELECT w, times, {crc_sql('b')} AS h FROM bytes, crc_table),
cut AS (SELECT times, CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word FROM hashes),
words AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
less AS (SELECT word, n, i, left(word, i::INTEGER) || substr(word, i::INTEGER + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM near),
forms AS (SELECT word, n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM ranked WHERE k = 1),
ways AS (SELECT word, form AS root, 1 AS k FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT ways.word, forms.form, k + 1 FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM ways GROUP BY word)
SELECT words.word, n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, words.word) AS root
FROM words LEFT JOIN forms ON forms.word = words.word LEFT JOIN roots ON roots.word = words.word
"""


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH e AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.row <> c.row),
ranks AS (SELECT *, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranks WHERE rank <= 5
"""


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_bpe": op2_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_html_extract": op5_html_extract,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_merkle": op11_merkle,
    "op12_spelling": op12_spelling,
    "op13_topk": op13_topk,
}
SQL = {"op3_quality_rules": quality_rules.SQL, "op7_exact_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op11_merkle": OP11_SQL, "op12_spelling": OP12_SQL, "op13_topk": OP13_SQL}
