"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import (
    bpe,
    covertree,
    decontaminate,
    html_text,
    langid,
    lm_score,
    packing,
    prefix_trie,
    recipes,
    sharding,
    simhash,
    spelling,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and digest both."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs, path, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), keep=["url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    docs = table(spark, sf_dir, "documents").withColumn("train", F.coalesce(number != 0, F.lit(False)))
    found = lm_score.score(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), "train")
    return found.select("doc_id", (~F.col("train")).alias("held_out"), *found.columns[2:])


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_texts(table(spark, sf_dir, "documents"), path, eos=50256, length=2048)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    found = toxicity.score(docs, grammar)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", toxicity.predicted().alias("predicted"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.duplicates(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("key")


QUERIES = [
    op1_sharding,
    op2_simhash,
    op3_language,
    op4_bpe,
    op5_decontamination,
    op6_html,
    op7_lm_score,
    op8_embeddings,
    op9_packing,
    op10_toxicity,
    op11_exact_dedup,
    op12_spelling,
    op13_prefix_trie,
]


def queries():
    return {query.__name__: query for query in QUERIES}


# Words of decontamination: A-Z lower-cased, then digits, a-z and everything beyond ASCII.
_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """crc32 bit by bit, of the UTF-8 bytes of code points up to U+00FF."""
    byte = "[{}, 0, 0, 0, 0, 0, 0, 0]"
    one, two = byte.format("unicode(c)::BIGINT"), f"list_concat({byte.format('195')}, {byte.format('unicode(c)::BIGINT - 64')})"
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN {one} ELSE {two} END))"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, b:
      CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END), 4294967295)"""


ORACLES = {
    "op11_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    "op12_spelling": f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY doc_id, w),
hashed AS (SELECT w, n, {_crc32("doc_id || ':' || w")} AS h FROM runs),
words AS (
  SELECT w, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
cuts AS (SELECT w, k, substr(w, 1, k - 1) AS a, substr(w, k + 1) AS b FROM (SELECT w, unnest(range(1, length(w) + 1)) AS k FROM words)),
pairs AS (
  SELECT x.w AS a, y.w AS b FROM cuts x JOIN cuts y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION SELECT x.w, y.w FROM cuts x JOIN words y ON x.a || x.b = y.w
  UNION SELECT y.w, x.w FROM cuts x JOIN words y ON x.a || x.b = y.w),
best AS (
  SELECT p.a AS w, count(*) AS n_near, first(p.b ORDER BY y.n DESC, p.b) AS near, max(y.n) AS near_n
  FROM pairs p JOIN words y ON p.b = y.w GROUP BY p.a),
forms AS (
  SELECT w.w, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
    CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.w = w.w),
roots AS (SELECT w, w AS root FROM forms UNION SELECT r.w, f.form FROM roots r JOIN forms f ON r.root = f.w WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.w = f.w JOIN forms t ON t.w = r.root
WHERE t.form IS NULL""",
    "op13_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, ({_crc32("conv_id::VARCHAR")} % 6)::INT AS h FROM own),
paths AS (
  SELECT h.conv_id, list_concat(coalesce(b.t, [])[1:h.h], h.t[h.h + 1:]) AS p
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
members AS (SELECT conv_id, p[1:d] AS node, d, len(p) = d AS ends FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(n.node[n.d][2]) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN kids k ON k.node = n.node AND k.d = n.d),
sums AS (
  SELECT node[1:u] AS node, u AS d, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM full_nodes) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.node = f.node AND s.d = f.d
LEFT JOIN nodes p ON f.d > 0 AND p.d = f.d - 1 AND p.node = f.node[1:f.d - 1]""",
    "op8_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
  coalesce(least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)), vec_id) AS component_id,
  coalesce(least(vec_id, (SELECT min(b) FROM reach WHERE a = vec_id)), vec_id) = vec_id AS kept
FROM embeddings""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
lengths AS (SELECT DISTINCT least(13, len(ws)) AS l FROM b WHERE len(ws) > 0),
windows AS (
  SELECT DISTINCT item_id, l, ws[i : i + l - 1] AS w
  FROM (SELECT item_id, ws, least(13, len(ws)) AS l, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
places AS (
  SELECT doc_id, i, l, ws[i : i + l - 1] AS w
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, lengths WHERE len(ws) >= l)),
hits AS (SELECT p.doc_id, p.i, p.l, x.item_id FROM places p JOIN windows x ON p.l = x.l AND p.w = x.w),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
