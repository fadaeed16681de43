"""Registered queries of the corpus operators: contract columns only, whole tables.

``__spark_entry__`` adds ``QUERIES`` and ``SQL`` when this subpackage can be imported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, content, decontam, linededup, merkle, mixing, neardup, negatives, passages, quality, secretscan, toxicity, warc
from ._text import clean, map_frames, text_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_batches(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

@_query("op1_multiprobe_ann")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


@_query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality.scored(docs, quality.train(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "score")
    return scores.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@_query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["mix_source", "mix_block", "mix_phase", "mix_slot", "mix_offset"]
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", *columns)


@_query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, s, l.n, array_to_string(w[s:s + l.n - 1], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d) x, (SELECT DISTINCT n FROM iw) l
  WHERE s + l.n - 1 <= len(w)),
hit AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@_query("op5_decontamination", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


@_query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the secrets themselves stay out of the result
    found = secretscan.scan(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
    return found.select(
        "doc_id", "start", F.length("value").cast("bigint").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret"
    )


OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \t-\r]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON other = a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


@_query("op7_minhash_near_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@_query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


@_query("op9_warc", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.archive(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (
  SELECT doc_id, r, p, l[p] AS line,
    translate(trim(l[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, r, l, unnest(range(1, len(l) + 1)) AS p FROM d)),
g AS (SELECT k, max(doc_id) AS keeper FROM x WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
y AS (SELECT x.*, g.k IS NOT NULL AND doc_id <> keeper AS gone FROM x LEFT JOIN g ON x.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM y GROUP BY doc_id, r
"""


@_query("op10_line_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    import pandas as pd

    def digest(batches):
        for b in batches:
            kept = [linededup.kept_text(t, m) for t, m in zip(clean(b["text"]), b["__bitmap"])]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "n_lines": [n for _, n in kept],
                    "n_dropped": b["__dropped"].fillna(0).astype("int64"),
                    "kept_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _ in kept],
                }
            )

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = linededup.with_bitmaps(docs, linededup.keep_bitmaps(docs))
    return map_frames(marked, digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""


@_query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", shifted))


@_query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))).select("doc_id", "score")
    return scores.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def _leaf_sql(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


# The checksum works on one digit a step in eight halvings; 3988292384 is its polynomial.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, source) AS row, doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS changed,
         list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                     lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) // 2, 3988292384) ELSE xor(a, x) // 2 END) % 2 = 1 AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS level, CAST(idx AS BIGINT) AS idx, leaf AS digest, CAST(n AS BIGINT) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, idx // 3),
subroots AS (SELECT source, digest AS subroot, level AS levels, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, CAST(idx AS BIGINT) AS idx, subroot AS digest, CAST(n AS BIGINT) AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, idx // 3),
siblings AS (
  SELECT p.row, s.level, s.idx, s.digest, s.idx < p.idx // CAST(power(3, s.level) AS BIGINT) AS before
  FROM placed p JOIN nodes s ON s.source IS NOT DISTINCT FROM p.source AND s.n > 1
   AND s.idx // 3 = p.idx // CAST(power(3, s.level + 1) AS BIGINT) AND s.idx <> p.idx // CAST(power(3, s.level) AS BIGINT)
  UNION ALL
  SELECT p.row, r.levels + s.level, s.idx, s.digest, s.idx < r.idx // CAST(power(3, s.level) AS BIGINT)
  FROM placed p JOIN subroots r ON r.source IS NOT DISTINCT FROM p.source
  JOIN tops s ON s.n > 1 AND s.idx // 3 = r.idx // CAST(power(3, s.level + 1) AS BIGINT) AND s.idx <> r.idx // CAST(power(3, s.level) AS BIGINT)),
heights AS (SELECT p.row, r.levels + t.level AS height, r.subroot, t.digest AS root FROM placed p JOIN subroots r ON r.source IS NOT DISTINCT FROM p.source, tops t WHERE t.n = 1),
sides AS (
  SELECT row, level, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (before), '') AS ahead, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (NOT before), '') AS after
  FROM siblings GROUP BY row, level),
folded AS (
  SELECT row, 0 AS level, CASE WHEN tampered THEN changed ELSE leaf END AS digest FROM placed
  UNION ALL
  SELECT f.row, f.level + 1, sha256(coalesce(s.ahead, '') || f.digest || coalesce(s.after, ''))
  FROM folded f JOIN heights h ON h.row = f.row AND f.level < h.height LEFT JOIN sides s ON s.row = f.row AND s.level = f.level)
SELECT p.doc_id, p.leaf, h.subroot, h.root, sha256(coalesce(q.all_siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = h.root AS verified
FROM placed p JOIN heights h ON h.row = p.row JOIN folded f ON f.row = p.row AND f.level = h.height
LEFT JOIN (SELECT row, string_agg(digest, '' ORDER BY level, idx) AS all_siblings FROM siblings GROUP BY row) q ON q.row = p.row
"""


@_query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    bare = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(bare))
    manifest = merkle.Manifest(docs, extra={"changed": changed})
    out = merkle.audited(manifest.proofs(), manifest.root, "changed")
    digest = lambda c: F.lower(F.hex(c))
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    return out.select(F.col("key").alias("doc_id"), digest("arrived").alias("leaf"), digest("subroot").alias("subroot"), root.alias("root"), "proof_sha256", "folded_root", "verified")
