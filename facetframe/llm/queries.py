"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from facetframe.llm import (
    decontaminate,
    fertility,
    html_region,
    language,
    line_dedup,
    merkle,
    near_dup,
    packing,
    pii,
    sharding,
    spelling,
    toxicity,
    url_templates,
)
from facetframe.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; one without SQL is tested against brute force."""

    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


OP5_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
sizes AS (SELECT DISTINCT n FROM item_windows),
hits AS (
  SELECT DISTINCT d.r, d.i, d.n, x.item
  FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)) d
  JOIN item_windows x ON x.win = d.win AND x.n = d.n
),
hit_words AS (
  SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


@query("op5_decontamination", OP5_SQL)
def op5(spark, folder):
    hits = decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"), carry=["doc_id"])
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SHARDS = 24


@query("op8_sharding")
def op8(spark, folder):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    placed = sharding.sharded(rows, ["doc_id", "text_crc32"], SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


@query("op9_url_filter")
def op9(spark, folder):
    found = url_templates.judged(table(spark, folder, "pages"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op10_packing")
def op10(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT p.a, p.b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
  WHERE 100 * c >= 75 * (m.n + n.n - c)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN ways e ON e.a = r.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@query("op6_near_duplicates", OP6_SQL)
def op6(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query("op7_fertility")
def op7(spark, folder):
    return fertility.judged(table(spark, folder, "documents"))


def fold(key, n: int):
    """crc32 of a key as text, modulo n; a null key counts as an empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(n))


@query("op3_language")
def op3(spark, folder):
    documents = table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    learn = documents.where(~held_out).select("text", "lang")
    rows = documents.select("doc_id", held_out.alias("held_out"), "text")
    return language.predicted(rows, learn, ["doc_id", "held_out"])


def toxicity_model(documents, labels):
    """Learned from the rows outside the held-out fold only."""
    return toxicity.fitted(documents, labels.where(fold(F.col("doc_id"), 5) != 0))


@query("op2_toxicity")
def op2(spark, folder):
    documents = table(spark, folder, "documents")
    model = toxicity_model(documents, table(spark, folder, "labels"))
    rows = documents.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return toxicity.scored(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op1_html_extraction")
def op1(spark, folder):
    texts = html_region.extracted(table(spark, folder, "pages"), ["page_id", "url"])
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))

#: The secret of the surrogates; a deployment passes its own.
PII_KEY = "facetframe"


@query("op4_pii_surrogates")
def op4(spark, folder):
    return pii.replaced(table(spark, folder, "documents"), PII_KEY)


# crc32 of the bytes of `s`, bit after bit, in SQL.
def _crc32_sql(s: str) -> str:
    steps = (
        f"flatten(list_transform(range(octet_length(encode({s}))), lambda i: "
        f"[CAST('0x' || substr(hex(encode({s})), 2 * i + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    )
    return (
        f"xor(4294967295, list_reduce({steps}, lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END), "
        "CAST(4294967295 AS BIGINT)))"
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS r
  FROM documents
),
hashed AS (SELECT r, n, {_crc32_sql("d || ':' || r")} AS h FROM (SELECT d, r, count(*) AS n FROM runs WHERE length(r) >= 5 GROUP BY d, r)),
spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS INT)) || substr(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, n
  FROM hashed
),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || chr(1) || substr(word, i + 2) AS hole, substr(word, 1, i) || substr(word, i + 2) AS shorter
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.hole = b.hole AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.shorter = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.shorter = b.word
),
best AS (
  SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n
),
forms AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 2 * n),
walk AS (
  SELECT word, word AS here, 0 AS step FROM words
  UNION ALL
  SELECT w.word, f.form, step + 1 FROM walk w JOIN forms f ON f.word = w.here
),
roots AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT w.word, form, root, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
FROM words w JOIN roots USING (word) LEFT JOIN best USING (word) LEFT JOIN forms f USING (word)
"""


@query("op11_spelling_variants", OP11_SQL)
def op11(spark, folder):
    documents = table(spark, folder, "documents")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = documents.select(key.alias("d"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("r"))
    # A run of under 5 letters cannot become a word of 5.
    runs = found.where(F.char_length("r") >= 5).select("d", F.translate("r", UPPER, LOWER).alias("r"))
    h = F.crc32(F.encode(F.concat("d", F.lit(":"), "r"), "UTF-8"))
    at = (h % F.char_length("r")).cast("int")
    cut = F.concat(F.substring(F.col("r"), F.lit(1), at), F.substring(F.col("r"), at + 2, F.char_length("r")))
    words = runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("r")).alias("word")).where(F.char_length("word") >= 5)
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")
    return spelling.grouped(counts).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = rf"""
WITH lines AS (
  SELECT r, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
),
shared AS (SELECT k, max(doc) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc) >= 3)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE top <> doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE top IS NULL OR top = doc), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (k) GROUP BY r
"""


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [line_dedup.remaining(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([n for n, _, _ in left], pa.int64()),
                pa.array([d for _, d, _ in left], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for _, _, t in left], pa.string()),
            ],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


@query("op12_line_dedup", OP12_SQL)
def op12(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = line_dedup.with_bitmaps(documents, line_dedup.keep_bitmaps(documents))
    rows = found.select("row.doc_id", "text", "keep")
    return rows.mapInArrow(_line_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _merkle_sql() -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")]
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"
    head = " || ".join(map(field, fields))
    crc = _crc32_sql("CAST(doc_id AS VARCHAR)")
    return rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({head} || {field("text")}) AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS tampered
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
),
nodes AS (
  SELECT g, 0 AS lvl, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT g, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 8, n
),
subroots AS (SELECT g, h AS subroot, lvl AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM uppers WHERE n > 1 GROUP BY lvl, pos // 8, n
),
steps AS (
  SELECT p.g, p.pos, l.lvl,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < p.pos // CAST(8 ** l.lvl AS BIGINT)), '') AS lft,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > p.pos // CAST(8 ** l.lvl AS BIGINT)), '') AS rgt
  FROM placed p JOIN (SELECT DISTINCT g, lvl FROM nodes WHERE n > 1) l ON l.g = p.g
  JOIN nodes s ON s.g = p.g AND s.lvl = l.lvl AND s.pos // 8 = p.pos // CAST(8 ** (l.lvl + 1) AS BIGINT)
  GROUP BY p.g, p.pos, l.lvl
  UNION ALL
  SELECT p.g, p.pos, u.height + l.lvl,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < u.pos // CAST(8 ** l.lvl AS BIGINT)), ''),
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > u.pos // CAST(8 ** l.lvl AS BIGINT)), '')
  FROM placed p JOIN subroots u ON u.g = p.g
  CROSS JOIN (SELECT DISTINCT lvl FROM uppers WHERE n > 1) l
  JOIN uppers s ON s.lvl = l.lvl AND s.pos // 8 = u.pos // CAST(8 ** (l.lvl + 1) AS BIGINT)
  GROUP BY p.g, p.pos, u.height, l.lvl
),
shown AS (SELECT g, pos, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY g, pos),
climb AS (
  SELECT g, pos, 0 AS lvl, coalesce(tampered, leaf) AS h FROM placed
  UNION ALL
  SELECT c.g, c.pos, c.lvl + 1, sha256(lft || c.h || rgt) FROM climb c JOIN steps s ON s.g = c.g AND s.pos = c.pos AND s.lvl = c.lvl
),
tops AS (SELECT g, pos, arg_max(h, lvl) AS folded_root FROM climb GROUP BY g, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots u USING (g) JOIN tops t ON t.g = p.g AND t.pos = p.pos
LEFT JOIN shown s ON s.g = p.g AND s.pos = p.pos CROSS JOIN (SELECT h AS root FROM uppers WHERE n = 1)
"""


OP13_SQL = _merkle_sql()


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark, folder):
    documents = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    rows = documents.select(
        "doc_id",
        "lang",
        merkle.leaf([*fields, F.col("text")]).alias("leaf"),
        F.when(changed, merkle.leaf([*fields, F.translate("text", UPPER, LOWER)])).alias("tampered"),
    )
    found = merkle.proofs(rows, "lang", "doc_id", "leaf").select(
        "row.doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        merkle.digest(merkle.proof(F.col("path"))).alias("proof_sha256"),
        merkle.folded(F.coalesce("row.tampered", "digest"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
