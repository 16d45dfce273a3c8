"""The registered queries of this subpackage and, where SQL can express them, their oracles.

Each query applies its operator with production parameters to the whole of its table and derives the digests of its
result from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_transducer, concurrency, conversation_repair, decontaminate, exact_dedup, html_wrapper, language_id, line_dedup, ngram_join, pii, ppm, rabitq, token_store
from .common import crc_of_id, fresh_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_wrapper.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(crc_of_id(), F.lit(7)) == 2
    scored = ppm.score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rabitq.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path("word_bpe_49k.json")
    back = bpe_transducer.encode(docs, path, bpe_transducer.build_lexicon(docs, path), and_decode=True)
    ids_text = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return back.select("doc_id", "n_tokens", F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM spots JOIN wins USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
got AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN got USING (doc_id)
"""


def language_model(spark: SparkSession, docs: DataFrame) -> language_id.PieceModel:
    """Learned from the documents whose crc32 mod 4 is not 2."""
    pieces = language_id.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return language_id.train(docs, F.pmod(crc_of_id(), F.lit(4)) != 2, pieces)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(spark, docs))
    return found.select("doc_id", (F.pmod(crc_of_id(), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, i, parts[i] AS line,
         trim(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT r, doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs)),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM frequent)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM frequent)), '')) AS kept_sha256
FROM lines GROUP BY r
"""


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_components(docs, percent=80, width=5).select("doc_id", "n_shingles", "component_id", "links")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep_largest=True)


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damaged(given))
    ids = given.select("conv_id").distinct().alias("i")
    told = ids.join(found.reports.alias("r"), F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    told = told.join(conversation_repair.digests(found.turns).alias("s"), F.col("i.conv_id").eqNullSafe(F.col("s.conv_id")), "left")
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("i.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: crc32 bit by bit; costs from the last turn back, then the walk of least initials forward.
OP12_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bits AS (
  SELECT *, flatten(list_transform(range(1, length(name) + 1), lambda j: list_transform(range(0, 8), lambda i: CAST((ord(substr(name, j, 1)) >> i) & 1 AS BIGINT)))) AS b FROM given),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 1, (xor(c, x) & 1) * CAST(3988292384 AS BIGINT))), CAST(4294967295 AS BIGINT)) % 20 AS k FROM bits),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM crc WHERE k <> 0),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS l FROM damaged),
marked AS (
  SELECT *, body = '' AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(body, 1) NOT IN ('.', '!', '?') AS cut,
         lag(l) OVER (PARTITION BY conv_id ORDER BY i) || l AS pair FROM turns),
faults AS (
  SELECT conv_id, i, role, text, l, is_blank OR again AS del, CASE WHEN NOT is_blank AND NOT again AND cut THEN 1 ELSE 0 END AS tr,
         CASE l WHEN 's' THEN [1, NULL, NULL, NULL] WHEN 'u' THEN [2, 2, NULL, 2] WHEN 'a' THEN [NULL, NULL, 3, NULL] ELSE [NULL, NULL, NULL, NULL] END AS keep FROM marked),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (NOT is_blank AND again) AS duplicate,
         count(*) FILTER (NOT is_blank AND NOT again AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY conv_id),
back AS (
  SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS v FROM stats
  UNION ALL
  SELECT conv_id, i, [least(b[1], 2 + b[3], 4 + b[4]), least(b[2], 2 + b[3], 4 + b[4]), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])]
  FROM (SELECT f.conv_id, f.i, list_transform(range(1, 5), lambda q: least(3 + v[q], CASE WHEN NOT del THEN tr + v[keep[q] + 1] END, CASE WHEN NOT del THEN 2 + tr + v[[2, 2, 3, 2][q] + 1] END)) AS b
        FROM back JOIN faults f ON f.conv_id = back.conv_id AND f.i = back.i - 1)),
walk AS (
  SELECT conv_id, 1 AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM stats
  UNION ALL
  SELECT conv_id, CASE WHEN s = 'I' THEN i ELSE i + 1 END, CASE s WHEN 'D' THEN q WHEN 'K' THEN keep[q + 1] ELSE nxt END, audit || s,
         CASE s WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE s WHEN 'R' THEN text ELSE '' END) END
  FROM (SELECT w.*, f.role, f.text, f.keep, [2, 2, 3, 2][q + 1] AS nxt,
               CASE WHEN f.i IS NULL THEN CASE WHEN q IN (1, 2) THEN 'I' END
                    WHEN 3 + b2.v[q + 1] = b1.v[q + 1] THEN 'D' WHEN 2 + b1.v[[2, 2, 3, 2][q + 1] + 1] = b1.v[q + 1] THEN 'I'
                    WHEN f.tr + b2.v[f.keep[q + 1] + 1] = b1.v[q + 1] THEN 'K' ELSE 'R' END AS s
        FROM walk w JOIN back b1 ON b1.conv_id = w.conv_id AND b1.i = w.i
        LEFT JOIN back b2 ON b2.conv_id = w.conv_id AND b2.i = w.i + 1 LEFT JOIN faults f ON f.conv_id = w.conv_id AND f.i = w.i)
  WHERE s IS NOT NULL),
done AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN stats USING (conv_id) LEFT JOIN done USING (conv_id) LEFT JOIN back ON back.conv_id = g.conv_id AND back.i = 1
"""


def op13_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concurrency.peak_concurrency(*(table(spark, sf_dir, name) for name in ("sales", "sale_lines", "clients")))


OP13_SQL = """
WITH ends AS (SELECT sale_id, max(shipped_at) AS last FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id),
spans AS (
  SELECT coalesce(nation_id, -1) AS nation_id, CAST(floor(epoch(sold_at) / 60) AS BIGINT) * 60 AS s, CAST(floor(epoch(last) / 60) AS BIGINT) * 60 + 7 * 86400 AS e,
         CASE WHEN total IS NULL THEN 0 ELSE CAST(floor(100 * total + 0.5) AS BIGINT) END AS cents
  FROM sales LEFT JOIN ends USING (sale_id) LEFT JOIN clients USING (client_id) WHERE sold_at IS NOT NULL),
parts AS (SELECT * FROM spans WHERE e IS NULL OR e > s),
both_ AS (SELECT nation_id, s, e, cents FROM parts UNION ALL SELECT -2, s, e, cents FROM parts),
moments AS (
  SELECT nation_id, from_s, sum(dn) AS dn, sum(dc) AS dc
  FROM (SELECT nation_id, s AS from_s, 1 AS dn, cents AS dc FROM both_ UNION ALL SELECT nation_id, e, -1, -cents FROM both_ WHERE e IS NOT NULL)
  GROUP BY ALL HAVING sum(dn) <> 0 OR sum(dc) <> 0),
sums AS (
  SELECT nation_id, from_s, lead(from_s) OVER w AS to_s, CAST(sum(dn) OVER w AS BIGINT) AS n_open, CAST(sum(dc) OVER w AS BIGINT) AS open_cents
  FROM moments WINDOW w AS (PARTITION BY nation_id ORDER BY from_s))
SELECT CAST(nation_id AS INTEGER) AS nation_id, from_s, to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s) AS high_open,
       n_open = max(n_open) OVER (PARTITION BY nation_id) AS is_peak
FROM sums
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_bootstrapped_pii, op2_wrapper_induction, op3_ppm_score, op4_rotated_codes, op5_bpe_transducer, op6_token_store, op7_benchmark_decontamination, op8_language_id, op9_line_dedup, op10_ngram_jaccard, op11_exact_dedup, op12_conversation_repair, op13_peak_concurrency]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_benchmark_decontamination": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_exact_dedup": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_peak_concurrency": OP13_SQL,
    }
