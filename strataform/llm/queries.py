"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, html_extract, line_dedup, ngram_join, packing, quality, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), allowed=lambda i: ~quality.held_out(i))
    return quality.score(docs, model)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.unionByName(own)))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_html_extraction, op3_line_dedup, op4_best_fit_packing, op5_ngram_jaccard_join, op6_benchmark_decontamination, op7_exact_dedup, op8_warc, op9_token_counts, op10_chat_formatting)}

ORACLE_SQL = {
    # lines as the operator takes them: windows of 50 words or more from each line on and back to each line; of equal windows
    # the first place stays, the lines of the others go
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, no, line, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS w FROM (SELECT doc_id, unnest(range(len(a))) AS no, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos, sum(w) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM l WHERE w > 0),
d AS (SELECT doc_id, list(line ORDER BY pos) AS lines, list(upto ORDER BY pos) AS ends FROM s GROUP BY doc_id),
e AS (SELECT s.doc_id, s.pos, s.upto, s.w, d.lines, list_position(list_transform(d.ends, lambda x: x >= s.upto - s.w + 50), true) AS hi, len(list_filter(d.ends, lambda x: x <= s.upto - 50)) + 1 AS lo FROM s JOIN d USING (doc_id)),
win AS (SELECT DISTINCT doc_id, lo, hi, array_to_string(lines[lo:hi], chr(10)) AS k FROM (SELECT doc_id, pos AS lo, hi, lines FROM e WHERE hi > 0 UNION ALL SELECT doc_id, lo, pos AS hi, lines FROM e WHERE upto >= 50)),
f AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY k ORDER BY doc_id, lo) > 1 AS later FROM win),
gone AS (SELECT DISTINCT s.doc_id, s.no FROM f JOIN s ON s.doc_id = f.doc_id AND s.pos BETWEEN f.lo AND f.hi WHERE f.later)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE gone.no IS NULL), '') AS text, count(*) AS n_lines, count(gone.no) AS n_removed, coalesce(string_agg(CAST(l.no AS VARCHAR), ',' ORDER BY l.no) FILTER (WHERE gone.no IS NOT NULL), '') AS removed
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.no = l.no GROUP BY l.doc_id""",
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-6),
k AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(l.y) FILTER (WHERE l.same), d.doc_id)) AS copy_id, count(l.y) AS n_links FROM d LEFT JOIN l ON l.x = d.doc_id GROUP BY d.doc_id),
t AS (SELECT l.x, count(DISTINCT k.copy_id) AS n_texts FROM l JOIN k ON k.doc_id = l.y WHERE NOT l.same GROUP BY l.x),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
SELECT k.doc_id, c.class_id, k.copy_id, k.n_links, coalesce(t.n_texts, 0) AS n_texts FROM k JOIN c ON c.x = k.doc_id LEFT JOIN t ON t.x = k.doc_id""",
    "op8_warc": r"""
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
n AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT)) AS five FROM h),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM n),
m AS (SELECT payload_digest, max(page_id) AS top FROM b GROUP BY payload_digest)
SELECT b.page_id, b.payload_bytes, b.payload_digest, CASE WHEN b.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN b.page_id <> m.top THEN m.top END AS refers_to FROM b JOIN m USING (payload_digest)""",
    "op10_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|</?ROLE[ >])', '\1\\\2\3', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 6 ELSE 18 + 2 * octet_length(encode(role)) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op6_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.k = win.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(hi.s, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)""",
}
