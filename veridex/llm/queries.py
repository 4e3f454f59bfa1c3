"""The queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.toxicity_crf import fitted, held_out, scored

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = scored(docs, fitted(docs, _table(spark, sf_dir, "labels")))
    return done.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxic_words", "toxic_spans")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.fingerprints import edited_pairs

    return edited_pairs(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.chat_preference import neighbours, preference_pairs, turns_alone

    turns = _table(spark, sf_dir, "conversations")
    done = preference_pairs(neighbours(turns)).unionByName(turns_alone(turns.filter("conv_id is null")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return done.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), m AS (
  SELECT a.pair_id, a.k, (b.k IS NOT NULL AND a.role = b.role AND a.text = b.text) AS same
  FROM (SELECT * FROM t WHERE side = 0) a LEFT JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.k = b.k
), p AS (
  SELECT pair_id, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS lcp FROM m GROUP BY pair_id
), q AS (
  SELECT t.*, coalesce(p.lcp, 0) AS lcp, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r FROM t LEFT JOIN p USING (pair_id)
), s AS (
  SELECT *, sum(length(r)) OVER (PARTITION BY conv_id ORDER BY k) - length(r) AS pos FROM q WHERE k > lcp
)
SELECT q.pair_id, min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id, CAST(max(lcp) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (side = 0 AND k <= lcp), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (side = 0 AND k > lcp), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (side = 1 AND k > lcp), '') AS rejected,
  coalesce((SELECT string_agg(CAST(pos + length(role) + 5 AS BIGINT) || '+' || CAST(length(text) + 8 AS BIGINT), ',' ORDER BY k) FROM s WHERE s.pair_id = q.pair_id AND s.side = 0 AND role = 'assistant'), '') AS chosen_spans,
  coalesce((SELECT string_agg(CAST(pos + length(role) + 5 AS BIGINT) || '+' || CAST(length(text) + 8 AS BIGINT), ',' ORDER BY k) FROM s WHERE s.pair_id = q.pair_id AND s.side = 1 AND role = 'assistant'), '') AS rejected_spans
FROM q GROUP BY q.pair_id
UNION ALL
SELECT NULL, NULL, NULL, 0, '', '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '',
  CASE WHEN role = 'assistant' THEN (length(role) + 5) || '+' || (length(coalesce(text, '')) + 8) ELSE '' END, ''
FROM conversations WHERE conv_id IS NULL
"""


#: Rules of the URL query, and host labels whose pages make up its list.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
BAD_LABELS = ["spam-farm", "cheap-pills"]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.url_bloom import Rule, canonical, host_and_path, judged

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = host_and_path()
    bad = host.rlike(r"(^|\.)(" + "|".join(BAD_LABELS) + r")(\.|$)")
    listed = pages.filter(bad).select(canonical(host, path).alias("key"))
    return judged(pages, listed, [Rule(*r) for r in RULES]).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT DISTINCT host || regexp_replace(path, '/+$', '') AS key FROM q WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)(\.|$)')),
m AS (SELECT q.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path) GROUP BY q.page_id)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN m USING (page_id) LEFT JOIN l ON l.key = q.host || regexp_replace(q.path, '/+$', '')
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.hilbert_packing import packed

    return packed(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.jaccard_forest import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.sharding import minimax_shards

    return minimax_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE b AS (
  SELECT range AS n, 0 AS step, range::BIGINT AS v FROM range(256)
  UNION ALL
  SELECT n, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM b WHERE step < 8
), tab AS (SELECT list(v ORDER BY n) AS tab FROM b WHERE step = 8),
u AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
x AS (SELECT text, hex(encode(text)) AS h FROM u),
r AS (
  SELECT sha256(text) AS digest, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295::BIGINT) AS text_crc32 FROM x, tab
), g AS (
  SELECT sha256(coalesce(text, '')) AS digest, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY 1
), e AS (
  SELECT digest, sum(bytes) OVER (ORDER BY digest)::BIGINT AS stop FROM g
), w AS (
  SELECT (SELECT max(bytes) FROM g)::BIGINT AS lo, (SELECT sum(bytes) FROM g)::BIGINT AS hi, (SELECT sum(bytes) FROM g)::BIGINT AS total, 0::BIGINT AS pos, 0 AS used
  UNION ALL
  SELECT CASE WHEN pos < total AND used = 8 THEN (lo + hi) // 2 + 1 ELSE lo END,
         CASE WHEN pos = total THEN (lo + hi) // 2 ELSE hi END, total,
         CASE WHEN pos = total OR used = 8 THEN 0 ELSE (SELECT max(stop) FROM e WHERE stop <= pos + (lo + hi) // 2) END,
         CASE WHEN pos = total OR used = 8 THEN 0 ELSE used + 1 END
  FROM w WHERE lo < hi
), c AS (SELECT max(lo) AS cap FROM w WHERE lo = hi),
k AS (
  SELECT 0 AS i, 0::BIGINT AS pos
  UNION ALL
  SELECT i + 1, (SELECT max(stop) FROM e WHERE stop <= pos + (SELECT cap FROM c)) FROM k WHERE i < 7
), d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest FROM documents
), s AS (
  SELECT doc_id, size, digest, (SELECT count(*) FROM k WHERE i > 0 AND k.pos < e.stop)::INTEGER AS shard FROM d JOIN e USING (digest)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id::VARCHAR), 1, 3), doc_id, digest) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s JOIN r USING (digest)
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.decontamination_cgk import with_leaks

    found = with_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.start", "leak.length", "leak.edits")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.html_gbt import main_texts

    return main_texts(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op11_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.kneser_ney import judged, scored

    done = judged(scored(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits", "lower", "upper")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.fill_middle import fill_middle, restored

    done = fill_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
       WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b FROM k),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veridex.llm.pivot_negatives import mined

    return mined(_table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.w, b.w)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 5
"""


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_fingerprints": op2_fingerprints, "op3_chat_preference": op3_chat_preference, "op4_url_filter": op4_url_filter, "op5_packing": op5_packing, "op6_jaccard_forest": op6_jaccard_forest, "op7_warc": op7_warc, "op8_sharding": op8_sharding, "op9_decontamination": op9_decontamination, "op10_html_extraction": op10_html_extraction, "op11_ngram_rules": op11_ngram_rules, "op12_fill_middle": op12_fill_middle, "op13_hard_negatives": op13_hard_negatives}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_preference": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_warc": OP7_SQL, "op8_sharding": OP8_SQL, "op12_fill_middle": OP12_SQL, "op13_hard_negatives": OP13_SQL}
