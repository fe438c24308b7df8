"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, embeddings, jaccard, language, lines, merkle, packing, pii, repeats, tokens, toxicity, windows
from .common import table


def fold_of(n: int):
    """crc32 of the id as text, modulo n: what the held-out rows are told by."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.filter(fold_of(3) != 1))
    scored = docs.withColumn("score", toxicity.score(docs, lexicon, F.col("text")))
    return scored.select("doc_id", (fold_of(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(fold_of(4) != 2), language.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    found = docs.select("doc_id", language.predict(docs, model, F.col("text")).alias("_found"))
    return found.select("doc_id", (fold_of(4) == 2).alias("held_out"), F.col("_found.lang").alias("lang_pred"), "_found.score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pii.spans(F.col("text")).alias("_found"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("_found", lambda s: s["plain"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    plain = F.filter("_found", lambda s: s["plain"])
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed(plain), 256).alias("base_sha256"), listed(F.col("_found")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", tokens.token_counts(docs, "text", public_tokenizers.path("word_bpe_49k.json")))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def gpt_pieces(docs: DataFrame) -> DataFrame:
    return packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(gpt_pieces(table(spark, sf_dir, "documents")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and whether tampered rows fail against it. A null doc_id or n_chars is never tampered with."""
    docs = table(spark, sf_dir, "documents")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    tampered = F.when(hit, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")))
    rows = merkle.manifest(docs, also={"_tampered": tampered})
    rows = rows.withColumn("folded_root", merkle.fold(F.coalesce("_tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that an earlier document has."""
    out = windows.remove_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, with a digest of the codebooks in every row."""
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_decontaminate": op6_decontaminate,
    "op7_repeats": op7_repeats,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_window_dedup": op12_window_dedup,
    "op13_vector_codes": op13_vector_codes,
}


def _product_code_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of product coding, written out one after the other."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"s AS MATERIALIZED (SELECT vec_id, label, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS p))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {entries})",
        "b0 AS MATERIALIZED (SELECT p, e, x FROM s JOIN f USING (vec_id))"]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, label, s.p, min((list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS best
  FROM s JOIN b{k} b ON s.p = b.p GROUP BY vec_id, label, s.p)""")
        if k < rounds:
            steps.append(f"""t{k} AS (SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM
  (SELECT a.p, a.best[2] AS e, unnest(s.x) AS x, generate_subscripts(s.x, 1) AS i FROM a{k} a JOIN s ON a.vec_id = s.vec_id AND a.p = s.p) GROUP BY p, e, i)""")
            steps.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS x FROM t{k} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)""")
    return f"""WITH {", ".join(steps)},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best[2]::INT), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(v, ',' ORDER BY p, e)) AS d FROM (SELECT p, e, array_to_string(x, ',') AS v FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, d AS codebooks_sha256 FROM c, h"""


ORACLE_SQL = {
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id),
full_w AS (SELECT item_id, g, string_split(g, ' ') AS ws FROM bw WHERE k = 10),
wt AS (SELECT DISTINCT g, unnest(ws) AS t, ceil(len(list_distinct(ws)) * 0.8 - 1e-9) AS need FROM full_w),
dp AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
cand AS (SELECT doc_id, g FROM (SELECT DISTINCT doc_id, t FROM dp) x JOIN wt USING (t) GROUP BY doc_id, g HAVING count(*) >= min(need)),
span AS (SELECT doc_id, g, need, count(DISTINCT t) OVER (PARTITION BY doc_id, g ORDER BY p RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS c
  FROM cand JOIN wt USING (g) JOIN dp USING (doc_id, t)),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM (SELECT DISTINCT doc_id, g FROM span WHERE c >= need) JOIN full_w USING (g) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated, coalesce(nr.n, 0)::BIGINT AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nr USING (doc_id)""",
    "op8_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS dest FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.dest = l.a),
c AS (SELECT node, min(dest) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
k AS (SELECT doc_id, count(*) AS n, list_sort(list(g)) AS gs FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY gs) AS class_id, count(*) OVER (PARTITION BY gs) AS size FROM k),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared) - 1e-9),
r AS (SELECT doc_id AS node, doc_id AS dest FROM k UNION SELECT r.node, l.b FROM r JOIN l ON r.dest = l.a),
c AS (SELECT node, min(dest) AS component FROM r GROUP BY node),
m AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(m.n, 0)::BIGINT AS n_links, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN cls USING (doc_id) LEFT JOIN m ON m.a = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, p, line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || lang, '') AS g, n_chars,
    concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS front,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars, coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS more, coalesce(strlen(text) || ':' || text, '-') AS back,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 7 = 0 AS tampered FROM documents),
l AS (SELECT doc_id, g, sha256(front || chars || back) AS leaf, CASE WHEN tampered THEN sha256(front || more || back) ELSE sha256(front || chars || back) END AS other FROM f),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
t AS (SELECT 0 AS lvl, g, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
  UNION ALL SELECT lvl + 1, g, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lvl, g, pos // 2),
q AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM q
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
own AS (SELECT p.g, p.pos, a.lvl, CASE WHEN s.h IS NULL THEN '' WHEN s.pos < a.pos THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM p JOIN t a ON a.g = p.g AND a.pos = p.pos // (1::BIGINT << a.lvl) AND a.n > 1 LEFT JOIN t s ON s.g = a.g AND s.lvl = a.lvl AND s.pos = xor(a.pos, 1)),
up AS (SELECT q.g, a.lvl, CASE WHEN s.h IS NULL THEN '' WHEN s.pos < a.pos THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM q JOIN u a ON a.pos = q.pos // (1::BIGINT << a.lvl) AND a.n > 1 LEFT JOIN u s ON s.lvl = a.lvl AND s.pos = xor(a.pos, 1)),
paths AS (SELECT g, pos, list(step ORDER BY lvl) AS path FROM own GROUP BY g, pos),
tops AS (SELECT g, list(step ORDER BY lvl) AS path FROM up GROUP BY g),
full_paths AS (SELECT p.*, subroot, list_concat(coalesce(paths.path, []), coalesce(tops.path, [])) AS path
  FROM p JOIN q ON q.g = p.g LEFT JOIN paths ON paths.g = p.g AND paths.pos = p.pos LEFT JOIN tops ON tops.g = p.g),
r AS (SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(other, path), lambda a, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root FROM full_paths)
SELECT *, folded_root = root AS verified FROM r""",
    "op12_window_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 12), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM s JOIN m USING (g) WHERE doc_id > first),
x AS (SELECT d.doc_id, count(h.p)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (h.p IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) d LEFT JOIN h ON h.doc_id = d.doc_id AND h.p = d.i GROUP BY d.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)""",
    "op13_vector_codes": _product_code_sql(),
}
