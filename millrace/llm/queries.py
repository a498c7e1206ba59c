"""The thin queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokenizer_file

Query = Callable[[SparkSession, str], DataFrame]


def held_out():
    """Documents that language ID must not learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict_language, train_model

    docs = table(spark, sf_dir, "documents")
    model = train_model(docs, train=F.coalesce(~held_out(), F.lit(False)))
    out = predict_language(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_jpeg import decode_media, store_media

    stored = store_media(table(spark, sf_dir, "documents"))
    return decode_media(stored, tensors=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_entities

    return replace_entities(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair

    return repair(table(spark, sf_dir, "conversations"), damage=True)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_id, op2_ngram_join, op3_embedding_dedup, op4_media_jpeg, op5_mixing, op6_warc, op7_secret_scan, op8_pii_surrogates, op9_sentencepiece, op10_quality, op11_conversation_repair, op12_nearest_neighbours, op13_prefix_trie)}

OP5_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM per
), live AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k FROM ranked WHERE source_size > 0
), steps AS (
  SELECT k, 2.0::DOUBLE * source_size / w AS ratio,
    coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS w_left
  FROM live
), level AS (
  SELECT coalesce((SELECT ((1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE - capped) / w_left)
    FROM steps WHERE ratio > (1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE - capped) / w_left ORDER BY k LIMIT 1), 0.0::DOUBLE) AS v
), targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT v FROM level) * w::DOUBLE)::DOUBLE AS target FROM ranked
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size::DOUBLE, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(sha256('mix-1' || chr(31) || coalesce(d.doc_id::VARCHAR, chr(0))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""

OP6_SQL = """
WITH base AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), first AS (
  SELECT payload_digest, min(page_id) AS f FROM base WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT b.page_id, b.payload_bytes, b.payload_digest,
  CASE WHEN b.page_id > f.f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b.page_id > f.f THEN f.f END AS refers_to
FROM base b LEFT JOIN first f ON b.payload_digest = f.payload_digest AND b.payload_bytes >= 100
"""

OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s), t AS (SELECT doc_id, unnest(sh) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n_shingles + y.n_shingles - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, label) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n_shingles, min(r.label) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0 AS good FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND a.good AND b.good WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id
), m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""


#: CRC-32 of an ASCII text {}, bit by bit.
CRC_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda b, y: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384::BIGINT) ELSE b // 2 END)))"""

OP11_SQL = """
WITH RECURSIVE marked AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    CRC % 20 AS mark FROM conversations
), damaged AS (
  SELECT c, turn, CASE WHEN mark = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN mark = 1 THEN '' WHEN mark = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN mark = 3 THEN [0, 1] ELSE [0] END) AS copy FROM marked WHERE mark != 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged
), rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY pos) AS before FROM placed
), gaps(p, q, k) AS (
  VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)
), moves(p, q, role) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')
), edits AS (
  SELECT c, pos, m.p, m.q, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cost, 'K' AS letter FROM rows JOIN moves m ON m.role = i WHERE fault IN ('', 't')
  UNION ALL SELECT c, pos, m.p, m.q, CASE WHEN fault = 't' THEN 3 ELSE 2 END, 'R' FROM rows CROSS JOIN moves m WHERE fault IN ('', 't') AND m.role != 's'
  UNION ALL SELECT c, pos, g.p, g.q, 3, 'D' FROM rows CROSS JOIN gaps g WHERE g.p = g.q
), least AS (
  SELECT e.c, e.pos, e.p, g.q, min((lpad((e.cost + 2 * g.k)::VARCHAR, 9, '0') || e.letter || repeat('I', g.k))) AS best
  FROM edits e JOIN gaps g ON g.p = e.q GROUP BY ALL
), paths AS (
  SELECT DISTINCT c, 0::BIGINT AS pos, g.q AS s, 2 * g.k AS cost, repeat('I', g.k) AS audit FROM rows CROSS JOIN gaps g WHERE g.p = 0
  UNION ALL
  SELECT c, pos, s, substr(best, 1, 9)::INT, substr(best, 10) FROM (
    SELECT h.c, l.pos, l.q AS s, min(lpad((h.cost + substr(l.best, 1, 9)::INT)::VARCHAR, 9, '0') || h.audit || substr(l.best, 10)) AS best
    FROM paths h JOIN least l ON l.c = h.c AND l.pos = h.pos + 1 AND l.p = h.s GROUP BY h.c, l.pos, l.q)
), ended AS (
  SELECT p.c, min(lpad(p.cost::VARCHAR, 9, '0') || p.audit) AS best FROM paths p JOIN (SELECT c, max(pos) AS last FROM rows GROUP BY c) m ON m.c = p.c AND m.last = p.pos WHERE p.s IN (0, 3) GROUP BY p.c
), audits AS (
  SELECT c, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM ended
), letters AS (
  SELECT c, audit, unnest(range(1, length(audit) + 1)) AS n FROM audits
), sited AS (
  SELECT c, n, substr(audit, n, 1) AS letter, length(replace(substr(audit, 1, n), 'I', '')) AS pos,
    length(replace(substr(audit, 1, n), 'D', '')) - 1 + length(replace(audit, 'D', '')) % 2 AS seat FROM letters
), texts AS (
  SELECT s.c, string_agg(CASE WHEN letter = 'K' THEN r.role WHEN seat % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY n) AS whole
  FROM sited s LEFT JOIN rows r ON r.c = s.c AND r.pos = s.pos WHERE letter != 'D' GROUP BY s.c
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c
)
SELECT o.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
  coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(a.cost, 0)::BIGINT AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) o LEFT JOIN counts n ON n.c = o.c LEFT JOIN audits a ON a.c = o.c LEFT JOIN texts t ON t.c = o.c
""".replace("CRC", CRC_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))

OP12_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::DOUBLE AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id != q.vec_id AND len(q.e) = len(v.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP13_SQL = """
WITH p AS (
  SELECT conv_id, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS b,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, CRC % 9 AS h FROM (SELECT DISTINCT conv_id FROM p)
), u AS (
  SELECT c.conv_id, 0 AS own, p.pos, p.t, p.b FROM c JOIN p ON p.conv_id = c.conv_id - c.conv_id % 5 AND p.pos < c.h
  UNION ALL SELECT c.conv_id, 1, p.pos, p.t, p.b FROM c JOIN p ON p.conv_id = c.conv_id AND p.pos >= c.h
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS j FROM u
), s AS (SELECT conv_id, count(*) AS len, list(sha256(t) ORDER BY j) AS l FROM n GROUP BY conv_id
), x AS (
  SELECT s.conv_id, n.j AS depth, s.len, array_to_string(s.l[1:n.j], ',') AS path, array_to_string(s.l[1:n.j - 1], ',') AS up, n.b FROM s JOIN n ON n.conv_id = s.conv_id
  UNION ALL SELECT c.conv_id, 0, coalesce(s.len, 0), '', NULL, 0 FROM c LEFT JOIN s ON s.conv_id = c.conv_id
), nodes AS (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS saved, max(len) = depth AS leaf,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '') AS ends FROM x GROUP BY depth, path
), below AS (
  SELECT a.path, sum(w.saved) AS saved, count(*) FILTER (WHERE w.leaf) AS leaves
  FROM (SELECT DISTINCT x.path AS at, y.path FROM x JOIN x y ON y.conv_id = x.conv_id AND y.depth <= x.depth) a JOIN nodes w ON w.path = a.at GROUP BY a.path
), kids AS (SELECT up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up)
SELECT v.conv_id, v.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM nodes v JOIN below t ON t.path = v.path LEFT JOIN nodes o ON o.path = v.up LEFT JOIN kids k ON k.path = v.path
""".replace("CRC", CRC_SQL.format("conv_id::VARCHAR"))

ORACLES: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op6_warc": OP6_SQL, "op5_mixing": OP5_SQL, "op11_conversation_repair": OP11_SQL, "op12_nearest_neighbours": OP12_SQL, "op13_prefix_trie": OP13_SQL}
