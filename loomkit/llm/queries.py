"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomkit.llm.common import ORACLES, QUERIES, register, table  # noqa: F401


@register("op2_quality_rules")
def op2(spark, sf):
    from loomkit.llm.quality import quality_rules
    return quality_rules(table(spark, sf, "documents"))


@register("op6_minhash_near_dedup")
def op6(spark, sf):
    from loomkit.llm.minhash import minhash_groups
    return minhash_groups(table(spark, sf, "documents"), width=4)


@register("op7_language_id")
def op7(spark, sf):
    from loomkit.llm.langid import identify
    return identify(table(spark, sf, "documents"), declared=F.col("lang"), host=F.col("source"))


@register("language_id_pages")
def language_pages(spark, sf):
    from loomkit.llm.langid import identify, page_language, page_text
    pages = table(spark, sf, "pages").withColumn("plain", page_text(F.col("html")))
    return identify(pages, "page_id", "plain", declared=page_language(F.col("html")), url=F.col("url")) \
        .withColumnRenamed("doc_id", "page_id")


@register("op9_packing")
def op9(spark, sf):
    from loomkit.llm.packing import pack_documents
    return pack_documents(table(spark, sf, "documents")).drop("ids")


@register("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


def _op1_sql() -> str:
    from loomkit.llm.licences import oracle
    return oracle()


@register("op1_license_rules", _op1_sql())
def op1(spark, sf):
    from loomkit.llm.licences import scan_licences
    return scan_licences(table(spark, sf, "documents"))


@register("op3_html_extraction")
def op3(spark, sf):
    from loomkit.llm.html_extract import extract_main_text
    return extract_main_text(table(spark, sf, "pages"))


@register("op4_vector_approximation", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""")
def op4(spark, sf):
    from loomkit.llm.vafile import exact_top_k
    return exact_top_k(table(spark, sf, "embeddings"), lambda i: i % 20 == 0)


@register("op5_sentencepiece_fst")
def op5(spark, sf):
    from loomkit.llm.fst import round_trip
    return round_trip(table(spark, sf, "documents"))


@register("op8_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
h AS (SELECT page_id, octet_length(raw) AS payload_bytes, raw, max(page_id) OVER (PARTITION BY raw) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(bits, 1 + 5 * k, 5)) AS INTEGER), 1),
          '' ORDER BY k) FROM range(32) t(k)) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM (SELECT *, CAST(CAST(unhex(sha1(raw)) AS BIT) AS VARCHAR) AS bits FROM h)""")
def op8(spark, sf):
    from loomkit.llm.warc import archive_round_trip
    return archive_round_trip(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ESC = r"replace(replace(replace({}, '\', '\\'), '#', '\#'), '<', '\<')"


@register("op10_reply_trees", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(replace({_ESC.format('role')}, ':', '\:')) + length({_ESC.format('text')})) AS BIGINT)
    AS formatted_chars
FROM t GROUP BY conv_id""")
def op10(spark, sf):
    from loomkit.llm.chat import format_branches, linear_replies, read_back
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return read_back(format_branches(linear_replies(turns.unionByName(extra)), best=1))


# long columns with nulls reach pandas as doubles; the SQL below casts them to the same
_CRC_TABLE = """SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i)"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 of ``text``, with ``t`` of ``_CRC_TABLE`` in scope."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))),
    lambda pos: CAST('0x' || substr(hex(encode({text})), 2 * pos + 1, 2) AS BIGINT))),
    lambda crc, byte: xor(crc >> 8, t[1 + (xor(crc, byte) & 255)])))"""


@register("op12_conversation_trie", rf"""
WITH tab AS ({_CRC_TABLE}),
o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
          md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h, c - c % 20 AS base FROM (SELECT DISTINCT c FROM o), tab),
heads AS (SELECT ids.c, o.p, o.r, o.x FROM ids JOIN o ON o.c = ids.base AND o.p <= ids.h),
m AS (SELECT ids.c, h, count(heads.p) AS m FROM ids LEFT JOIN heads USING (c) GROUP BY ALL),
t AS (SELECT * FROM heads UNION ALL SELECT c, p - h + m, r, x FROM o JOIN m USING (c) WHERE p > h),
k AS (SELECT c, p AS d, string_agg(md5(length(r) || ':' || r || x), '') OVER (PARTITION BY c ORDER BY p) AS k,
        len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t
      UNION ALL SELECT c, 0, '', 0 FROM ids),
last AS (SELECT c, max(d) AS n FROM k GROUP BY c),
n AS (SELECT d, k, any_value(w) AS w, count(*) AS n_convs, min(c) AS conv_id,
        string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends
      FROM k JOIN last USING (c) GROUP BY d, k),
kids AS (SELECT d - 1 AS d, substr(k, 1, CAST(32 * (d - 1) AS BIGINT)) AS k, count(*) AS n_children
         FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)),
below AS (SELECT k.d, k.k, sum((f.n_convs - 1) * f.w) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
          FROM f JOIN k ON k.c = f.conv_id AND k.d <= f.d GROUP BY k.d, k.k)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, CAST(up.conv_id AS DOUBLE) AS parent_conv_id, f.n_convs, f.n_children,
  leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN below USING (d, k)
LEFT JOIN n up ON f.d > 0 AND up.d = f.d - 1 AND up.k = substr(f.k, 1, CAST(32 * (f.d - 1) AS BIGINT))""")
def op12(spark, sf):
    from loomkit.llm.trie import ordered_turns, prefix_trie, shared_openings
    return prefix_trie(shared_openings(ordered_turns(table(spark, sf, "conversations"))))


@register("op13_spelling_variants", rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w
         FROM documents),
low AS (SELECT id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
        FROM runs WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, c, {_crc32("id || ':' || w")} AS h FROM low, tab),
said AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word,
           c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM said GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5),
cut AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT x.word, y.word AS near, y.n AS m FROM cut x JOIN cut y ON x.a || '*' || x.b = y.a || '*' || y.b
           AND x.word <> y.word
         UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = a || b
         UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = a || b),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS form, max(m) AS m FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN form END AS form,
        CASE WHEN m >= 5 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, 0 AS step FROM f
       UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, CAST(form_n AS DOUBLE) AS form_n
FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word) USING (word)""")
def op13(spark, sf):
    from loomkit.llm.spelling import spelling_groups
    return spelling_groups(table(spark, sf, "documents"))


@register("op11_personal_data")
def op11(spark, sf):
    from loomkit.llm.pii import find_personal_data, span_digests
    return span_digests(find_personal_data(table(spark, sf, "documents")))
