"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import best_fit, bpe, html_text, licences, line_dedup, near_dedup, packing, quality_model, ranked_search, turns, warc, webp
from tesserae.llm import quality_rules as rules
from tesserae.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_duplicate_lines(table(spark, sf_dir, "documents", "doc_id", "text"), removed="n_removed")
    return left.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents", "doc_id", "text")).drop("row")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.bpe_encode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return bpe.bpe_decode(encoded, tokenizer_path()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256")
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("cls")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_features(webp.to_media(table(spark, sf_dir, "documents", "doc_id", "text")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turns.damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return turns.digests(turns.repair(damaged)).withColumnRenamed("conv", "conv_id")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.pack_best_fit(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents", "doc_id", "text"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_html_extraction, op2_line_dedup, op3_licence_scan, op4_warc, op5_bpe, op6_packing,
        op7_minhash_near_dedup, op8_quality_classifier, op9_quality_rules, op10_media_columns,
        op11_conversation_repair, op12_best_fit_packing, op13_ranked_search, pipeline,
    )
    return {f.__name__: f for f in each}


_OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM pos),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)
             + (CASE WHEN n_words >= 10 AND 100 * n_upper > 60 * word_chars THEN 64 ELSE 0 END) AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (bits & 3) <> 0 AS base_failed,
       bits = 0 AS kept, CAST(bits AS BIGINT) AS fail_bits, 'v1' AS policy FROM b
"""


_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS g FROM p),
f AS (SELECT g, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY g)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.g AS payload_digest,
       CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.g = f.g AND d.n >= 100
"""


#: The tables' pages mark their article and have these character references alone.
_OP1 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(replace(replace(h, '<b>', ''), '</b>', ''), '<[^>]+>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS h FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM d),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
o AS (SELECT *, len(ws) AS n, row_number() OVER (ORDER BY doc_id, line) AS place FROM w),
f AS (SELECT place, hash(array_to_string(ws, ' ')) AS v, 0 AS near FROM o WHERE n > 0
      UNION ALL SELECT place, hash(array_to_string(ws, ' ')), 1 FROM o WHERE n >= 8
      UNION ALL SELECT place, hash(array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ')), 1 FROM (SELECT place, ws, unnest(range(1, n + 1)) AS i FROM o WHERE n >= 8)),
e AS (SELECT v, near, min(place) AS first FROM f GROUP BY v, near),
g AS (SELECT DISTINCT place FROM f JOIN e USING (v, near) WHERE first < place),
k AS (SELECT doc_id, count(g.place) AS n_removed, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE g.place IS NULL), '') AS kept FROM o LEFT JOIN g ON g.place = o.place GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(CASE WHEN d.text IS NOT NULL THEN length(kept) END AS BIGINT) AS n_chars_left, CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS text_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM w),
u AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
t AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT x, y FROM t UNION SELECT r.x, t.y FROM r JOIN t ON r.y = t.x),
c AS (SELECT x AS doc_id, min(y) AS least FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id, coalesce(c.least, s.doc_id) >= s.doc_id AS kept FROM s LEFT JOIN c ON c.doc_id = s.doc_id
"""


def _edit(state: str, cost: str, letter: str) -> str:
    """A state's best edits (cost in six digits, then letters) and one more."""
    return f"lpad(CAST(CAST(left({state}, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({state}, 7) || '{letter}'"


def _turned(state: str, initial: str) -> str:
    """Keeping or renaming a turn from a state that the initial may follow."""
    return f"CASE WHEN stays AND initial = '{initial}' THEN {_edit(state, 'extra', 'K')} END, CASE WHEN stays THEN {_edit(state, '2 + extra', 'R')} END"


#: Forward over turns with the best edits of each state, where the operator goes backward; crc32 bit by bit.
_OP11 = rf"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS t),
k AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, * FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM k, crc),
e AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
        unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM e),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS (SELECT *, fault IN ('', 'truncated') AS stays, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS extra FROM f),
a AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000002I' AS s2, '000004II' AS s3 FROM conversations
  UNION ALL SELECT conv_id, i, s0, s1, least(n2, n3i) AS s2, least(s3, {_edit("least(n2, n3i)", "2", "I")}) AS s3
  FROM (SELECT *, least(s2, {_edit("s0", "2", "I")}, {_edit("s1", "2", "I")}) AS n2, {_edit("s3", "2", "I")} AS n3i FROM
    (SELECT a.conv_id, r.i, {_edit("s0", "3", "D")} AS s0, least({_edit("s1", "3", "D")}, CASE WHEN stays AND initial = 's' THEN {_edit("s0", "extra", "K")} END) AS s1,
       least({_edit("s2", "3", "D")}, {_turned("s0", "u")}, {_turned("s1", "u")}, {_turned("s3", "u")}) AS s2, least({_edit("s3", "3", "D")}, {_turned("s2", "a")}) AS s3
     FROM a JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = a.i + 1))),
b AS (SELECT conv_id, least(arg_max(s0, i), arg_max(s3, i)) AS best FROM a GROUP BY conv_id),
l AS (SELECT conv_id, substr(best, 7) AS audit, unnest(range(7, length(best) + 1)) - 6 AS p FROM b),
g AS (SELECT *, audit[p] AS edit, length(regexp_replace(left(audit, p), 'I', '', 'g')) AS i, length(regexp_replace(left(audit, p), 'D', '', 'g')) AS place FROM l),
y AS (SELECT g.conv_id, g.p, g.edit, g.place, r.role, r.text, max(CASE WHEN g.place = 1 AND g.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g.conv_id) AS led
      FROM g LEFT JOIN r ON g.edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i WHERE g.edit <> 'D'),
z AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM y GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM b.conv_id
"""

_OP13 = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM n),
m AS (SELECT doc_id, 25 + 75 * n * docs // tokens AS m FROM n, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": _OP11, "op13_ranked_search": _OP13, "op1_html_extraction": _OP1, "op2_line_dedup": _OP2, "op4_warc": _OP4, "op7_minhash_near_dedup": _OP7, "op9_quality_rules": _OP9}
