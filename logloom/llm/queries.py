"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, pii_digest

    return pii_digest(find_pii(table(spark, sf_dir, "documents"), with_text=False))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op4_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .subword_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination_digest, decontaminate

    return contamination_digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture_digest, round_trip

    pages = table(spark, sf_dir, "pages")
    return capture_digest(round_trip(pages), pages)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), with_spans=False)


def op11_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .row_patterns import find_pattern, pattern_digest

    return pattern_digest(find_pattern(table(spark, sf_dir, "clicks")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, middle_digest

    return middle_digest(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from .common import shared_dir
    from .token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), f"{shared_dir(spark)}/logloom/tokens-{uuid.uuid4().hex}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_pii, op3_jaccard_join, op4_subword_lm, op5_decontamination, op6_mixing, op7_quality_rules, op8_token_counts, op9_warc, op10_suffix_dedup, op11_row_patterns, op12_fill_in_middle, op13_token_files)}
ORACLES: dict[str, str] = {
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
one AS (SELECT k, min(doc_id) AS class_id, min(n) AS n FROM c GROUP BY k),
t AS (SELECT s.doc_id, g FROM s JOIN one ON s.doc_id = class_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN one x1 ON a = x1.class_id JOIN one x2 ON b = x2.class_id WHERE 100 * x >= 90 * (x1.n + x2.n - x)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk(a, b) AS (SELECT class_id, class_id FROM one UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a), q AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, one.class_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN one USING (k) LEFT JOIN m ON m.a = one.class_id LEFT JOIN q ON q.a = one.class_id""",
    "op10_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS g FROM h, unnest(range(0, n - 99)) AS r(i) WHERE n >= 100),
f AS (SELECT g, min({'d': doc_id, 'i': i}) AS first FROM w GROUP BY g HAVING count(*) > 1),
again AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE {'d': doc_id, 'i': i} <> first),
b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM again),
r AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b) GROUP BY doc_id, run),
k AS (SELECT doc_id, s, e, x, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS pe FROM r JOIN h USING (doc_id)),
o AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * pe + 1, 2 * (s - pe)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM h LEFT JOIN o USING (doc_id)""",
    "op5_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(i)),
m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_row_patterns": """
WITH RECURSIVE r AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
o AS (SELECT client_id, click_id, ts, kind, CAST(floor(100 * value + 0.5) AS BIGINT) AS c, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS k FROM r),
p AS (SELECT *, c IS NOT NULL AND coalesce(lag(c) OVER w IS NOT NULL AND ts <= lag(ts) OVER w + INTERVAL 10 MINUTE, false) AS near, lag(c) OVER w AS pc FROM o WINDOW w AS (PARTITION BY client_id ORDER BY k)),
f AS (SELECT *, near AND coalesce(kind <> 'error', false) AND c <> pc AS step, near AND coalesce(kind = 'purchase', false) AS goal FROM p),
g AS (SELECT *, sum(CASE WHEN step THEN 0 ELSE 1 END) OVER (PARTITION BY client_id ORDER BY k) AS run FROM f),
m AS (SELECT a.client_id, a.k AS s, min(b.k) AS e FROM g a JOIN g b ON a.client_id = b.client_id AND b.goal AND b.k > a.k AND b.c >= a.c AND (b.run = a.run OR b.run = a.run + 1 AND NOT b.step) WHERE a.c IS NOT NULL GROUP BY ALL),
n AS (SELECT a.client_id, a.s, a.e, b.s AS then_s FROM m a ASOF LEFT JOIN m b ON a.client_id = b.client_id AND a.e < b.s),
walk(client_id, s, e, then_s, match_no) AS (
  SELECT client_id, s, e, then_s, CAST(1 AS BIGINT) FROM n WHERE (client_id, s) IN (SELECT (client_id, min(s)) FROM n GROUP BY client_id)
  UNION ALL SELECT n.client_id, n.s, n.e, n.then_s, match_no + 1 FROM walk JOIN n ON n.client_id = walk.client_id AND n.s = walk.then_s)
SELECT w.client_id, match_no, min_by(click_id, k) AS first_id, max_by(click_id, k) AS last_id, count(*) AS n_rows, CAST(sum(c) AS BIGINT) AS sum_cents,
       sha256(string_agg(CASE WHEN k = s THEN 'A' WHEN k = e THEN 'P' WHEN c < pc THEN 'D' ELSE 'U' END, '' ORDER BY k)) AS labels_sha256
FROM walk w JOIN g ON g.client_id = w.client_id AND g.k BETWEEN s AND e GROUP BY w.client_id, match_no""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
n AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1 : low], '') AS a, array_to_string(u[low + 1 : high], '') AS b, array_to_string(u[high + 1 :], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_page <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_page <> d.page_id THEN f.first_page END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)""",
}
