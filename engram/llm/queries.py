"""Registered queries of the text operators, each over its whole table, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import best_fit_packing, decontamination, fill_in_middle, html_extraction, license_scan, line_dedup, merkle_manifest
from engram.llm import minhash_dedup, perplexity_rules, piece_codec, pii_surrogates, quality_classifier, substring_dedup
from engram.llm.common import LOWERED, UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of similarity 0.85."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op2_minhash_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(n, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.n, d.b FROM r JOIN d ON r.m = d.a),
c AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.m AS component_id, c.m = s.doc_id AS kept FROM s JOIN c ON s.doc_id = c.n
"""


@register
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 13 words that a smaller id has too."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op10_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 's': array_to_string(w[i:i + 12], ' ')}), recursive := true) FROM w),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
b AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM g JOIN f USING (s) WHERE doc_id > m GROUP BY doc_id),
k AS (SELECT w.doc_id, w.w, coalesce(b.gone, []) AS gone, list_filter(w.w, lambda x, k: NOT list_contains(coalesce(b.gone, []), k)) AS kept FROM w LEFT JOIN b USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


@register
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document lie in windows of the benchmark."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op1_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 's': array_to_string(w[i:i + n - 1], ' ')}}), recursive := true) FROM d CROSS JOIN (SELECT DISTINCT n FROM iw)),
h AS (SELECT doc_id, i, n, s FROM dw SEMI JOIN iw USING (n, s)),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h JOIN iw USING (n, s)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""


@register
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without runs of lines that start earlier too."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op5_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'i': i}), recursive := true) FROM documents),
n AS (SELECT doc_id, i, trim(line, concat(' ', chr(9), chr(13), chr(11), chr(12))) AS t FROM l WHERE t <> ''),
k AS (SELECT doc_id, i, t, row_number() OVER o AS k, lead(t) OVER o AS t2, lead(i) OVER o AS i2 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT t, t2, min((doc_id, k)) AS m FROM k WHERE t2 IS NOT NULL GROUP BY ALL),
g AS (SELECT doc_id, i, i2 FROM k JOIN f USING (t, t2) WHERE (doc_id, k) > m),
one AS (SELECT doc_id, i, k, t FROM k WHERE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 50),
m AS (SELECT t, min((doc_id, k)) AS m FROM one GROUP BY t),
x AS (SELECT doc_id, i FROM g UNION SELECT doc_id, i2 FROM g UNION SELECT doc_id, i FROM one JOIN m USING (t) WHERE (doc_id, k) > m),
r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM x)) AS kept FROM l GROUP BY doc_id)
SELECT doc_id, (SELECT count(*) FROM n WHERE n.doc_id = r.doc_id) AS n_lines, (SELECT count(*) FROM x WHERE x.doc_id = r.doc_id) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r
"""


@register
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, and whether rules and perplexity keep it."""
    return perplexity_rules.quality_rules(table(spark, sf_dir, "documents"))


@register
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


@register
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@register
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data."""
    return pii_surrogates.surrogates(table(spark, sf_dir, "documents"))


@register
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle form, by digests of output and restored text."""
    return fill_in_middle.round_trip(table(spark, sf_dir, "documents"))


SQL["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: list_reduce(list_transform(range(k, k + 8), lambda j: CAST(instr('0123456789abcdef', substr(h, j, 1)) - 1 AS BIGINT)), lambda a, b: a * 16 + b)) AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


@register
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its tampered text is noticed."""
    return merkle_manifest.verify(table(spark, sf_dir, "documents"))


_FIELDS = ", ".join(f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
SQL["op12_merkle_manifest"] = rf"""
WITH RECURSIVE c AS (SELECT *, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(a, x)), 4294967295) AS crc FROM documents),
l AS (SELECT row_number() OVER () AS r, doc_id, source, xor(crc, 4294967295) % 5 = 0 AS tampered,
    sha256(concat({_FIELDS}, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat({_FIELDS}, coalesce(concat(strlen(text), ':', translate(text, '{UPPER}', '{LOWERED}')), '-'))) AS other FROM c),
k AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM l),
up(lvl, g, k, h, n) AS (SELECT 0, g, k, leaf, count(*) OVER (PARTITION BY g) FROM k
    UNION ALL SELECT lvl + 1, g, k // 16, sha256(string_agg(h, '' ORDER BY k)), any_value((n + 15) // 16) FROM up WHERE n > 1 GROUP BY lvl, g, k // 16),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS k FROM up WHERE n = 1),
top(lvl, k, h, n) AS (SELECT 0, k, h, count(*) OVER () FROM s
    UNION ALL SELECT lvl + 1, k // 16, sha256(string_agg(h, '' ORDER BY k)), any_value((n + 15) // 16) FROM top WHERE n > 1 GROUP BY lvl, k // 16),
heights AS (SELECT g, max(lvl) AS top FROM up GROUP BY g),
nodes AS (SELECT g, lvl, k, h FROM up WHERE n > 1 UNION ALL SELECT s.g, heights.top + top.lvl, top.k, top.h FROM s JOIN heights USING (g) CROSS JOIN top WHERE top.n > 1),
ends AS (SELECT g, lvl, k, coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, k // 16 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, lvl, k // 16 ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM nodes),
fold(r, g, lvl, top, k, rank, acc, proof) AS (SELECT k.r, k.g, 0, heights.top, k.k, s.k, CASE WHEN tampered THEN other ELSE leaf END, '' FROM k JOIN heights USING (g) JOIN s USING (g)
    UNION ALL SELECT r, fold.g, fold.lvl + 1, top, CASE WHEN fold.lvl + 1 = top THEN rank ELSE fold.k // 16 END, rank, sha256(concat(a, acc, b)), concat(proof, a, b)
    FROM fold JOIN ends ON ends.g = fold.g AND ends.lvl = fold.lvl AND ends.k = CASE WHEN fold.lvl = top THEN rank ELSE fold.k END),
last AS (SELECT r, arg_max(acc, lvl) AS acc, arg_max(proof, lvl) AS proof FROM fold GROUP BY r),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT k.doc_id, k.leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM k JOIN last USING (r) JOIN s USING (g) CROSS JOIN root
"""


@register
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, by digests."""
    return piece_codec.round_trip(table(spark, sf_dir, "documents"))
