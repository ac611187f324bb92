"""The registered queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwise.session import scratch_path

from . import collocations, html_text, language_id, licenses, line_dedup, mixing, near_dups, neighbours, pieces, quality, repeats, token_store, turn_trie
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


NEAR_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 1], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) c ON c.v = d.doc_id
"""


@query("op9_near_duplicates", NEAR_SQL)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=2)


QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM documents),
t AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
p AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS run, lead(x, 4) OVER o AS fifth, x = lead(x, 1) OVER o AS echo
      FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM p WHERE fifth IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY doc_id),
h AS (SELECT doc_id, count(*) FILTER (echo) AS n FROM p GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(h.n, 0) AS n_echoes
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_echoes > 30 * n_words) AS kept
FROM m
"""


@query("op6_quality_rules", QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its new text's size and checksum."""
    out = line_dedup.drop_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


@query("op3_mix_sources")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.interleaved(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("row.doc_id", "mix_source", "mix_block", "mix_place")


def tokenizer_file(name: str) -> str:
    """A public vocabulary file, where the workers have it too."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_sentencepiece_samples")
def op2_sentencepiece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document: their ids, probabilities and inclusion scores."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op1_token_store")
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), path)
    return token_store.read(spark, path)


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.predict(docs, model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a source's tree, their places derived from their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    folder = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 2000), F.floor(F.col("doc_id") / 100) % 20)
    # Every tenth document is the license file of its directory, or of one above.
    place = (
        F.when(F.col("doc_id") % 70 == 0, F.concat_ws("/", "source", F.lit("LICENSE")))
        .when(F.col("doc_id") % 30 == 0, F.concat_ws("/", "source", F.floor(F.col("doc_id") / 2000), F.lit("COPYING")))
        .when(F.col("doc_id") % 10 == 0, F.concat_ws("/", folder, F.lit("LICENSE.txt")))
        .otherwise(F.concat_ws("/", folder, F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt"))))
    )
    return licenses.scan(docs.withColumn("path", place))


COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, k, unnest([array_to_string(ws[i : i + k - 1], ' ') FOR i IN generate_series(1, len(ws) - k + 1)]) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
g AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
x AS (SELECT lang, k, phrase, a, i, array_to_string(ws[1 : i], ' ') AS head, array_to_string(ws[i + 1 :], ' ') AS tail
      FROM (SELECT *, unnest(generate_series(1, k - 1)) AS i FROM c)),
s AS (SELECT x.*, u.f AS l, v.f AS r, ((1000000::HUGEINT * a * a) // (u.f::HUGEINT * v.f))::BIGINT AS score
      FROM x JOIN g u ON u.lang = x.lang AND u.phrase = head JOIN g v ON v.lang = x.lang AND v.phrase = tail),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
d AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(m.phrase)) AS rank, m.phrase, a, l, r, n, score
FROM m JOIN t USING (lang) LEFT JOIN d ON d.lang = m.lang AND d.phrase = m.phrase AND m.k = 2
WHERE coalesce(100 * most < 50 * a, true)
QUALIFY rank <= 2000
"""


@query("op11_collocations", COLLOCATION_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS b, octet_length(b) AS n_bytes FROM documents),
p AS (SELECT k, i, md5_number(array_slice(b, i + 1, i + 400)) AS w FROM (SELECT k, b, unnest(generate_series(0, n_bytes - 400)) AS i FROM d)),
r AS (SELECT w FROM p GROUP BY w HAVING count(*) > 1),
m AS (SELECT k, i FROM p SEMI JOIN r USING (w)),
g AS (SELECT k, i, coalesce(i > lag(i) OVER (PARTITION BY k ORDER BY i) + 400, true) AS fresh FROM m),
s AS (SELECT k, i, sum(fresh::INT) OVER (PARTITION BY k ORDER BY i) AS run FROM g),
b AS (SELECT k, run, min(i) AS a, max(i) + 400 AS z FROM s GROUP BY ALL),
e AS (SELECT k, a, z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM b),
c AS (SELECT k, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(array_slice(b, before + 1, a)), '' ORDER BY a) AS kept FROM e JOIN d USING (k) GROUP BY k)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(array_slice(b, coalesce(last, 0) + 1, n_bytes)))) AS kept_sha256
FROM d LEFT JOIN c USING (k)
"""


@query("op13_repeated_strings", REPEATS_SQL)
def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


TRIE_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(4294967295::BIGINT, list_reduce(list_transform(generate_series(1, length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
        lambda c, b: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295::BIGINT)) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS own, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.i <= c.h
      UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
l AS (SELECT c.conv_id, coalesce(t, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, i) AS t FROM r GROUP BY conv_id) USING (conv_id)),
n AS (SELECT turns[1 : d] AS k, d, count(*) AS n_convs, min(conv_id) AS conv_id FROM (SELECT *, unnest(generate_series(0, len(turns))) AS d FROM l) GROUP BY ALL),
b AS (SELECT k[1 : d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(k[d].text) ELSE 0 END AS own FROM n LEFT JOIN b USING (k)),
s AS (SELECT k[1 : a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM m) GROUP BY ALL),
e AS (SELECT turns AS k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM l GROUP BY turns)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN s ON s.k = m.k LEFT JOIN e ON e.k = m.k LEFT JOIN n p ON m.d > 0 AND p.d = m.d - 1 AND p.k = m.k[1 : m.d - 1]
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose first turns come from one of a hundred."""
    turns = turn_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return turn_trie.prefix_trie(*turn_trie.with_heads_of(turns, F.col("conv") - F.col("conv") % 100, shared, 5))
