"""The registered queries of this package and their SQL; every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import chat, decontam, exactspans, linededup, neardup, packing, passages, phrases, pii, quality, rans, toxicity, trie
from claimspark.llm.common import documents
from claimspark.session import shared_scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


@query("op1_minhash_near_dedup", NEARDUP_SQL)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, pos, lines[pos] AS line
  FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))
), common AS (
  SELECT line, min(doc_id) AS first_doc FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT site) >= {linededup.MIN_SITES}
), firsts AS (
  SELECT l.line, first_doc, min(pos) AS first_pos FROM l JOIN common c ON l.line = c.line AND l.doc_id = c.first_doc GROUP BY ALL
), kept AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NULL OR (l.doc_id = f.first_doc AND l.pos = f.first_pos) AS stays FROM l LEFT JOIN firsts f ON l.line = f.line
)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays) IS NULL AS emptied, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed
FROM kept GROUP BY doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return d.select("doc_id", (F.col("_n_lines") == F.col("_n_removed")).alias("emptied"), F.coalesce("text", F.lit("")).alias("text"),
                    F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(greatest(turn, 0) // {chat.PART_TURNS}, 0) AS part, replace(coalesce(role, 'unknown'), '<|', '< |') AS role,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), d AS (
  SELECT t.*, p.participant, t.role = p.participant AS own,
         '<|' || CASE WHEN t.role = p.participant THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || '|>' || chr(10) AS head
  FROM t JOIN (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system') p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, length(head) + length(text) + 8 AS size,
         coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, part, participant ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM d
)
SELECT conv_id, part, participant, count(*) AS n_turns, string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg((pos + length(head))::VARCHAR || '-' || (pos + size - 1)::VARCHAR, ',' ORDER BY pos) FILTER (WHERE own), '') AS mask
FROM o GROUP BY ALL
"""


@query("op3_perspective_rotation", CHAT_SQL)
def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chat.rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.array_join(F.zip_with("mask_starts", "mask_ends", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))), ",")
    return d.select("conv_id", "part", "participant", "n_turns", "text", mask.alias("mask"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactspans.remove_repeats(documents(spark, sf_dir)).drop("kept")


PII_KEY = "example key, replaced in production"


@query("op5_feistel_pseudonyms")
def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)
    return d.select("doc_id", "text", F.col("_values").alias("values"), F.col("_pseudonyms").alias("pseudonyms"))


@query("op7_passage_chaining")
def op7_passage_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir), rest=True)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_harmonic_packing")
def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)


_LANGS = {lang: words.split() for lang, words in quality.COMMON_WORDS.items()}
_LISTS = " ".join(f"WHEN '{lang}' THEN {words!r}" for lang, words in _LANGS.items())
_DEFAULT = repr(_LANGS[quality.DEFAULT_LANG])
_CLASSES = {"upper": r"\p{Lu}+", "digit": r"[0-9]+", "punctuation": r"[.,;:!?''\"()\-]+", "symbol": r"[#*$%&|<>]+"}


def _quality_sql() -> str:
    rests, hist = [], []
    for i, pattern in enumerate(_CLASSES.values()):
        rests.append(f"c{i + 1} AS (SELECT *, regexp_replace(r{i}, '{pattern}', '', 'g') AS r{i + 1} FROM c{i})")
        hist.append(f"length(r{i}) - length(r{i + 1})")
    n = len(_CLASSES)
    return f"""
WITH c0 AS (
  SELECT doc_id, CASE WHEN lang IN {tuple(_LANGS)} THEN lang ELSE '' END AS ref, string_split(coalesce(text, ''), chr(10)) AS lines,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         regexp_replace(coalesce(text, ''), '[a-zß-öø-ÿ\\x20\\x09-\\x0D]+', '', 'g') AS r0 FROM documents
), {', '.join(rests)},
f AS MATERIALIZED (
  SELECT doc_id, ref, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {hist[3]} AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
         [length(array_to_string(ws, '')) - length(r0), {', '.join(hist)}, length(r{n})] AS char_hist,
         list_transform(CASE ref {_LISTS} ELSE {_DEFAULT} END, lambda w: len(list_filter(ws, lambda x: x = w))) AS hits FROM c{n}
), g AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM (
    SELECT doc_id, pos, array_to_string(ws[pos:pos + 4], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS pos FROM f WHERE len(ws) >= 5))
), r AS (
  SELECT doc_id, sum(least(5, coalesce(pos - before, 5))) AS n_repeat_words FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM g WHERE n > 1) GROUP BY 1
), h AS (
  SELECT doc_id, ref, 'char' AS kind, unnest(range(1, len(char_hist) + 1)) AS pos, unnest(char_hist) AS v FROM f
  UNION ALL SELECT doc_id, ref, 'word', unnest(range(1, len(hits) + 2)), unnest(list_append(hits, n_words - list_sum(hits))) FROM f
), sums AS (
  SELECT ref, kind, pos, sum(v) AS v FROM h WHERE ref <> '' GROUP BY ALL
  UNION ALL SELECT '', kind, pos, sum(v) FROM h WHERE kind = 'char' OR ref IN ('', '{quality.DEFAULT_LANG}') GROUP BY ALL
), p AS (
  SELECT h.doc_id, h.kind, CASE WHEN sum(h.v) OVER d > 0 THEN h.v / sum(h.v) OVER d ELSE 0 END AS x, CASE WHEN sum(s.v) OVER d > 0 THEN s.v / sum(s.v) OVER d ELSE 0 END AS y
  FROM h JOIN sums s USING (ref, kind, pos) WINDOW d AS (PARTITION BY h.doc_id, h.kind)
), j AS (
  SELECT doc_id, kind, round(sqrt(greatest(0, sum(CASE WHEN x > 0 THEN 0.5 * x * log2(x / ((x + y) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN 0.5 * y * log2(y / ((x + y) / 2)) ELSE 0 END))), 9) AS dist FROM p GROUP BY ALL
), t AS (
  SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, jc.dist AS char_distance, jw.dist AS word_distance
  FROM f LEFT JOIN r ON r.doc_id = f.doc_id JOIN j jc ON jc.doc_id = f.doc_id AND jc.kind = 'char' JOIN j jw ON jw.doc_id = f.doc_id AND jw.kind = 'word'
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ((word_chars >= {quality.MIN_CHARS} AND char_distance > {quality.MAX_CHAR_DISTANCE}) OR (n_words >= {quality.MIN_WORDS} AND word_distance > {quality.MAX_WORD_DISTANCE})) AS kept,
       char_distance, word_distance FROM b
"""


@query("op10_quality_divergence", _quality_sql())
def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


@query("op12_rans_token_ids")
def op12_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_scratch(spark, "token-store")
    rans.write_ids(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"))
    return rans.read_documents(spark, path)


PHRASES_SQL = r"""
WITH p AS (
  SELECT lang, unnest(string_split(text, chr(10))) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
      'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS text FROM documents)
), w AS (
  SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) ks(k))
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
parts AS MATERIALIZED (
  SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM parts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase, b.a, l, r, n.n, score
FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2 JOIN n ON n.lang = b.lang
WHERE o.a IS NULL OR 100 * o.a < 50 * b.a QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) <= 2000
"""


@query("op13_misra_gries_phrases", PHRASES_SQL)
def op13_misra_gries_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT DISTINCT c FROM t),
crc AS (
  SELECT c, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(0, 8)), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS r FROM ids
), k AS (SELECT c, c - c % 20 AS base, (4294967295 - r) % 4 AS h FROM crc),
own AS (
  SELECT k.c, t.i + 1000000000000 AS i, t.role, t.text FROM k JOIN t ON t.c = k.c WHERE t.i > k.h
  UNION ALL SELECT k.c, t.i, t.role, t.text FROM k JOIN t ON t.c = k.base WHERE t.i <= k.h
), r AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, role, text, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM own
), p AS MATERIALIZED (
  SELECT c, d, w, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (PARTITION BY c ORDER BY d)) AS p FROM r
  UNION ALL SELECT c, 0, 0, '' FROM ids
), m AS MATERIALIZED (
  SELECT p.*, lag(p) OVER q AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p WINDOW q AS (PARTITION BY c ORDER BY d)
), nodes AS MATERIALIZED (
  SELECT p, any_value(d) AS d, any_value(w) AS w, any_value(up) AS up, min(c) AS conv, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY p
), kids AS (SELECT up AS p, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
own_nodes AS MATERIALIZED (SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids USING (p)),
path AS (SELECT o.p, o.n, o.w, o.kids, m.p AS top FROM own_nodes o JOIN m ON m.c = o.conv AND m.d <= o.d),
sums AS (SELECT top AS p, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n - 1) * w)::BIGINT AS saved_tokens FROM path GROUP BY 1)
SELECT o.conv AS conv_id, o.d AS depth, u.conv AS parent_conv_id, o.n AS n_convs, o.kids AS n_children, n_leaves, saved_tokens, o.ends_sha256
FROM own_nodes o JOIN sums USING (p) LEFT JOIN nodes u ON u.p = o.up AND o.d > 0
"""


@query("op11_zfast_prefix_trie", TRIE_SQL)
def op11_zfast_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
