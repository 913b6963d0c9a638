"""Queries over whole texts: column functions, wording scores, retrieval, myths."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from claimspark import lexicons as L
from claimspark.functions import names as N
from claimspark.functions import text as X
from claimspark.functions import tokens as T
from claimspark.operators import features as feat
from claimspark.operators import kb as K
from claimspark.operators import myths as M
from claimspark.operators import propaganda as P
from claimspark.operators import search as R
from claimspark.plans import analyze as A
from claimspark.plans import factcheck as C
from claimspark.session import bounded_broadcast
from claimspark.sources import seeds


def r6(c, name):
    return F.round(F.round(c, 9), 6).alias(name)


def any_of(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {I.quoted(t)})" for t in terms) + ")"


def count_of(text: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {I.quoted(t)}) AS INTEGER)" for t in terms) + ")"


# ---- names -------------------------------------------------------------------------------------
@query("f1_normalize_name", r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower('  ' || p_name || '!  [' || p_brand || ']  '), '^\s+|\s+$', '', 'g'),
    '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g') AS normalized FROM part""")
def f1(spark, d):
    raw = I.sf("  ", F.col("p_name"), "!  [", F.col("p_brand"), "]  ")
    return I.table(spark, d, "part").select("p_partkey", N.normalize_name(raw).alias("normalized"))


@query("f2_levenshtein_ratio", """SELECT p_partkey, round(CASE WHEN p_brand = '' OR p_name = '' THEN 0 ELSE
    1 - levenshtein(p_name, lower(p_type) || ' ' || p_brand) / greatest(length(p_name), length(lower(p_type) || ' ' || p_brand))::DOUBLE END, 6) AS ratio FROM part""")
def f2(spark, d):
    other = I.sf(F.lower("p_type"), " ", F.col("p_brand"))
    return I.table(spark, d, "part").select("p_partkey", r6(N.levenshtein_ratio(F.col("p_name"), other), "ratio"))


def _soundex_sql(e: str) -> str:
    digits = f"translate(regexp_replace(upper({e}), '[^{N.SOUNDEX_LETTERS}]', '0', 'g'), '{N.SOUNDEX_LETTERS}', '{N.SOUNDEX_DIGITS}')"
    for k in "0123456":
        digits = f"regexp_replace({digits}, '{k}+', '{k}', 'g')"
    return f"rpad(left(upper({e}), 1) || left(replace(substring({digits}, 2), '0', ''), 3), 4, '0')"


@query("f3_soundex4", f"SELECT p_partkey, {_soundex_sql('p_name')} AS code, {_soundex_sql('reverse(p_name)')} AS code_reversed FROM part")
def f3(spark, d):
    return I.table(spark, d, "part").select("p_partkey", N.soundex4(F.col("p_name")).alias("code"), N.soundex4(F.reverse("p_name")).alias("code_reversed"))


_W = r"'[\p{L}\p{N}_]+'"
_JAC = """CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE
    / len(list_distinct(list_concat({a}, {b}))) END"""


@query("f4_jaccard_words", f"""SELECT doc_id, round({_JAC.format(a='a', b='b')}, 6) AS similarity FROM (
    SELECT doc_id, list_distinct(regexp_extract_all(lower(text), {_W})) AS a,
    list_distinct(regexp_extract_all(lower('the is of and on in that die der le la'), {_W})) AS b FROM documents)""")
def f4(spark, d):
    other = F.lit("the is of and on in that die der le la")
    return I.table(spark, d, "documents").select("doc_id", r6(T.jaccard_words(F.col("text"), other), "similarity"))


@query("f5_query_coverage", r"""SELECT doc_id, round(CASE WHEN text = '' THEN 0 ELSE len(list_intersect(q, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> ''))))::DOUBLE / len(q) END, 6) AS coverage
    FROM documents, (SELECT ['the', 'on', 'die', 'la', 'nothing'] AS q)""")
def f5(spark, d):
    return I.table(spark, d, "documents").select("doc_id", r6(T.query_coverage(F.lit("The on die la nothing"), F.col("text")), "coverage"))


_STEM = "regexp_replace({w}, '^(.{{3,}})(?:" + "|".join(L.STEM_SUFFIXES) + ")$', '\\1')"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


@query("f6_f7_stemmed_tokens", f"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_transform(t, lambda w: {_STEM.format(w='w')}), ' ')) AS stems
    FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)""")
def f6(spark, d):
    t = I.table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.transform("t", lambda w: T.stem(w)), " ")).alias("stems"))


_GROUPS = " UNION ALL ".join(f"SELECT {i} AS g, unnest({I.sql_list(g)}) AS word" for i, g in enumerate(L.SYNONYM_GROUPS))


@query("f8_expand_synonyms", f"""SELECT p_partkey, string_agg(term, ' ' ORDER BY term) AS terms FROM (
    SELECT p_partkey, term FROM (SELECT p_partkey, unnest(t) AS term FROM base)
    UNION SELECT b.p_partkey, y.word FROM (SELECT p_partkey, unnest(t) AS term FROM base) b JOIN syn x ON x.word = b.term JOIN syn y ON y.g = x.g) GROUP BY p_partkey
    """.replace("SELECT p_partkey, string_agg", f"""WITH syn AS ({_GROUPS}), base AS (SELECT p_partkey, list_transform(regexp_extract_all(lower(
    p_name || ' ' || (['hauptstadt','is','europa','born','asien','none here'])[p_partkey % 6 + 1]), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: {_STEM.format(w='w')}) AS t FROM part)
    SELECT p_partkey, string_agg"""))
def f8(spark, d):
    extra = F.element_at(F.array(*map(F.lit, ["hauptstadt", "is", "europa", "born", "asien", "none here"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    terms = T.expand_synonyms(T.stemmed_tokens(I.sf(F.col("p_name"), " ", extra)))
    return I.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(terms), " ").alias("terms"))


@query("f9_text_hash", "SELECT doc_id, left(sha256(text), 16) AS text_hash FROM documents")
def f9(spark, d):
    return I.table(spark, d, "documents").select("doc_id", N.text_hash(F.col("text")).alias("text_hash"))


@query("f10_stable_ids", "SELECT c_custkey, 'geo_' || left(md5(c_name || '_' || c_mktsegment), 8) AS id FROM customer")
def f10(spark, d):
    return I.table(spark, d, "customer").select("c_custkey", N.stable_id("geo_", F.col("c_name"), F.col("c_mktsegment")).alias("id"))


# ---- dates and points --------------------------------------------------------------------------
@query("f11_partial_dates", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE ELSE date_trunc('year', o_orderdate)::DATE END AS partial,
    date_trunc('year', o_orderdate)::DATE AS year_only, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE ELSE date_trunc('month', o_orderdate)::DATE END AS statement,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS iso, o_orderdate::DATE AS leading FROM orders""")
def f11(spark, d):
    from claimspark.functions import dates as D

    o = I.table(spark, d, "orders").withColumn("t", F.date_format("o_orderdate", "yyyy-MM-dd"))
    t, k = F.col("t"), F.col("o_orderkey")
    partial = F.when(k % 3 == 0, t).when(k % 3 == 1, F.left(t, F.lit(7))).otherwise(F.left(t, F.lit(4)))
    stated = F.when(k % 2 == 0, I.sf("+", t, "T00:00:00Z")).otherwise(I.sf("+", F.left(t, F.lit(7)), "-00T00:00:00Z"))
    iso = F.when(k % 4 == 0, F.lit("not a date")).otherwise(I.sf(t, "T10:00:00Z"))
    return o.select("o_orderkey", D.partial_date(partial).alias("partial"), D.year_date(I.sf(" ", F.left(t, F.lit(4)))).alias("year_only"),
                    D.statement_date(stated).alias("statement"), D.iso_date(iso).alias("iso"), D.leading_date(I.sf(t, "x")).alias("leading"))


@query("f12_parse_point", """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey::DOUBLE END AS lat, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS lon FROM customer""")
def f12(spark, d):
    from claimspark.functions.dates import parse_point

    raw = F.when(F.col("c_custkey") % 5 == 0, F.lit("Point(here there)")).otherwise(
        I.sf("Point(", I.s("c_acctbal"), " ", I.s("c_nationkey"), ")"))
    p = I.table(spark, d, "customer").select("c_custkey", parse_point(raw).alias("p"))
    return p.select("c_custkey", "p.lat", "p.lon")


# ---- wording -----------------------------------------------------------------------------------
@query("f13_f33_language_and_type", f"""SELECT doc_id, CASE WHEN {count_of('lower(text)', L.GERMAN_INDICATORS)} >= 2 THEN 'de' ELSE 'en' END AS language,
    CASE WHEN length(text) < 500 THEN 'claim' ELSE 'article' END AS input_type FROM docs""", ("docs",))
def f13(spark, d):
    return I.docs(spark, d).select("doc_id", X.detect_language(F.col("text")).alias("language"), X.input_type(F.col("text")).alias("input_type"))


_DATE_SQL = I.quoted("(?i)" + "|".join(L.DATE_PATTERNS))
_FEATURES = f"""SELECT doc_id, length(text) AS text_length, len(regexp_extract_all(text, '\\S+')) AS word_count, len(regexp_extract_all(text, '[.!?]+')) + 1 AS sentence_count,
    regexp_matches(text, '[0-9]') AS has_numbers, regexp_matches(text, {_DATE_SQL}) AS has_dates, regexp_matches(text, {I.quoted(L.NAME_PATTERN)}) AS has_names,
    {any_of('low', L.VAGUE_TERMS_TEXT)} AS vague, {any_of('low', L.ABSOLUTE_TERMS)} AS absolute, regexp_matches(low, {I.quoted(L.CITATION_PATTERN)}) AS has_citations,
    length(text) - length(replace(text, '?', '')) AS question_marks, length(text) - length(replace(text, '!', '')) AS exclamation_marks,
    {any_of('low', L.TIME_INDICATORS)} AS time_period, {any_of('low', L.LOCATION_INDICATORS)} AS location, {any_of('low', L.EVENT_INDICATORS)} AS event
    FROM (SELECT doc_id, text, lower(text) AS low FROM docs)"""
_FLAG = "CASE WHEN {} THEN {} ELSE 0 END"
_SCORES = f"""SELECT *, least(1, greatest(0, 0.5::DOUBLE + {_FLAG.format('has_dates', '0.15')} + {_FLAG.format('has_names', '0.15')} + {_FLAG.format('has_numbers', '0.1')}
    + {_FLAG.format('location', '0.1')} - {_FLAG.format('vague', '0.2')} - {_FLAG.format('absolute', '0.1')})) AS specificity,
    0.3::DOUBLE + {_FLAG.format('has_citations', '0.1')} AS credibility,
    (has_names::INT + event::INT + time_period::INT + location::INT + has_dates::INT) / 5.0::DOUBLE AS completeness FROM ({_FEATURES})"""
_RULE = f"""least(1, greatest(0, 0.5::DOUBLE + {_FLAG.format('specificity > 0.7000001', '0.1')} - {_FLAG.format('vague', '0.1')} - {_FLAG.format('absolute', '0.05')} - 0.15))"""


@query("f14_text_features", f"SELECT * FROM ({_FEATURES})", ("docs",))
def f14(spark, d):
    f = X.with_text_features(I.docs(spark, d))
    return f.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("text_length", "word_count", "sentence_count")], "has_numbers", "has_dates", "has_names",
                    F.col("uses_vague_language").alias("vague"), F.col("uses_absolute_language").alias("absolute"), "has_citations",
                    F.col("question_marks").cast("bigint").alias("question_marks"), F.col("exclamation_marks").cast("bigint").alias("exclamation_marks"),
                    F.col("mentions_time_period").alias("time_period"), F.col("mentions_location").alias("location"), F.col("mentions_event").alias("event"))


@query("f15_f18_text_scores", f"""SELECT doc_id, round(specificity, 6) AS specificity, round(credibility, 6) AS credibility, round(completeness, 6) AS completeness,
    round({_RULE}, 6) AS rule_score FROM ({_SCORES})""", ("docs",))
def f15(spark, d):
    f = X.with_text_features(I.docs(spark, d)).withColumn("rule", X.rule_score_text())
    return f.select("doc_id", r6(F.col("specificity_score"), "specificity"), r6(F.col("credibility_score"), "credibility"),
                    r6(F.col("completeness_score"), "completeness"), r6(F.col("rule"), "rule_score"))


@query("f19_f20_levels_and_sentences", f"""SELECT doc_id, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' WHEN s >= 0.4 THEN 'low' ELSE 'unclear' END AS level,
    CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.6 THEN 'medium' WHEN s >= 0.3 THEN 'low' ELSE 'unclear' END AS claim_level,
    CASE WHEN s >= 0.8 THEN 'High confidence: This claim appears well-supported by historical evidence'
    WHEN s >= 0.6 THEN 'Moderate confidence: This claim has some supporting evidence but uncertainties remain'
    WHEN s >= 0.4 THEN 'Low confidence: This claim has significant uncertainties or contradictions'
    ELSE 'Very low confidence: This claim appears unsupported or contradicts known facts' END || CASE WHEN vague THEN ' (contains vague language)' ELSE '' END AS sentence
    FROM (SELECT *, round({_RULE}, 6) AS s FROM ({_SCORES}))""", ("docs",))
def f19(spark, d):
    f = X.with_text_features(I.docs(spark, d)).withColumn("s", F.round(X.rule_score_text(), 6))
    return f.select("doc_id", X.level_text(F.col("s")).alias("level"), X.level_claim(F.col("s")).alias("claim_level"), X.interpretation_text(F.col("s")).alias("sentence"))


@query("w11_m3_top_factors", f"""SELECT doc_id, array_to_string(list_concat(CASE WHEN specificity > 0.7000001 THEN ['high_specificity'] ELSE [] END, CASE WHEN vague THEN ['vague_language'] ELSE [] END), ',') AS factors,
    round({_RULE}, 6) AS confidence FROM ({_SCORES})""", ("docs",))
def w11(spark, d):
    f = A.score_texts(I.docs(spark, d))
    return f.select("doc_id", F.array_join(F.transform("top_factors", lambda t: t["factor"]), ",").alias("factors"), r6(F.col("confidence"), "confidence"))


@query("f23_wording_flags", f"""SELECT doc_id, {any_of('lower(text)', L.VAGUE_TERMS_GRAPH)} AS vague_graph, {any_of('lower(text)', L.VAGUE_TERMS_TEXT)} AS vague_text,
    {any_of('lower(text)', L.ABSOLUTE_TERMS)} AS absolute, regexp_matches(text, '[0-9]') AS digits FROM docs""", ("docs",))
def f23(spark, d):
    t = F.col("text")
    return I.docs(spark, d).select("doc_id", X.vague_language(t, tuple(L.VAGUE_TERMS_GRAPH)).alias("vague_graph"), X.vague_language(t).alias("vague_text"),
                                   X.absolute_language(t).alias("absolute"), X.has_digits(t).alias("digits"))


def _case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of('lower(text)', terms)} THEN '{name}'" for name, terms in rules) + f" ELSE '{default}' END"


_CATEGORY_SQL = (f"CASE WHEN {any_of('lower(text)', L.CATEGORY_PERSON)} THEN CASE WHEN {any_of('text', L.CATEGORY_QUOTE)} OR {any_of('lower(text)', L.CATEGORY_QUOTE_WORDS)} "
                 "THEN 'quote_myth' ELSE 'person_myth' END ELSE " + _case(L.CATEGORY_RULES, "person_myth") + " END")
_ERA_SQL = _case(L.ERA_RULES, "modern")


@query("f24_f25_category_and_era", f"SELECT doc_id, {_CATEGORY_SQL} AS category, {_ERA_SQL} AS era FROM docs", ("docs",))
def f24(spark, d):
    return I.docs(spark, d).select("doc_id", X.guess_category(F.col("text")).alias("category"), X.guess_era(F.col("text")).alias("era"))


@query("p16_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def p16(spark, d):
    return I.table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


# ---- rhetoric ----------------------------------------------------------------------------------
def _ascii(e: str) -> str:
    for a, b in (("ä", "_a_"), ("ö", "_o_"), ("ü", "_u_"), ("ß", "_s_")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_\\x00-\\x7F]', '#', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


def _hits_sql(regex: str) -> str:
    for a, b in (("ä", "_a_"), ("ö", "_o_"), ("ü", "_u_"), ("ß", "_s_")):
        regex = regex.replace(a, b)
    regex = regex.replace("\\'", "'")
    if "(?!" in regex:  # no lookahead there: count what follows the last "source" of each line
        head = regex[: regex.index("(?!")]
        return (f"list_sum(list_transform(string_split(t, chr(10)), lambda l: len(regexp_extract_all(regexp_replace(l, '^.*\\bsource\\b', ''), {I.quoted(head)}))))")
    return f"len(regexp_extract_all(t, {I.quoted(regex)}))"


_HITS = "SELECT doc_id, low, " + ", ".join(
    f"{_hits_sql(r)} AS {t}_{i}" for t, _, _, rs in L.TECHNIQUE_PATTERNS for i, r in enumerate(rs)) + f" FROM (SELECT doc_id, lower(text) AS low, {_ascii('lower(text)')} AS t FROM docs)"


def _conf_sql(n: str, w: float) -> str:
    return f"CASE WHEN {n} > 0 THEN least(1, round(least(1, 0.5 + 0.1 * {n}) * {w}, 2))::DOUBLE END"


_TECH_SQL = ", ".join(
    "greatest(" + ", ".join(_conf_sql(f"{t}_{i}", w) for i in range(len(rs))) + f") AS c_{t}" for t, w, _, rs in L.TECHNIQUE_PATTERNS)
_NARR_SQL = ", ".join(f"CASE WHEN {count_of('low', kws)} >= 2 THEN 1 ELSE 0 END AS n_{n}" for n, kws in L.NARRATIVE_KEYWORDS.items())
_TECH_NAMES = [t for t, *_ in L.TECHNIQUE_PATTERNS]
_NT = "(" + " + ".join(f"(c_{t} IS NOT NULL)::INT" for t in _TECH_NAMES) + ")"
_SUM = "(" + " + ".join(f"coalesce(c_{t}, 0)" for t in _TECH_NAMES) + ")"
_NN = "(" + " + ".join(f"n_{n}" for n in L.NARRATIVE_KEYWORDS) + ")"
_PROP_SQL = f"""SELECT doc_id, nt, nn, list_t, CASE WHEN nt > 0 THEN least(1, total / nt + least(0.3, 0.1 * nt) + least(0.2, 0.1 * nn)) ELSE 0 END AS raw FROM (
    SELECT doc_id, {_NT} AS nt, {_NN} AS nn, {_SUM} AS total, array_to_string(list_filter([{', '.join(f"CASE WHEN c_{t} IS NOT NULL THEN '{t}' END" for t in _TECH_NAMES)}], lambda x: x IS NOT NULL), ',') AS list_t
    FROM (SELECT doc_id, {_TECH_SQL}, {_NARR_SQL} FROM ({_HITS})))"""


@query("f21_pattern_hits", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS technique, {i} AS pattern_no, {t}_{i}::BIGINT AS n, {_conf_sql(f'{t}_{i}', w)} AS confidence FROM hits WHERE {t}_{i} > 0"
    for t, w, _, rs in L.TECHNIQUE_PATTERNS for i in range(len(rs))) + ")", ("docs",))
def f21(spark, d):
    h = I.docs(spark, d).select("doc_id", F.explode(P.pattern_hits(F.lower("text"))).alias("h"))
    return h.select("doc_id", "h.technique", "h.pattern_no", F.col("h.n").cast("bigint").alias("n"), "h.confidence")


@query("f22_narrative_hits", f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN n_{n} = 1 THEN {I.quoted(n)} END' for n in L.NARRATIVE_KEYWORDS)}], lambda x: x IS NOT NULL), ',') AS narratives "
       f"FROM (SELECT doc_id, {_NARR_SQL} FROM (SELECT doc_id, lower(text) AS low FROM docs))", ("docs",))
def f22(spark, d):
    return I.docs(spark, d).select("doc_id", F.array_join(P.narrative_hits(F.lower("text")), ",").alias("narratives"))


@query("a21_propaganda", f"""SELECT doc_id, list_t AS techniques, nn::BIGINT AS n_narratives, round(raw, 3)::DOUBLE AS propaganda_score, raw >= 0.5 AS is_propaganda,
    CASE WHEN raw >= 0.7999999 THEN 'critical' WHEN raw >= 0.5999999 THEN 'high' WHEN raw >= 0.3999999 THEN 'medium' ELSE 'low' END AS risk_level FROM ({_PROP_SQL})""", ("docs",))
def a21(spark, d):
    p = P.with_propaganda(I.docs(spark, d))
    return p.select("doc_id", F.array_join(F.transform("techniques", lambda t: t["technique"]), ",").alias("techniques"),
                    F.size("narratives").cast("bigint").alias("n_narratives"), "propaganda_score", "is_propaganda", "risk_level")


@query("w10_best_indicator", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS technique, c_{t} AS confidence FROM best WHERE c_{t} IS NOT NULL" for t in _TECH_NAMES) + ")", ("docs",))
def w10(spark, d):
    h = I.docs(spark, d).select("doc_id", F.explode(P.best_per_technique(F.lower("text"))).alias("h"))
    return h.select("doc_id", "h.technique", "h.confidence")


@query("f28_technique_titles", "SELECT technique, title, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS technique, '{' '.join(w.capitalize() for w in t.split('_'))}' AS title, count(c_{t}) AS n FROM best" for t in _TECH_NAMES) + ") GROUP BY ALL HAVING sum(n) > 0", ("docs",))
def f28(spark, d):
    h = I.docs(spark, d).select(F.explode(P.best_per_technique(F.lower("text"))).alias("h"))
    return h.groupBy(F.col("h.technique").alias("technique")).agg(F.count(F.lit(1)).alias("n")).withColumn("title", P.technique_title(F.col("technique")))


def _patch_ctes():
    """The two SQL texts above read intermediate tables; put them in front."""
    from checks.registry import ORACLE

    ORACLE["f21_pattern_hits"] = ORACLE["f21_pattern_hits"].replace("\nSELECT * FROM (", f",\nhits AS ({_HITS})\nSELECT * FROM (", 1)
    best = f",\nbest AS (SELECT doc_id, {_TECH_SQL} FROM ({_HITS}))\nSELECT "
    for name in ("w10_best_indicator", "f28_technique_titles"):
        ORACLE[name] = ORACLE[name].replace("\nSELECT ", best, 1)


_patch_ctes()


@query("p18_compact_results", f"""SELECT doc_id, raw >= 0.5 AS is_propaganda, round(raw, 3)::DOUBLE AS score, nt::BIGINT AS techniques_found FROM ({_PROP_SQL})""", ("docs",))
def p18(spark, d):
    p = P.with_propaganda(I.docs(spark, d))
    return p.select("doc_id", "is_propaganda", F.col("propaganda_score").alias("score"), F.size("techniques").cast("bigint").alias("techniques_found"))


# ---- keywords and candidates -------------------------------------------------------------------
_KW = f"""SELECT doc_id, keyword, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM (
    SELECT doc_id, keyword, count(*) AS n, min(pos) AS first_pos FROM (SELECT doc_id, unnest(w) AS keyword, generate_subscripts(w, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM docs))
    WHERE regexp_full_match(keyword, '[a-zäöüß]{{4,}}') AND keyword NOT IN ({', '.join(map(I.quoted, L.KEYWORD_STOPWORDS))}) GROUP BY 1, 2)) WHERE rank <= 10"""


@query("w8_top_keywords", _KW, ("docs",))
def w8(spark, d):
    return K.top_keywords(I.docs(spark, d), 10, "doc_id", "text").select(
        F.col("text_id").alias("doc_id"), "keyword", "n", F.col("rank").cast("bigint").alias("rank"))


@query("p12_learnable", """SELECT id, round(mean_confidence, 6) AS mean_confidence FROM analyses
    WHERE overall_verdict IN ('false', 'myth', 'propaganda') AND mean_confidence >= 0.6""", ("analyses",))
def p12(spark, d):
    return K.learnable(I.analyses(spark, d), 0.6).select("id", r6(F.col("mean_confidence"), "mean_confidence"))


@query("f32_build_candidates", f"""SELECT a.id, 'claim ' || (a.doc_id * 10) AS claim, 'summary ' || a.doc_id AS truth, a.category, a.era, a.status,
    round(a.mean_confidence, 6) AS confidence_score, k.keywords FROM (SELECT *, {_CATEGORY_SQL.replace('text', 'source_text')} AS category, {_ERA_SQL.replace('text', 'source_text')} AS era,
    CASE WHEN overall_verdict = 'myth' THEN 'myth' ELSE 'false' END AS status FROM analyses WHERE overall_verdict IN ('false', 'myth', 'propaganda') AND mean_confidence >= 0.6) a
    LEFT JOIN (SELECT doc_id, string_agg(keyword, ' ' ORDER BY rank) AS keywords FROM ({_KW}) GROUP BY 1) k ON k.doc_id = a.doc_id""", ("analyses",))
def f32(spark, d):
    c = K.build_candidates(I.analyses(spark, d), 0.6)
    words = F.array_join("keywords", " ")
    return c.select("id", "claim", "truth", "category", "era", "status", r6(F.col("confidence_score"), "confidence_score"),
                    F.when(words != "", words).alias("keywords"))


# ---- retrieval ---------------------------------------------------------------------------------
_BM25 = f"""toks AS (SELECT doc_id, list_transform({_TOKENS}, lambda w: {_STEM.format(w='w')}) AS t FROM documents),
    corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3),
    idf AS (SELECT term, count(*) AS df, ln(((SELECT n FROM corpus) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM tf GROUP BY 1),
    syn AS ({_GROUPS}), q0 AS (SELECT item_id, unnest(list_distinct(list_transform({_TOKENS}, lambda w: {_STEM.format(w='w')}))) AS term FROM benchmark),
    q AS (SELECT item_id, term FROM q0 UNION SELECT q0.item_id, y.word FROM q0 JOIN syn x ON x.word = q0.term JOIN syn y ON y.g = x.g),
    scores AS (SELECT q.item_id, tf.doc_id, round(sum(idf.idf * (tf.tf * 2.5::DOUBLE / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.dl / (SELECT avgdl FROM corpus))))), 9) AS score
      FROM q JOIN tf ON tf.term = q.term JOIN idf ON idf.term = q.term GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY item_id) AS best FROM scores)"""


@query("a20_bm25_index", f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def a20(spark, d):
    _, stats, _ = R.bm25_index(I.texts(spark, d), "doc_id", "text")
    return stats.select("term", "df", r6(F.col("idf"), "idf"))


@query("j13_bm25_search", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS raw_score, round(score / best, 6) AS score, rank FROM ranked WHERE rank <= 5 AND score / best >= 0.3")
def j13(spark, d):
    hits = R.bm25_search(I.table(spark, d, "benchmark"), I.texts(spark, d), k=5, min_score=0.3,
                         query_id="item_id", query_text="text", doc_id="doc_id", doc_text="text")
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", r6(F.col("raw_score"), "raw_score"), r6(F.col("score"), "score"),
                       F.col("rank").cast("bigint").alias("rank"))


@query("j13_stored_index", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS raw_score, rank FROM ranked WHERE rank <= 5")
def j13_stored(spark, d):
    index = R.build_index(I.texts(spark, d), "doc_id", "text")
    hits = R.bm25_search(I.table(spark, d, "benchmark"), index, k=5, min_score=0.0, query_id="item_id", query_text="text")
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", r6(F.col("raw_score"), "raw_score"), F.col("rank").cast("bigint").alias("rank"))


@query("j13_bm25_search_pruned", f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS raw_score, rank FROM ranked WHERE rank <= 5")
def j13_pruned(spark, d):
    hits = R.bm25_search(I.table(spark, d, "benchmark"), I.texts(spark, d), k=5, min_score=0.0, direct_hits=0,
                         query_id="item_id", query_text="text", doc_id="doc_id", doc_text="text")
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", r6(F.col("raw_score"), "raw_score"), F.col("rank").cast("bigint").alias("rank"))


@query("w12_t4_normalised_hits", f"WITH {_BM25} SELECT item_id, count(*) AS n_hits, round(max(score / best), 6) AS top, round(avg(score / best), 6) AS mean_score FROM ranked WHERE score / best >= 0.5 AND rank <= 20 GROUP BY 1")
def w12(spark, d):
    hits = R.bm25_search(I.table(spark, d, "benchmark"), I.texts(spark, d), k=20, min_score=0.5,
                         query_id="item_id", query_text="text", doc_id="doc_id", doc_text="text")
    return hits.groupBy(F.col("query_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n_hits"), r6(F.max("score"), "top"), r6(F.avg("score"), "mean_score"))


def _doc_kb(spark, d):
    k = F.col("doc_id")
    return I.texts(spark, d).select(
        F.col("doc_id").alias("id"), F.col("text").alias("claim"), (k % 3 != 0).alias("is_true"), I.sf("doc ", I.s("doc_id")).alias("explanation"),
        F.when(k % 2 == 0, "historical").otherwise("other").alias("claim_type"))


@query("j16_kb_verdicts", f"""WITH {_BM25} SELECT b.item_id AS claim_id, r.doc_id AS fact_id, CASE WHEN r.doc_id IS NULL THEN NULL WHEN r.doc_id % 3 <> 0 THEN 'true' ELSE 'false' END AS verdict,
    CASE WHEN r.doc_id IS NOT NULL THEN 0.9::DOUBLE END AS confidence, CASE WHEN r.doc_id % 3 = 0 THEN 'doc ' || r.doc_id END AS correction
    FROM benchmark b LEFT JOIN ranked r ON r.item_id = b.item_id AND r.rank = 1""")
def j16(spark, d):
    claims = I.table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    return R.kb_verdicts(claims, _doc_kb(spark, d)).select("claim_id", "fact_id", "verdict", "confidence", "correction")


@query("factcheck_lifecycle", f"""WITH {_BM25} SELECT p_partkey AS claim_id, CASE WHEN r.doc_id IS NOT NULL THEN 'kb' ELSE 'votes' END AS decided_by,
    CASE WHEN r.doc_id IS NULL THEN CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'unverifiable' END WHEN r.doc_id % 3 <> 0 THEN 'true' ELSE 'false' END AS verdict FROM part
    LEFT JOIN ranked r ON r.item_id = p_partkey AND r.rank = 1""".replace("FROM benchmark)", "FROM (SELECT p_partkey AS item_id, p_name AS text FROM part))"))
def factcheck(spark, d):
    claims = I.table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_name").alias("text"))
    votes = I.table(spark, d, "part").filter(F.col("p_partkey") % 2 == 0).select(
        F.col("p_partkey").alias("claim_id"), F.lit(0).alias("ordinal"), F.lit("model").alias("kind"), F.lit(0.9).alias("raw_confidence"),
        F.lit("true").alias("verdict"), F.lit("said so").alias("explanation"), F.lit(None).cast("string").alias("correction"), F.lit("other").alias("claim_type"))
    return C.check_claims(claims, _doc_kb(spark, d), votes).select("claim_id", "decided_by", "verdict")


# ---- myths -------------------------------------------------------------------------------------
def _seed_values() -> str:
    rows = []
    for m in seeds._MYTHS:
        en = I.quoted(m[3]) if m[3] else "NULL"
        ten = I.quoted(m[8]) if m[8] else "NULL"
        date = I.quoted(m[9][1]) if m[9][1] else "NULL"
        rows.append(f"({I.quoted(m[0])}, {m[1]}, {I.quoted(m[2])}, {en}, {I.sql_list(m[10])}, {I.quoted(m[6])}, {I.quoted(m[7])}, {ten}, {I.quoted(m[9][0])}, {date}, {m[13] if m[13] is not None else 'NULL'})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(id, ordinal, claim, claim_en, keywords, status, truth, truth_en, origin_source, origin_date, popularity)"


def _match_sql(claims: str, myths: str, cid: str) -> str:
    j = lambda b: _JAC.format(a="cw", b=b)
    return f"""cl AS (SELECT {cid} AS claim_id, text, trim(lower(text)) AS c, list_distinct(regexp_extract_all(lower(text), {_W})) AS cw FROM {claims}),
    my AS (SELECT *, lower(claim) AS de, lower(coalesce(claim_en, '')) AS en, list_distinct(regexp_extract_all(lower(claim), {_W})) AS dw,
      list_distinct(regexp_extract_all(lower(coalesce(claim_en, '')), {_W})) AS ew FROM {myths}),
    scored AS (SELECT claim_id, id, ordinal, CASE WHEN contains(c, de) OR contains(de, c) THEN 10 ELSE 0 END + CASE WHEN en <> '' AND (contains(c, en) OR contains(en, c)) THEN 10 ELSE 0 END
      + 2 * len(list_filter(keywords, lambda k: contains(c, lower(k)))) + 5 * ({j('dw')}) + CASE WHEN en <> '' THEN 5 * ({j('ew')}) ELSE 0 END AS score FROM cl, my),
    best AS (SELECT claim_id, id AS myth_id, score AS myth_score FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, ordinal) AS rn FROM scored) WHERE rn = 1 AND score >= 2)"""


_SEED_MATCH = _match_sql("docs", f"({_seed_values()})", "doc_id")


def _chain(prefix: str, ctes: str, body: str) -> str:
    from checks.inputs import with_ctes

    return with_ctes((prefix,), "").rstrip() + ",\n" + ctes + "\n" + body


@query("j3_match_myths", _chain("docs", _SEED_MATCH, "SELECT c.claim_id AS doc_id, b.myth_id, round(b.myth_score, 6) AS myth_score FROM cl c LEFT JOIN best b ON b.claim_id = c.claim_id"))
def j3(spark, d):
    m = M.match_myths(I.docs(spark, d), seeds.myths(spark), claim_id="doc_id")
    return m.select("doc_id", "myth_id", r6(F.col("myth_score"), "myth_score"))


_PART_MATCH = _match_sql("phrase_claims", "myths", "claim_id")


@query("j3_match_large_base", _chain("myths", "phrase_claims AS (" + I.CTE["phrase_claims"][0] + "),\n" + _PART_MATCH,
                                     "SELECT c.claim_id, b.myth_id, round(b.myth_score, 6) AS myth_score FROM cl c LEFT JOIN best b ON b.claim_id = c.claim_id"))
def j3_large(spark, d):
    m = M.match_myths(I.phrase_claims(spark, d), I.myths(spark, d), inline_limit=0)
    return m.select("claim_id", "myth_id", r6(F.col("myth_score"), "myth_score"))


@query("j4_quick_check", _chain("docs", _SEED_MATCH, """SELECT c.claim_id AS doc_id, b.myth_id IS NOT NULL AS found, m.claim AS myth_claim, m.status, m.popularity, array_to_string(m.keywords[1:10], ',') AS keywords,
    m.origin_source AS origin FROM cl c LEFT JOIN best b ON b.claim_id = c.claim_id LEFT JOIN my m ON m.id = b.myth_id"""))
def j4(spark, d):
    q = M.quick_check(I.docs(spark, d), seeds.myths(spark), claim_id="doc_id")
    return q.select("doc_id", "found", "myth_claim", "status", "popularity", F.array_join("keywords", ",").alias("keywords"), "origin")


@query("a27_myth_analysis", _chain("docs", _SEED_MATCH, f"""SELECT doc_id, myth_id, overall_verdict, CASE WHEN untrue THEN truth_l ELSE truth END AS what_is_true, CASE WHEN untrue THEN claim_l END AS what_is_false, truth_l AS summary,
    'Ursprung: ' || origin_source || ' (' || coalesce(origin_date, 'unbekannt') || ')' AS recommendation FROM (
    SELECT c.claim_id AS doc_id, m.id AS myth_id, m.status IN ('false', 'myth') AS untrue, CASE WHEN m.status IN ('false', 'myth') THEN 'false' ELSE m.status END AS overall_verdict, m.truth, m.origin_source, m.origin_date,
    CASE WHEN {count_of('c.c', L.GERMAN_INDICATORS)} >= 2 THEN m.truth ELSE coalesce(nullif(m.truth_en, ''), m.truth) END AS truth_l,
    CASE WHEN {count_of('c.c', L.GERMAN_INDICATORS)} >= 2 THEN m.claim ELSE coalesce(nullif(m.claim_en, ''), m.claim) END AS claim_l
    FROM cl c JOIN best b ON b.claim_id = c.claim_id JOIN my m ON m.id = b.myth_id)"""))
def a27(spark, d):
    c = I.docs(spark, d).withColumn("language", X.detect_language(F.col("text")))
    m = M.myth_analysis(c, seeds.myths(spark), claim_id="doc_id")
    return m.select("doc_id", "myth_id", "overall_verdict", "what_is_true", "what_is_false", F.col("summary_for_users").alias("summary"), "recommendation")


@query("analysis_lifecycle", _chain("docs", _SEED_MATCH, """SELECT c.claim_id AS doc_id, b.myth_id IS NOT NULL AS known, CASE WHEN b.myth_id IS NOT NULL THEN CASE WHEN m.status IN ('false','myth') THEN 'false' ELSE m.status END
    WHEN c.claim_id % 3 = 0 THEN 'false' WHEN c.claim_id % 3 = 1 THEN 'historically_accurate' ELSE 'unverifiable' END AS overall_verdict
    FROM cl c LEFT JOIN best b ON b.claim_id = c.claim_id LEFT JOIN my m ON m.id = b.myth_id"""))
def analysis(spark, d):
    texts = I.docs(spark, d).withColumnRenamed("doc_id", "claim_id")
    k = F.col("doc_id")
    statuses = I.table(spark, d, "documents").select(k.alias("claim_id"), F.when(k % 3 == 0, "myth").when(k % 3 == 1, "confirmed").otherwise("disputed").alias("fact_status"))
    a = A.analyze_texts(texts, seeds.myths(spark), statuses)
    return a.select(F.col("claim_id").alias("doc_id"), F.col("myth_id").isNotNull().alias("known"), "overall_verdict")


@query("j18_myth_context", """SELECT claim_id, coalesce('RELEVANTE MYTHEN AUS DATENBANK:' || chr(10) || string_agg('- ' || claim || chr(10) || '  Status: ' || status || chr(10) || '  Wahrheit: ' || left(truth, 150) || '...', chr(10) ORDER BY rn), '') AS context
    FROM (SELECT c.claim_id, m.*, row_number() OVER (PARTITION BY c.claim_id ORDER BY m.ordinal) AS rn FROM phrase_claims c LEFT JOIN myths m
      ON contains(lower(m.claim), lower(c.text)) OR contains(lower(m.truth), lower(c.text)) OR len(list_filter(m.keywords, lambda k: contains(lower(k), lower(c.text)))) > 0) WHERE rn <= 3 GROUP BY claim_id""", ("phrase_claims", "myths"))
def j18(spark, d):
    return M.myth_context(I.phrase_claims(spark, d), I.myths(spark, d))


@query("j19_attach_narrative", """SELECT c_custkey, s_name AS narrative_name, c_mktsegment = 'MACHINERY' AS is_known_propaganda FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 150""")
def j19(spark, d):
    r = I.table(spark, d, "customer").select("c_custkey", I.sf("n", (F.col("c_custkey") % 150).cast("string")).alias("matched_narrative_id"),
                                             F.when(F.col("c_mktsegment") == "MACHINERY", "propaganda").otherwise("neutral").alias("narrative_status"))
    return M.attach_narrative(r, I.narratives(spark, d)).select("c_custkey", "narrative_name", "is_known_propaganda")


@query("p5_list_myths", "SELECT id, claim, popularity FROM myths WHERE category = 'PROMO' AND era = 'Brand#7' ORDER BY popularity DESC NULLS LAST, ordinal LIMIT 50", ("myths",))
def p5(spark, d):
    return M.list_myths(I.myths(spark, d), "PROMO", "Brand#7", 50).select("id", "claim", "popularity")


@query("p6_search_myths", "SELECT id, claim, status, truth, category FROM myths WHERE contains(lower(claim), 'red') OR contains(lower(truth), 'red') OR len(list_filter(keywords, lambda k: contains(lower(k), 'red'))) > 0", ("myths",))
def p6(spark, d):
    return M.search_myths(I.myths(spark, d), "RED").select("id", "claim", "status", "truth", "category")


@query("p7_search_graph", "SELECT id, claim, status, popularity FROM myths WHERE contains(lower(claim), 'gear') ORDER BY popularity DESC NULLS FIRST, ordinal LIMIT 10", ("myths",))
def p7(spark, d):
    return M.search_graph(I.myths(spark, d), "Gear")


@query("p19_lookup", "SELECT id, claim FROM myths WHERE id IN (SELECT 'm' || l_partkey FROM lineitem WHERE l_quantity >= 49)", ("myths",))
def p19(spark, d):
    ids = I.table(spark, d, "lineitem").filter(F.col("l_quantity") >= 49).select(I.sf("m", I.s("l_partkey")).alias("id"))
    return M.lookup(I.myths(spark, d), ids).select("id", "claim")


@query("p20_list_narratives", "SELECT 'n' || s_suppkey AS id, s_name AS name, lower(s_name) AS name_en, 'purpose ' || s_nationkey AS purpose FROM supplier")
def p20(spark, d):
    return M.list_narratives(I.narratives(spark, d)).select("id", "name", "name_en", "purpose")


@query("a11_myth_stats", """SELECT 'category' AS dimension, category AS value, count(*) AS n FROM myths GROUP BY 2 UNION ALL SELECT 'era', era, count(*) FROM myths GROUP BY 2
    UNION ALL SELECT 'status', status, count(*) FROM myths GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM myths""", ("myths",))
def a11(spark, d):
    return M.myth_stats(I.myths(spark, d))


@query("t3_top_myths", "SELECT id, claim, popularity FROM myths ORDER BY popularity DESC NULLS LAST, ordinal LIMIT 5", ("myths",))
def t3(spark, d):
    return M.top_myths(I.myths(spark, d), 5)


# ---- combined credibility and vectors ------------------------------------------------------------
@query("j22_f26_credibility", f"""SELECT p.doc_id, round(o, 3) AS overall_score, CASE WHEN o >= 0.6999999 THEN 'HIGH CREDIBILITY' WHEN o >= 0.4999999 THEN 'MODERATE CREDIBILITY' WHEN o >= 0.2999999 THEN 'LOW CREDIBILITY' ELSE 'VERY LOW CREDIBILITY' END AS assessment
    FROM (SELECT p.doc_id, r.rule * 0.3 + (1 - round(p.raw, 3)::DOUBLE) * 0.3 + coalesce(v.confidence, 0.5) * 0.4 AS o FROM ({_PROP_SQL}) p JOIN (SELECT doc_id, {_RULE} AS rule FROM ({_SCORES})) r ON r.doc_id = p.doc_id
    LEFT JOIN (SELECT claim_id, round(CASE WHEN sum(found::INT) > 0 THEN least(1, sum(CASE WHEN found THEN relevance * reliability END) / sum(CASE WHEN found THEN reliability END)
      + max(CASE WHEN found THEN (CASE tier WHEN 'tier_1_authority' THEN 0.15 WHEN 'tier_2_factcheck' THEN 0.10 WHEN 'tier_3_academic' THEN 0.05 ELSE 0 END) END)) ELSE 0 END, 3) AS confidence FROM results GROUP BY 1) v ON v.claim_id = CAST(p.doc_id AS VARCHAR)) p""", ("docs", "results"))
def j22(spark, d):
    c = A.credibility_report(I.doc_claims(spark, d), I.source_results(spark, d))
    return c.select(F.col("claim_id").cast("bigint").alias("doc_id"), "overall_score", "assessment")


@query("f27_text_vector", f"""SELECT doc_id, round(text_length / 1000::DOUBLE, 6) AS v0, round(word_count / 100::DOUBLE, 6) AS v1, round(sentence_count / 10::DOUBLE, 6) AS v2, round(question_marks / 5::DOUBLE, 6) AS v9,
    round(specificity, 6) AS v25, round(credibility, 6) AS v26, round(completeness, 6) AS v27, 28 AS size FROM ({_SCORES})""", ("docs",))
def f27(spark, d):
    from pyspark.ml.functions import vector_to_array

    v = feat.with_vector(X.with_text_features(I.docs(spark, d)), feat.TEXT_VECTOR).select("doc_id", vector_to_array("features").alias("v"))
    return v.select("doc_id", *[r6(F.col("v")[i], f"v{i}") for i in (0, 1, 2, 9, 25, 26, 27)], F.size("v").alias("size"))


# ---- replaced and seeded word lists ------------------------------------------------------------
_OWN_PATTERNS = (("hype", 0.9, "Strong words.", [r"\b(everything|never)\b", r"\b(king|nation)\b"]),
                 ("proof", 1.0, "Appeals to proof.", [r"\b(studies show|according to)\b"]))
_OWN_NARRATIVES = {"war": ["battle", "lost", "victims"], "sea": ["columbus", "earth", "round"]}
_OWN_SQL = ", ".join("greatest(NULL, " + ", ".join(_conf_sql(f"len(regexp_extract_all(low, {I.quoted(r)}))", w) for r in rs) + f") AS {t}" for t, w, _, rs in _OWN_PATTERNS)
_OWN_STORIES = ", ".join("CASE WHEN " + " + ".join(f"contains(low, {I.quoted(k)})::INT" for k in ks) + f" >= 2 THEN {I.quoted(n)} END" for n, ks in _OWN_NARRATIVES.items())


@query("e3_own_lexicons", f"""SELECT doc_id, hype, proof, array_to_string(stories, ',') AS narratives, round(CASE WHEN n > 0 THEN least(1, (coalesce(hype, 0) + coalesce(proof, 0)) / n + n * 0.1::DOUBLE + len(stories) * 0.1::DOUBLE) ELSE 0 END, 3)::DOUBLE AS propaganda_score
    FROM (SELECT *, (hype IS NOT NULL)::INT + (proof IS NOT NULL)::INT AS n FROM (SELECT doc_id, {_OWN_SQL}, list_filter([{_OWN_STORIES}], lambda x: x IS NOT NULL) AS stories FROM (SELECT doc_id, lower(text) AS low FROM docs)))""", ("docs",))
def e3(spark, d):
    p = P.with_propaganda(I.docs(spark, d), patterns=_OWN_PATTERNS, narratives=_OWN_NARRATIVES).withColumn("m", F.map_from_entries("techniques"))
    return p.select("doc_id", F.col("m")["hype"].alias("hype"), F.col("m")["proof"].alias("proof"), F.array_join("narratives", ",").alias("narratives"), "propaganda_score")


_FIRST = "regexp_extract(low, {}, 0)"


def _best_sql(technique: str, weight: float, regexes: list[str]) -> str:
    """The best pattern's words; of equals the first."""
    conf = [_conf_sql(f"len(regexp_extract_all(low, {I.quoted(r)}))", weight) for r in regexes]
    cases = " ".join(f"WHEN coalesce({c} >= greatest(NULL, {', '.join(conf)}), false) THEN {_FIRST.format(I.quoted(r))}" for c, r in zip(conf, regexes))
    return f"SELECT doc_id, '{technique}' AS technique, greatest(NULL, {', '.join(conf)}) AS confidence, 'Found pattern: ' || CASE {cases} END AS evidence FROM (SELECT doc_id, lower(text) AS low FROM docs)"


@query("f21_evidence", "SELECT e.*, explanation FROM ("
       + " UNION ALL ".join(_best_sql(t, w, rs) for t, w, _, rs in _OWN_PATTERNS) + ") e JOIN (VALUES " + ", ".join(f"({I.quoted(t)}, {I.quoted(x)})" for t, _, x, _ in _OWN_PATTERNS)
       + ") x(technique, explanation) USING (technique) WHERE confidence IS NOT NULL", ("docs",))
def f21_evidence(spark, d):
    """The words that each technique was found by."""
    found = I.docs(spark, d).select("doc_id", F.explode(P.evidence(F.lower("text"), _OWN_PATTERNS)).alias("e"))
    return found.select("doc_id", "e.technique", "e.confidence", "e.evidence", "e.explanation")


@query("a21_summaries", f"""SELECT doc_id, CASE WHEN raw >= 0.5 THEN 'This text shows signs of propaganda (' || CASE WHEN raw >= 0.8::DOUBLE THEN 'critical' WHEN raw >= 0.6::DOUBLE THEN 'high' ELSE 'medium' END || ' risk). Detected techniques: '
      || concat_ws(', ', CASE WHEN hype IS NOT NULL THEN 'hype' END, CASE WHEN proof IS NOT NULL THEN 'proof' END) || '.' || CASE WHEN len(stories) > 0 THEN ' Matches known narrative patterns: ' || stories[1] || '.' ELSE '' END
      ELSE 'No significant propaganda patterns detected.' END AS summary, CASE WHEN raw >= 0.5 THEN 'This content should be fact-checked against authoritative sources. Be cautious of emotional manipulation and verify all claims independently.'
      ELSE 'Standard fact-checking procedures apply.' END AS recommendation
    FROM (SELECT *, CASE WHEN n > 0 THEN least(1, (coalesce(hype, 0) + coalesce(proof, 0)) / n + n * 0.1::DOUBLE + len(stories) * 0.1::DOUBLE) ELSE 0 END AS raw
    FROM (SELECT *, (hype IS NOT NULL)::INT + (proof IS NOT NULL)::INT AS n FROM (SELECT doc_id, {_OWN_SQL}, list_filter([{_OWN_STORIES}], lambda x: x IS NOT NULL) AS stories FROM (SELECT doc_id, lower(text) AS low FROM docs))))""", ("docs",))
def a21_summaries(spark, d):
    p = P.with_propaganda(I.docs(spark, d), patterns=_OWN_PATTERNS, narratives=_OWN_NARRATIVES)
    return p.select("doc_id", P.propaganda_summary().alias("summary"), P.recommendation(F.col("is_propaganda")).alias("recommendation"))


_SEED_WORDS = ([("myth", m[0], w) for m in seeds._MYTHS for w in m[10]] + [("narrative", n[0], w) for n in seeds._NARRATIVES for w in n[5]]
               + [("technology", t, t.lower()) for t in L.TECHNOLOGY_DATES])


@query("s18_seed_mentions", f"""WITH seed(kind, id, word) AS (VALUES {', '.join(f"({I.quoted(a)}, {I.quoted(b)}, {I.quoted(c)})" for a, b, c in _SEED_WORDS)}),
    words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-zäöüß]+')) AS word FROM (SELECT doc_id, text || ' ' || ({I.sql_list(I.PHRASES)})[doc_id % {len(I.PHRASES)} + 1] AS text FROM documents))
    SELECT kind, id, count(DISTINCT doc_id) AS n_docs FROM seed LEFT JOIN words USING (word) GROUP BY 1, 2""")
def s18(spark, d):
    """How many texts name each seeded myth, narrative and technology by one of its words."""
    t = seeds.seed_tables(spark)
    word = lambda df, kind, ident, w: df.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), w.alias("word"))
    seeded = (word(t["myths"], "myth", "id", F.explode("keywords")).unionByName(word(t["narratives"], "narrative", "id", F.explode("keywords")))
              .unionByName(word(t["invention_dates"], "technology", "technology", F.lower("technology"))))
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüß]+"), F.lit(0)))
    hits = I.docs(spark, d).select("doc_id", F.explode(found).alias("word")).join(bounded_broadcast(seeded, 100_000), "word")
    n = hits.groupBy("kind", "id").agg(F.count_distinct("doc_id").alias("n_docs"))
    return seeded.select("kind", "id").distinct().join(n, ["kind", "id"], "left").select("kind", "id", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"))
