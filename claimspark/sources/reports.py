"""Analysis reports as text lines (Markdown, HTML or plain text).

A report is a set of ``analysis_id, section, pos, sub, line`` rows; ordering by those columns gives
the text. Reports are never gathered into one value, so an analysis with very many claims is only
many lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import percent, preview

# Icon and colour of each claim status, icon, colour and label of each verdict.
STATUS_ICONS = {
    "confirmed": ("✓", "green"), "likely": ("○", "green"), "disputed": ("◐", "yellow"), "unverified": ("?", "gray"),
    "false": ("✗", "red"), "myth": ("⚠", "orange"),
}
VERDICT_ICONS = {
    "historically_accurate": ("✓", "green", "Historisch korrekt"), "simplified": ("○", "yellow", "Vereinfacht"),
    "selective": ("◐", "orange", "Selektiv"), "decontextualized": ("!", "orange", "Dekontextualisiert"),
    "reinterpreted": ("~", "orange", "Umgedeutet"), "propaganda": ("⚠", "red", "Propaganda"),
    "false": ("✗", "red", "Falsch"), "unverifiable": ("?", "gray", "Nicht verifizierbar"),
}
COLORS = {"green": "#22c55e", "yellow": "#eab308", "orange": "#f97316", "red": "#ef4444", "gray": "#6b7280"}
WIDTH = 70


def _pick(table: dict, i: int, key: Column, default: str) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[i]))])
    return F.coalesce(m[key], F.lit(default))


def _color(table: dict, key: Column) -> Column:
    hexes = F.create_map(*[x for k, v in COLORS.items() for x in (F.lit(k), F.lit(v))])
    return hexes[_pick(table, 1, key, "gray")]


def wrap(text: Column, width: int = WIDTH, prefix: str = "") -> Column:
    """Greedy word wrap; an over-long word keeps a line of its own."""
    room = width - len(prefix)
    lines = F.regexp_extract_all(F.concat(text, F.lit(" ")), F.lit(rf"(?U)(\S{{{room},}}|\S.{{0,{room - 1}}})(?=\s)"), F.lit(1))
    return F.transform(lines, lambda x: F.concat(F.lit(prefix), F.rtrim(x)))


def _lines(df: DataFrame, section: int, pos, lines: list) -> DataFrame:
    """Explode literal strings, string columns and string arrays into report lines; null ones vanish.

    They vanish after the explode: a filter of the array would run the whole line-up without generated code.
    """
    arrays = [F.array(F.lit(x)) if isinstance(x, str) else x for x in lines]
    return df.select("analysis_id", F.lit(section).alias("section"), F.lit(pos).cast("bigint").alias("pos") if isinstance(pos, int) else pos.cast("bigint").alias("pos"),
                     F.posexplode(F.concat(*arrays)).alias("sub", "line")).filter(F.col("line").isNotNull())


def _one(c: Column) -> Column:
    return F.array(c)


def _given(c: str, *lines: Column) -> Column:
    """Lines shown only when the column has text."""
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(*lines)).otherwise(F.array().cast("array<string>"))


def _listed(items: str, heading: str, bullet: str, limit: int | None = None) -> Column:
    shown = F.slice(items, 1, limit) if limit else F.col(items)
    rows = F.transform(shown, lambda x: F.concat(F.lit(bullet), x))
    return F.when(F.size(items) > 0, F.concat(F.array(F.lit(heading)), rows)).otherwise(F.array().cast("array<string>"))


def render_reports(analyses: DataFrame, claims: DataFrame, sources: DataFrame, fmt: str = "markdown") -> DataFrame:
    """Report lines.

    ``analyses``: ``analysis_id, input_text, overall_verdict, verdict_explanation, summary_for_users,
    recommendation``; ``claims``: ``analysis_id, ordinal, original_claim, fact_status,
    confidence_score, what_is_true, what_is_false``; ``sources``: ``analysis_id, ordinal, author,
    title, year, url``.
    """
    c = F.col
    v_icon = _pick(VERDICT_ICONS, 0, c("overall_verdict"), "?")
    v_label = F.upper(_pick(VERDICT_ICONS, 2, c("overall_verdict"), "Unbekannt"))
    icon = _pick(STATUS_ICONS, 0, c("fact_status"), "?")
    author, year = F.coalesce("author", F.lit("")), c("year").cast("string")
    if fmt == "markdown":
        head = [["# Analyse", ""], [F.concat(F.lit("**Bewertung:** "), v_icon, F.lit(" **"), v_label, F.lit("**")), F.lit("")],
                ["## Eingabe"], [F.concat(F.lit("> "), c("input_text")), F.lit("")]]
        top = [F.array(*[F.lit(x) if isinstance(x, str) else x for x in part]) for part in head]
        parts = [
            _lines(analyses, 0, 0, top + [_given("verdict_explanation", F.lit("## Erklaerung"), c("verdict_explanation"), F.lit(""))]),
            _lines(claims.select("analysis_id").distinct(), 1, -1, ["## Analysierte Behauptungen", ""]),
            _lines(claims, 1, c("ordinal"), [
                F.array(F.concat(F.lit("### "), (c("ordinal") + 1).cast("string"), F.lit(". "), F.left("original_claim", F.lit(80))), F.lit(""),
                        F.concat(F.lit("- **Status:** "), icon, F.lit(" "), c("fact_status")),
                        F.concat(F.lit("- **Konfidenz:** "), percent(c("confidence_score")))),
                _listed("what_is_true", "**Was stimmt:**", "- ✓ "), _listed("what_is_false", "**Was nicht stimmt:**", "- ✗ "), ""]),
            _lines(analyses, 2, 0, ["## Zusammenfassung", _one(c("summary_for_users")), "",
                                    _given("recommendation", F.concat(F.lit("> 💡 **Empfehlung:** "), c("recommendation")), F.lit(""))]),
            _lines(sources.select("analysis_id").distinct(), 3, -1, ["## Quellen", ""]),
            _lines(sources, 3, c("ordinal"), [_one(F.concat(
                F.lit("- "), F.when(author != "", F.concat(author, F.lit(". "))).otherwise(""), F.lit("*"), c("title"), F.lit("*"),
                F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit("")),
                F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit(" [Link]("), c("url"), F.lit(")"))).otherwise("")))]),
        ]
    elif fmt == "text":
        double, thin = "═" * WIDTH, "─" * WIDTH
        parts = [
            _lines(analyses, 0, 0, [double, " " * ((WIDTH - 7) // 2) + "ANALYSE", double, "", "EINGABE:",
                                    wrap(c("input_text"), WIDTH - 2, "  "), "", thin,
                                    _one(F.concat(F.lit("BEWERTUNG: "), v_icon, F.lit(" "), v_label)), thin, "",
                                    F.when(F.coalesce("verdict_explanation", F.lit("")) != "", F.concat(
                                        wrap(c("verdict_explanation")), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))]),
            _lines(claims.select("analysis_id").distinct(), 1, -1, [thin, "ANALYSE DER BEHAUPTUNGEN:", thin]),
            _lines(claims, 1, c("ordinal"), [
                F.array(F.lit(""), F.concat((c("ordinal") + 1).cast("string"), F.lit(". "), preview(c("original_claim"), 60)),
                        F.concat(F.lit("   Status: "), icon, F.lit(" "), c("fact_status")),
                        F.concat(F.lit("   Konfidenz: "), percent(c("confidence_score")))),
                _listed("what_is_true", "   ✓ Was stimmt:", "     - ", 3), _listed("what_is_false", "   ✗ Was nicht stimmt:", "     - ", 3)]),
            _lines(analyses, 2, 0, ["", thin, "ZUSAMMENFASSUNG:", thin, wrap(c("summary_for_users")),
                                    _given("recommendation", F.lit(""), F.concat(F.lit("💡 "), c("recommendation")))]),
            _lines(sources.select("analysis_id").distinct(), 3, -1, ["", thin, "QUELLEN:", thin]),
            _lines(sources.filter(c("ordinal") < 5), 3, c("ordinal"), [_one(F.rtrim(F.concat(
                F.lit("  - "), F.when(author != "", F.concat(author, F.lit(", "))).otherwise(""), c("title"), F.lit(" "),
                F.coalesce(F.concat(F.lit("("), year, F.lit(")")), F.lit("")))))]),
            _lines(analyses, 4, 0, ["", double]),
        ]
    elif fmt == "html":
        tone, c_tone = _color(VERDICT_ICONS, c("overall_verdict")), _color(STATUS_ICONS, c("fact_status"))
        div = lambda cls, title, body: _one(F.concat(
            F.lit(f'<div class="{cls}"><h4>{title}</h4>'), body, F.lit("</div>")))
        parts = [
            _lines(analyses, 0, 0, ['<div class="analysis">', _one(F.concat(
                F.lit('<div class="verdict-badge" style="border-left: 4px solid '), tone, F.lit('">'), v_icon, F.lit(" <strong>"), v_label, F.lit("</strong></div>"))),
                div("input-section", "Eingabe", F.concat(F.lit("<blockquote>"), c("input_text"), F.lit("</blockquote>"))),
                div("explanation-section", "Erklaerung", F.concat(F.lit("<p>"), F.coalesce("verdict_explanation", F.lit("")), F.lit("</p>")))]),
            _lines(claims.select("analysis_id").distinct(), 1, -1, ['<div class="claims-section"><h4>Analysierte Behauptungen</h4>']),
            _lines(claims, 1, c("ordinal"), [_one(F.concat(
                F.lit('<div class="claim-card" style="border-left: 3px solid '), c_tone, F.lit('"><p><strong>'), icon, F.lit(" "), c("original_claim"),
                F.lit("</strong></p><p>Status: "), c("fact_status"), F.lit(" | Konfidenz: "), percent(c("confidence_score")), F.lit("</p></div>")))]),
            _lines(claims.select("analysis_id").distinct(), 2, -1, ["</div>"]),
            _lines(analyses, 2, 0, [div("summary-section", "Zusammenfassung", F.concat(
                F.lit("<p>"), c("summary_for_users"), F.lit("</p>"), F.coalesce(F.concat(
                    F.lit("<p><em>💡 "), F.nullif(c("recommendation"), F.lit("")), F.lit("</em></p>")), F.lit("")))), "</div>"]),
        ]
    else:
        raise ValueError("fmt must be markdown, text or html")
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def render_myth_cards(myths: DataFrame) -> DataFrame:
    """Plain-text card per myth, as report lines keyed by the myth id."""
    c = F.col
    double, thin = "═" * WIDTH, "─" * WIDTH
    df = myths.withColumn("analysis_id", c("id"))
    title = F.concat(F.lit("MYTHOS: "), c("id"))
    return _lines(df, 0, 0, [
        double, _one(F.concat(F.expr(f"repeat(' ', greatest(0, cast(floor(({WIDTH} - length(concat('MYTHOS: ', id))) / 2) as int)))"), title)),
        double, "", _one(F.concat(F.lit("BEHAUPTUNG: "), _pick(STATUS_ICONS, 0, c("status"), "?"))), wrap(c("claim")), "",
        thin, "WAHRHEIT:", thin, wrap(c("truth")), "", thin, "URSPRUNG:", thin,
        _one(F.concat(F.lit("  Quelle: "), c("origin.source"))), _one(F.concat(F.lit("  Zeit: "), c("origin.date"))),
        _one(F.concat(F.lit("  Grund: "), c("origin.reason"))),
        F.when(F.size("sources") > 0, F.concat(F.array(F.lit(""), F.lit(thin), F.lit("QUELLEN:"), F.lit(thin)), F.transform(
            F.slice("sources", 1, 3), lambda s: F.concat(F.lit("  - "), s["title"])))).otherwise(F.array().cast("array<string>")),
        "", double])


def write_reports(lines: DataFrame, path: str, buckets: int = 200) -> None:
    """Write reports as text into ``buckets`` folders; a report's lines stay together and in order."""
    bucketed = lines.withColumn("bucket", F.pmod(F.xxhash64("analysis_id"), F.lit(buckets)))
    bucketed.repartitionByRange("bucket", "analysis_id").sortWithinPartitions("bucket", "analysis_id", "section", "pos", "sub").select(
        "bucket", F.col("line").alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)
