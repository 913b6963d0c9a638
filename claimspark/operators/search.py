"""BM25 retrieval over a knowledge base, and verdicts from its best hit."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.tokens import expand_synonyms, stem, stemmed_tokens
from claimspark.session import bounded, bounded_rows, checkpoint

MAX_BROADCAST_TERMS = 200_000
MAX_LISTED_TERMS = 5_000  # query terms that become a filter of the scan
MAX_DIRECT_HITS = 100_000_000


def indexed(docs: DataFrame, doc_id: str = "id", text: str = "claim", vocabulary: DataFrame | None = None) -> DataFrame:
    """``doc_id, dl, term, tf`` with one extra row per document whose term is null.

    Counted inside the row: equal terms are neighbours once the tokens are sorted, so a term's count
    is the distance between two starts. Nothing is shuffled, and all terms of a document stay in one
    partition, which lets later sums per document combine map-side. ``vocabulary(term)`` drops other
    terms right away; the extra rows still count every document and its length.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), F.sort_array(stemmed_tokens(F.coalesce(text, F.lit("")))).alias("_t"))
    n = F.size("_t")
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 1) | (F.get("_t", i - 1) != F.get("_t", i - 2)))
    t = t.withColumn("_s", starts)
    counted = F.transform("_s", lambda i, j: F.struct(
        F.get("_t", i - 1).alias("term"), (F.coalesce(F.get("_s", j + 1), n + 1) - i).cast("bigint").alias("tf")))
    mark = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf")))
    terms = t.select("doc_id", n.alias("dl"), F.explode(F.concat(mark, counted)).alias("c")).select("doc_id", "dl", "c.term", "c.tf")
    if vocabulary is None:
        return terms
    wanted = vocabulary.withColumn("_wanted", F.lit(True))
    return terms.join(wanted, "term", "left").filter(F.col("term").isNull() | F.col("_wanted")).select("doc_id", "dl", "term", "tf")


def postings(index: DataFrame) -> DataFrame:
    return index.filter(F.col("term").isNotNull())


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: number of documents and mean length in tokens."""
    return index.filter(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25_index(docs: DataFrame, doc_id: str = "id", text: str = "claim") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, term statistics (``term, df, idf``) and the one-row corpus statistics.

    The texts are tokenised once into a table in the shared checkpoint folder.
    """
    index = checkpoint(indexed(docs, doc_id, text), "index")
    stats = corpus_stats(index)
    return postings(index), term_stats(postings(index), stats.first()["n_docs"]), stats


def term_stats(posts: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf`` for a corpus of ``n_docs`` documents."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", _idf(n_docs))


def _idf(n_docs: int) -> Column:
    return F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text",
                groups=tuple(L.SYNONYM_GROUPS), stem_synonyms: bool = False) -> DataFrame:
    """Distinct stemmed query terms with their synonyms: ``query_id, term``."""
    terms = expand_synonyms(stemmed_tokens(F.coalesce(text, F.lit(""))), groups)
    if stem_synonyms:
        terms = F.array_distinct(F.transform(terms, lambda t: stem(t)))
    return queries.select(F.col(query_id).alias("query_id"), F.explode(terms).alias("term"))


class Index(NamedTuple):
    """A stored index that any number of searches share."""

    weights: DataFrame  # doc_id, term, w, sorted by term, so a search reads the row groups of its own terms
    terms: DataFrame  # term, df, most


def build_index(docs: DataFrame, doc_id: str = "id", text: str = "claim", k1: float = L.BM25_K1, b: float = L.BM25_B) -> Index:
    """Tokenise, weigh and store a corpus once; ``bm25_search(queries, index)`` reads it."""
    index = checkpoint(indexed(docs, doc_id, text), "index")
    stats = corpus_stats(index).first()  # one row by construction
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"] or 1.0))
    posts = postings(index).select("doc_id", "term", (F.col("tf") * (k1 + 1) / norm).alias("part"))
    terms = checkpoint(posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
                       .select("term", "df", _idf(stats["n_docs"]).alias("idf"), (_idf(stats["n_docs"]) * F.col("most")).alias("most")), "terms")
    weights = posts.join(terms, "term").select("doc_id", "term", (F.col("idf") * F.col("part")).alias("w"))
    return Index(checkpoint(weights.repartitionByRange("term").sortWithinPartitions("term"), "weights"), terms.select("term", "df", "most"))


def _prepare_stored(queries: DataFrame, index: Index, query_id: str = "query_id", query_text: str = "text", stem_synonyms: bool = False) -> _Scored:
    wanted = query_terms(queries, query_id, query_text, stem_synonyms=stem_synonyms)
    listed = bounded_rows(wanted.select("term").distinct(), MAX_LISTED_TERMS)
    few = listed is not None or bounded(wanted, MAX_BROADCAST_TERMS)
    small = F.broadcast if few else (lambda df: df)
    own = (lambda df: df.filter(F.col("term").isin([r["term"] for r in listed]))) if listed is not None else (lambda df: df)
    known = checkpoint(own(index.terms).join(small(wanted), "term").select("query_id", "term", "df", F.col("most").alias("top")), "query-terms")
    return _Scored(own(index.weights), known, small)


class _Scored(NamedTuple):
    """One retrieval run: weighted postings, query terms and the hint for small term tables."""

    weights: DataFrame  # doc_id, term, w
    wanted: DataFrame  # query_id, term, df, top (largest w of the term)
    small: Callable[[DataFrame], DataFrame]


def _prepare(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", query_text: str = "text", doc_id: str = "id",
             doc_text: str = "claim", k1: float = L.BM25_K1, b: float = L.BM25_B, stem_synonyms: bool = False) -> _Scored:
    wanted = query_terms(queries, query_id, query_text, stem_synonyms=stem_synonyms)
    few = bounded(wanted, MAX_BROADCAST_TERMS)
    small = F.broadcast if few else (lambda df: df)  # the vocabulary and its statistics are no larger than ``wanted``
    index = checkpoint(indexed(docs, doc_id, doc_text, small(wanted.select("term").distinct())), "index")
    stats = corpus_stats(index).first()  # one row by construction
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"] or 1.0))
    posts = postings(index).select("doc_id", "term", (F.col("tf") * (k1 + 1) / norm).alias("part"))
    frequency = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    terms = checkpoint(frequency.select("term", "df", _idf(stats["n_docs"]).alias("idf"), "most"), "terms")
    weights = posts.join(small(terms), "term").select("doc_id", "term", (F.col("idf") * F.col("part")).alias("w"))
    known = wanted.join(small(terms), "term").select("query_id", "term", "df", (F.col("idf") * F.col("most")).alias("top"))
    return _Scored(weights, known, small)


def _sums(run: _Scored, terms: DataFrame) -> DataFrame:
    """Summed weight of every query and document over some of the query's terms."""
    return run.weights.join(run.small(terms.select("query_id", "term")), "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("s"))


def bm25_scores(queries: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """Raw score of every query and document that share a term: ``query_id, doc_id, score``.

    A frequent term pairs its query with every document that has it; use ``bm25_search`` for the best k.
    """
    return _all_scores(_prepare(queries, docs, **options))


def _best_scores(run: _Scored, k: int) -> DataFrame:
    """A table of query, document and score that holds at least the k best of every query.

    The heavier half of a query's terms alone gives k documents and with them a bound the k-th best
    score cannot be below. Light terms whose largest weights together stay under the bound cannot
    carry a document into the best k, so their long posting lists are never joined: they are only
    looked up for documents that the other terms leave within reach of the bound.
    """
    margin = 1e-6
    by_weight = Window.partitionBy("query_id").orderBy(F.desc("top"), "term")  # one query's own terms
    ranked = run.wanted.withColumns({
        "pos": F.row_number().over(by_weight), "n": F.count(F.lit(1)).over(Window.partitionBy("query_id")),
        "rest": F.sum("top").over(by_weight.rowsBetween(0, Window.unboundedFollowing))})
    ranked = checkpoint(ranked, "query-terms")
    heavy = _sums(run, ranked.filter(F.col("pos") <= F.ceil(F.col("n") / 2)))
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "doc_id")
    first_k = heavy.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    bound = checkpoint(first_k.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(0.0).alias("bound")), "bounds")

    light = (F.col("rest") < F.col("bound") - margin)
    split = ranked.join(run.small(bound), "query_id").withColumn("light", light)
    reach = split.groupBy("query_id").agg(F.first("bound").alias("bound"), F.coalesce(F.sum(F.when(F.col("light"), F.col("top"))), F.lit(0.0)).alias("reach"))
    partial = _sums(run, split.filter(~F.col("light")))
    kept = checkpoint(partial.join(run.small(reach), "query_id").filter(F.col("s") + F.col("reach") >= F.col("bound") - margin).select(
        "query_id", "doc_id", "s"), "candidates")
    lookups = kept.join(run.small(split.filter("light").select("query_id", "term")), "query_id").select("query_id", "doc_id", "term")
    more = lookups.join(run.weights, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("w").alias("m"))
    return kept.join(more, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.round(F.col("s") + F.coalesce("m", F.lit(0.0)), 9).alias("score")).filter(F.col("score") > 0)


def _all_scores(run: _Scored) -> DataFrame:
    # Rounded, so that copies of a document tie exactly whatever order their terms were summed in.
    return _sums(run, run.wanted).select("query_id", "doc_id", F.round("s", 9).alias("score")).filter(F.col("score") > 0)


def bm25_search(queries: DataFrame, docs: DataFrame | Index, k: int = 5, min_score: float = 0.3, min_raw: float = 0.0,
                direct_hits: int = MAX_DIRECT_HITS, **options) -> DataFrame:
    """Top-k documents per query by score relative to the query's best: ``query_id, doc_id, raw_score, score, rank``.

    The best hit always scores 1.0; ``min_raw`` filters on the raw score instead. Column options:
    ``query_id, query_text, doc_id, doc_text``; scoring options: ``k1, b, stem_synonyms``. Searches
    that would join more than ``direct_hits`` postings leave out those that cannot matter. In place of documents a
    stored index of ``build_index`` serves, which fixes ``k1``, ``b`` and the columns of the documents.
    """
    run = _prepare_stored(queries, docs, **options) if isinstance(docs, Index) else _prepare(queries, docs, **options)
    hits = run.wanted.agg(F.sum("df").alias("n")).first()["n"] or 0
    scores = _all_scores(run) if hits <= direct_hits else _best_scores(run, k)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    # Cut to k before normalising: the maximum is the first of the k, so no full-size window is needed.
    top = scores.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top.select("query_id", "doc_id", F.col("score").alias("raw_score"), (F.col("score") / best).alias("score"),
                      "rank").filter((F.col("score") >= min_score) & (F.col("raw_score") >= min_raw))


def kb_verdicts(claims: DataFrame, kb: DataFrame, threshold: float = 0.85, min_raw: float = 0.0, index: Index | None = None) -> DataFrame:
    """Verdict of each claim's best knowledge-base hit; claims without one stay with nulls.

    ``claims``: ``claim_id, text``; ``kb``: ``id, claim, is_true, explanation, claim_type``. The best hit always has the
    relative score 1.0, so only ``min_raw`` rejects weak ones. ``index`` is a stored index of ``kb``.
    """
    hits = bm25_search(claims, index or kb, k=1, min_score=0.5, min_raw=min_raw, query_id="claim_id", query_text="text").filter(
        F.col("score") > threshold)
    facts = kb.select(F.col("id").alias("doc_id"), "is_true", "explanation", "claim_type", F.col("claim").alias("matched_claim"))
    found = hits.join(facts, "doc_id").select(
        F.col("query_id").alias("claim_id"), F.col("doc_id").alias("fact_id"), "matched_claim",
        F.when(F.col("is_true"), "true").otherwise("false").alias("verdict"),
        (F.col("score") * 0.9).alias("confidence"), "explanation",
        F.when(~F.col("is_true"), F.col("explanation")).alias("correction"), "claim_type")
    return claims.select("claim_id").join(found, "claim_id", "left")
