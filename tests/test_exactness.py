"""Distributed methods against brute force on small inputs, including hot keys."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimspark.functions.tokens import words
from claimspark.operators import batch as B
from claimspark.operators import evidence as E
from claimspark.operators import graph as G
from claimspark.operators import kb as K
from claimspark.operators import myths as M
from claimspark.operators import search as S
from claimspark.operators import textjoin as TJ
from claimspark.sources import seeds


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def random_words(seed, n, alphabet="abc", low=1, high=12):
    r = random.Random(seed)
    return sorted({"".join(r.choice(alphabet) for _ in range(r.randint(low, high))) for _ in range(n)})


@pytest.mark.parametrize("theta", [0.6, 0.7, 0.8, 0.9])
def test_edit_pairs_lose_nothing(spark, theta):
    a, b = random_words(1, 60, "ab") + ["aaaaaaaaaaaa", "abababababab"], random_words(2, 60, "ab") + ["aaaaaaaaaaa", "bababababab"]
    got = {(r["left_text"], r["right_text"]) for r in TJ.edit_pairs(
        spark.createDataFrame([(x,) for x in a], "text string"), spark.createDataFrame([(x,) for x in b], "text string"), theta).collect()}
    want = {(x, y) for x in a for y in b if 1 - distance(x, y) / max(len(x), len(y)) >= theta}
    assert got == want


def test_edit_pairs_reject_low_thresholds(spark):
    one = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(ValueError):
        TJ.edit_pairs(one, one, 0.5)


def test_containment_pairs_lose_nothing(spark):
    hay, needles = random_words(3, 80, "abc", 1, 15) + ["äöü straße", "x😀y"], random_words(4, 60, "abc", 1, 5) + ["ö", "straße", "😀", "zzz"]
    h = spark.createDataFrame(list(enumerate(hay)), "h long, t string")
    n = spark.createDataFrame(list(enumerate(needles)), "n long, s string")
    got = {(r["h"], r["n"]) for r in TJ.containment_pairs(h, n, "h", "t", "n", "s").collect()}
    assert got == {(i, j) for i, x in enumerate(hay) for j, y in enumerate(needles) if y in x}


def test_containment_respects_blocks(spark):
    h = spark.createDataFrame([("A", 1, "abcd"), ("B", 2, "abcd")], "k string, h long, t string")
    n = spark.createDataFrame([("A", 1, "bc")], "k string, n long, s string")
    assert [(r["h"], r["n"]) for r in TJ.containment_pairs(h, n, "h", "t", "n", "s", ["k"]).collect()] == [(1, 1)]


def test_joined_myth_match_equals_inline(spark):
    texts = ["Napoleon war klein", "vikings wore horned helmets they say", "flat earth", "klein", "newton apple apple", "wall moon", "mond", "xyz",
             "Im Mittelalter glaubte man an eine flache Erde", "an apple fell", "helmet", "columbus " * 30]
    claims = spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")
    myths = seeds.myths(spark)
    pick = lambda df: {r["claim_id"]: (r["myth_id"], r["myth_score"] and round(r["myth_score"], 9)) for r in df.collect()}
    inline = pick(M.match_myths(claims, myths))
    assert inline == pick(M.match_myths(claims, myths, inline_limit=0))
    assert inline[0][0] == "bonaparte_height" and inline[7] == (None, None)


def test_joined_myth_match_equals_inline_on_blanks(spark):
    schema = ("id string, ordinal int, claim string, claim_en string, category string, era string, status string, truth string, truth_en string, "
              "origin struct<source:string,date:string,reason:string>, sources array<struct<title:string>>, keywords array<string>, debunked_by array<string>, related_myths array<string>, popularity int")
    rest = ("c", "e", "myth", "t", None, None, [], [], [], 1)
    row = lambda i, de, en, kw: (f"m{i}", i, de, en, *rest[:6], rest[6], kw, [], [], 1)
    myths = spark.createDataFrame([row(0, "flat earth was taught", None, ["earth"]), row(1, "", "tall tale", ["moon"]), row(2, "moon of cheese", "", ["", "cheese"]),
                                   row(3, "", None, []), row(4, "moon of cheese", "cheese moon", ["cheese"])], schema)
    texts = ["", "  ", None, "moon", "earth", "cheese moon", "nothing in common", "tall tale of the moon of cheese", "flat earth was taught"]
    claims = spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")
    pick = lambda df: {r["claim_id"]: (r["myth_id"], r["myth_score"] and round(r["myth_score"], 9)) for r in df.collect()}
    for base in (myths, myths.filter("ordinal in (0, 4)")):
        assert pick(M.match_myths(claims, base)) == pick(M.match_myths(claims, base, inline_limit=0))


def brute_related(edges, pop, depth, k):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for v in near:
        seen, ring, dist = {v}, {v}, {}
        for d in range(1, depth + 1):
            ring = {w for u in ring for w in near[u]} - seen
            dist.update({w: d for w in ring})
            seen |= ring
        order = sorted(dist, key=lambda w: (pop.get(w) is not None, -(pop.get(w) or 0), w))
        out[v] = [(w, dist[w]) for w in order[:k]]
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_related_with_a_hub(spark, depth):
    r = random.Random(5)
    ids = [f"n{i:02d}" for i in range(40)]
    edges = [("n00", i) for i in ids[1:25]] + [(r.choice(ids), r.choice(ids)) for _ in range(30)]
    pop = {i: (None if r.random() < 0.2 else r.randint(0, 20)) for i in ids}
    e = spark.createDataFrame(edges, "src string, dst string")
    n = spark.createDataFrame(list(pop.items()), "id string, popularity int")
    got = {}
    for row in G.related(e, n, depth, 5).orderBy("id", "rank").collect():
        got.setdefault(row["id"], []).append((row["related_id"], row["min_distance"]))
    want = brute_related([(a, b) for a, b in edges if a != b], pop, depth, 5)
    assert got == {k: v for k, v in want.items() if v}


def brute_hits(times, ttl, inclusive):
    anchor, hits = None, []
    for t in times:
        hit = anchor is not None and (t - anchor <= ttl if inclusive else t - anchor < ttl)
        hits.append(hit)
        if not hit:
            anchor = t
    return hits


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_reuse_flags(spark, inclusive, hot_rows):
    r = random.Random(11)
    rows, want, rid = [], {}, 0
    for key, n in (("a", 60), ("b", 3), ("c", 25), ("d", 1)):
        times = sorted(r.choice([r.randint(0, 500), 100, 200]) for _ in range(n))
        for t, hit in zip(times, brute_hits(times, 50, inclusive)):
            rows.append((rid, f" {key.upper()} " if rid % 2 else key, t))
            want[rid] = hit
            rid += 1
    df = spark.createDataFrame(rows, "request_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["request_id"]: x["hit"] for x in B.reuse_flags(df, 50, inclusive=inclusive, hot_rows=hot_rows).collect()}
    assert got == want


def test_reuse_ttl_edges(spark):
    day = 86_400_000_000
    rows = [(0, "k", 0), (1, "k", day - 1), (2, "k", day), (3, "k", day + 5), (4, "k", 2 * day)]
    df = spark.createDataFrame(rows, "request_id long, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    assert [r["hit"] for r in B.reuse_flags(df).orderBy("request_id").collect()] == [False, True, False, True, False]
    assert [r["hit"] for r in B.reuse_flags(df, inclusive=True).orderBy("request_id").collect()] == [False, True, True, False, True]


def test_rolling_rate_across_buckets(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), r.randint(0, 1000)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["id"]: x["requests_in_window"] for x in B.rolling_rate(df, "k", seconds=60, limit=5, bucket_seconds=90).collect()}
    assert got == {i: sum(1 for _, k2, s2 in rows if k2 == k and s - 60 < s2 <= s) for i, k, s in rows}


def test_upserts_are_idempotent(spark):
    base = spark.createDataFrame([("Person", "Fact", "A", {"x": "1", "y": "1"})], "node_type string, source_label string, name string, properties map<string,string>")
    new = spark.createDataFrame([("Person", "Fact", "A", 0, {"x": "2"}), ("Person", "Fact", "A", 1, {"x": "3", "z": None}), ("Person", "Claim", "A", 2, None)],
                                "node_type string, source_label string, name string, ordinal int, properties map<string,string>")
    once = G.merge_nodes(base, new)
    show = lambda df: sorted((r["node_type"], r["source_label"], r["name"], tuple(sorted(r["properties"].items()))) for r in df.collect())
    assert show(once) == [("Person", "Claim", "A", ()), ("Person", "Fact", "A", (("x", "3"), ("y", "1")))]
    assert show(G.merge_nodes(once, new)) == show(once)


def test_closure_handles_cycles(spark):
    sub = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "child string, parent string")
    inst = spark.createDataFrame([("i", "c"), ("j", "z")], "instance string, class string")
    roots = spark.createDataFrame([("a",), ("y",)], "root string")
    assert {tuple(r) for r in G.instances_of(inst, sub, roots).collect()} == {("a", "i"), ("y", "j")}


def test_negatives_and_growth(spark):
    kb = spark.createDataFrame([("g1", "Peru liegt in Suedamerika", True, "", "wikidata", "geographic", ["Peru", "Suedamerika"], 1.0),
                                ("g2", "Die Hauptstadt von Peru ist Lima", True, "", "wikidata", "geographic", ["Peru", "Lima"], 1.0),
                                ("g3", "Kenia liegt in Afrika", True, "", "wikidata", "geographic", ["Kenia", "Afrika"], 1.0),
                                ("x", "Kenia liegt in Asien", False, "", "generated", "geographic", ["Kenia", "Asien"], 1.0)],
                               "id string, claim string, is_true boolean, explanation string, source string, claim_type string, entities array<string>, confidence double")
    assert {r["id"] for r in K.negative_seeds(kb).collect()} == {"g1", "g2"}
    neg = K.negatives(K.negative_seeds(kb)).collect()
    assert len(neg) == 1 and neg[0]["claim"].startswith("Peru liegt in ") and not neg[0]["is_true"] and "nicht in" in neg[0]["explanation"]
    fresh = K.grow_kb(kb, kb.limit(0), K.misconception_facts(seeds.misconceptions(spark)))
    stats = {r["kind"]: r["n"] for r in K.growth_stats(fresh).collect()}
    assert stats == {"misconceptions": 8, "adversarial": 1}
    again = K.grow_kb(kb.unionByName(fresh), kb.limit(0), K.misconception_facts(seeds.misconceptions(spark)))
    assert again.count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abß é1_-", max_size=12), min_size=1, max_size=8))
def test_words_match_python(spark, texts):
    import re

    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", words(F.col("t")).alias("w")).collect()
    assert {r["i"]: r["w"] for r in rows} == {i: re.findall(r"\w+", t.lower()) for i, t in enumerate(texts)}


def test_keywords_rank_by_count_then_position(spark):
    df = spark.createDataFrame([("a", "Krieg krieg Frieden kaiser Kaiser this über dass abc éclair")], "id string, text string")
    rows = K.top_keywords(df).orderBy("rank").collect()
    assert [(r["keyword"], r["n"]) for r in rows] == [("krieg", 2), ("kaiser", 2), ("frieden", 1), ("über", 1)]


@pytest.mark.parametrize("k, direct_hits", [(1, 0), (3, 0), (10, 0), (3, 10**9)])
def test_search_finds_the_same_best_as_full_scoring(spark, k, direct_hits):
    r = random.Random(k)
    common, rare = ["und", "war", "kaiser"], [f"wort{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(common if r.random() < 0.6 else rare) for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randint(0, 30))) for i in range(200)] + [(900 + i, "und und war wort1") for i in range(5)], "id long, claim string")
    queries = spark.createDataFrame([(i, text(8)) for i in range(15)] + [(99, "und"), (98, "nirgends")], "query_id long, text string")
    full = {}
    for row in S.bm25_scores(queries, docs).collect():
        full.setdefault(row["query_id"], []).append((-row["score"], row["doc_id"]))
    want = {q: [(d, -x) for x, d in sorted(hits)[:k]] for q, hits in full.items()}
    got = {}
    for row in S.bm25_search(queries, docs, k, 0.0, direct_hits=direct_hits).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["doc_id"], row["raw_score"]))
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for q in want for a, b in zip(got[q], want[q]))


def test_rhetoric_patterns_equal_backtracking(spark):
    """Counts and first words of every pattern against the plain regex, on texts full of first and second parts."""
    import re

    from claimspark import lexicons as L
    from claimspark.operators import propaganda as P

    rng = random.Random(6)
    plain = [w for _, _, _, rs in L.TECHNIQUE_PATTERNS for r in rs for w in re.findall(r"[a-zäöüß%' ]{3,}", r.lower())]
    texts = [" ".join(rng.choice(plain).strip() + rng.choice(["", "", ".", ",", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, low string").cache()
    for technique, weight, explanation, regexes in L.TECHNIQUE_PATTERNS:
        got = df.select("i", *[P._count(F.col("low"), r).alias(f"n{k}") for k, r in enumerate(regexes)], *[P._first_match(F.col("low"), r).alias(f"t{k}") for k, r in enumerate(regexes)]).collect()
        for row in got:
            for k, r in enumerate(regexes):
                found = [m for m in re.finditer(r, texts[row["i"]], re.IGNORECASE)]
                assert row[f"n{k}"] == len(found), (technique, k, texts[row["i"]])
                assert row[f"t{k}"] == (found[0].group(1) if found else None), (technique, k, texts[row["i"]])
    entry = df.select(F.explode(P.evidence(F.col("low"))).alias("e")).select("e.*")
    best = df.select(F.explode(P.best_per_technique(F.col("low"))).alias("e")).select("e.*")
    assert entry.select("technique", "confidence").exceptAll(best).count() == 0 == best.exceptAll(entry.select("technique", "confidence")).count()
    assert entry.filter("evidence not like 'Found pattern: _%' or explanation is null").count() == 0
    df.unpersist()


def test_rhetoric_time_is_linear(spark):
    import time

    from claimspark.operators import propaganda as P

    def seconds(n):
        df = spark.createDataFrame([("either want " * n + "they sie genius studies show aber " * n,)], "low string")
        df.select(P.best_per_technique(F.col("low"))).collect()
        start = time.perf_counter()
        df.select(P.best_per_technique(F.col("low"))).collect()
        return time.perf_counter() - start

    assert seconds(20_000) < 8 * seconds(5_000) + 1


def test_stored_pages_equal_a_sort(spark, capsys):
    rows = [(i, None if i % 50 == 0 else i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    order = ["v", "id"]
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    pages = K.store_pages(df, order, rows_per_part=90)
    assert sum(n for _, n in pages.counts) == 1000 and len(pages.counts) > 5
    get = lambda x: [tuple(r) for r in x.orderBy(*order).collect()]
    for offset, limit in [(0, 10), (85, 20), (15, 250), (990, 50), (1000, 5), (5000, 5), (0, 1000)]:
        assert get(pages.read(offset, limit)) == want[offset:offset + limit], (offset, limit)
    for i in (0, 19, 20, 500, 999):
        assert get(K.page_after(pages.rows, order, [want[i][1], want[i][0]], 30)) == want[i + 1:i + 31], i
    assert len(pages.ranges(700, 10)[0]) <= 2 < len(pages.counts)
    pages.read(700, 10).explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters")]
    assert filters and all("_part" in line for line in filters)
    empty = K.store_pages(df.limit(0), order)
    assert empty.counts == [] and empty.read(0, 5).count() == 0


def test_vote_sums_do_not_depend_on_their_order(spark):
    from itertools import permutations

    # 0.1 + 0.2 + 0.3 is 0.6 or 0.6000000000000001 in doubles, by the order of its terms
    rows = [(f"c{i}", j, v, c) for i, p in enumerate(permutations([0.1, 0.2, 0.3])) for j, (v, c) in enumerate(
        [("true", c) for c in p] + [("false", 0.6)])]
    votes = spark.createDataFrame(rows, "claim_id string, ordinal int, verdict string, confidence double").withColumns(
        {"explanation": F.lit(None).cast("string"), "correction": F.lit("c"), "claim_type": F.lit("other")}).coalesce(1)
    got = E.merge_votes(votes.select("claim_id").distinct(), votes).collect()
    assert len(got) == 6 and {r["verdict"] for r in got} == {"false"}


def test_edit_pairs_of_names_with_codes(spark):
    r = random.Random(4)
    heads, codes = ["large ring", "old bolt", "small gizmo"], [f"{r.getrandbits(32):08x}" for _ in range(25)]
    b = [f"{h} {c}" for h in heads for c in codes]
    a = b[::2] + [x[:-1] for x in b[1::2]] + ["the " + x for x in b[::3]] + [x[::-1] for x in b[::5]] + [x.replace("a", "b") for x in b] + codes[:5]
    pairs = TJ.edit_pairs(spark.createDataFrame([(x,) for x in a], "text string"), spark.createDataFrame([(x,) for x in b], "text string"), 0.8)
    got = {(p["left_text"], p["right_text"]) for p in pairs.collect()}
    assert got == {(x, y) for x in a for y in b if 1 - distance(x, y) / max(len(x), len(y)) >= 0.8}
    # cheap bits are compared before the edit distance
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "levenshtein" in line]
    assert joins and all(-1 < line.find("bit_count") < line.find("levenshtein") for line in joins)


def _walked(spark, a, b, theta, **sizes):
    from claimspark.operators.editwalk import walked_pairs

    left = spark.createDataFrame([(k, x) for k in "pq" for x in a], "k string, left_text string")
    right = spark.createDataFrame([("q", x) for x in b], "k string, right_text string")
    return [(r["k"], r["left_text"], r["right_text"], r["distance"]) for r in walked_pairs(left, right, theta, ["k"], **sizes).collect()]


@pytest.mark.parametrize("theta", [0.6, 0.8, 0.9])
def test_walked_pairs_lose_nothing(spark, theta):
    a = random_words(11, 150, "ab") + ["aaaaaaaaaaaa", "abababababab", "\U0001f600äöü straße"] + random_words(12, 40, "abcdef", 20, 40)
    b = random_words(13, 150, "ab") + ["aaaaaaaaaaa", "bababababab", "\U0001f600äoü strase"] + [x[3:9] + x for x in a[-20:]] + [x[2:] for x in a[-30:]]
    a, b = sorted(set(a)), sorted(set(b))
    near = lambda x, y: 1 - distance(x, y) / max(len(x), len(y)) >= theta
    got = _walked(spark, a, b, theta, left_rows=50, right_rows=40)
    assert len(got) == len(set(got)) and all(d == distance(x, y) for _, x, y, d in got)
    assert {(k, x, y) for k, x, y, _ in got if near(x, y)} == {("q", x, y) for x in a for y in b if near(x, y)}


def test_walks_go_on_over_parts_and_split_their_bands(spark, monkeypatch):
    from claimspark.operators import editwalk

    r = random.Random(5)
    b = sorted({f"old bolt {r.getrandbits(32):08x}" for _ in range(60)})
    a = sorted({x[:9] + "".join(r.choice("0123456789abcdef") if r.random() < 0.3 else c for c in x[9:]) for x in b * 5})
    want = {(x, y, d) for x in a for y in b if (d := distance(x, y)) <= 3}
    walk = editwalk.Walk(b, len(a[0]), 3)
    parts = [a[i:i + 7] for i in range(0, len(a), 7)]
    assert {(part[n], b[i], int(d)) for part in parts for n, which, ds in walk.feed(part) for i, d in zip(which, ds)} == want
    monkeypatch.setattr(editwalk, "STATE_BYTES", 2000)
    monkeypatch.setattr(editwalk, "FLUSH", 10)
    import pyarrow as pa

    rows = [(0, 0, y) for y in b] + [(0, 1, x) for x in a] + [(1, 0, "z")] + [(2, 1, "y")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + 50])], names=["_pair", "_side", "_text"]) for i in range(0, len(rows), 50)]
    got = [tuple(x.values()) for out in editwalk.walk_rows(iter(batches), 0.8) for x in out.to_pylist()]
    assert len(got) == len(want) and {x[1:] for x in got} == want


def test_long_texts_and_many_letters_are_walked(spark):
    r = random.Random(6)
    base = ["".join(chr(0x4E00 + r.randrange(400)) for _ in range(200)) for _ in range(4)]
    a = sorted({x[:i] + "?" * 5 + x[i + r.randrange(9):] for x in base for i in range(0, 190, 19)})
    got = _walked(spark, a, base, 0.9)
    assert {x[1:] for x in got if 1 - x[3] / max(len(x[1]), len(x[2])) >= 0.9} == {
        (x, y, distance(x, y)) for x in a for y in base if 1 - distance(x, y) / max(len(x), len(y)) >= 0.9}


def test_edit_pairs_of_large_tables_are_those_of_grams(spark):
    r = random.Random(7)
    b = sorted({f"{h} {r.getrandbits(32):08x}" for h in ("large ring", "old bolt", "small gizmo") for _ in range(300)})
    a = sorted({y for x in b for y in (x, x[:-1], "the " + x, x[::-1], x[-8:], x.replace("a", "b"))})
    left, right = (spark.createDataFrame([(x,) for x in side], "text string") for side in (a, b))
    rows = lambda few: sorted(tuple(x) for x in TJ.edit_pairs(left, right, 0.8, few=few).collect())
    walked = TJ.edit_pairs(left, right, 0.8)
    assert rows(0) == rows(10**9) == sorted(tuple(x) for x in walked.collect())
    # grams pair a share of all texts with each other, so large tables are not joined by them
    assert "levenshtein" not in walked._jdf.queryExecution().sparkPlan().toString()


def test_containment_of_texts_that_are_their_own_ids(spark):
    hay, needles = random_words(8, 80), random_words(9, 50, low=1, high=5)
    h = spark.createDataFrame([("p" if i % 2 else "q", x) for i, x in enumerate(hay)], "k string, t string")
    n = spark.createDataFrame([(k, x) for k in "pq" for x in needles], "k string, s string")
    rows = [(r["k"], r["t"], r["s"]) for r in TJ.containment_pairs(h, n, "t", "t", "s", "s", ["k"], short=True).collect()]
    assert sorted(rows) == sorted(("p" if i % 2 else "q", x, y) for i, x in enumerate(hay) for y in needles if y in x)


def test_copies_of_a_myth_are_matched_once(spark):
    from claimspark.operators import myths as M

    rows = [(f"m{i}", i, ["horned helmets", "the horned helmets of vikings"][i % 2], None if i % 4 else "helmets", ["horned", "old"]) for i in range(40)]
    rows.append((None, -1, "horned helmets", "helmets", ["horned", "old"]))
    base = spark.createDataFrame(rows, "id string, ordinal long, claim string, claim_en string, keywords array<string>")
    prepared = M._prepared(base)
    assert M._first_of_equal(prepared).count() == 4
    claims = spark.createDataFrame([("1", "Horned helmets"), ("2", "old news"), ("3", "the horned helmets of vikings"), ("4", ""), ("5", "none")], "claim_id string, text string")
    base = base.filter("id IS NOT NULL")
    got = {limit: sorted(map(tuple, M.match_myths(claims, base, inline_limit=limit).collect())) for limit in (0, 100)}
    assert got[0] == got[100] and got[0][0][2] == "m0"


def test_names_are_sought_by_wide_grams(spark, monkeypatch):
    """Every needle length and place is found, and names that share three-character grams alone are not paired."""
    hay = random_words(18, 120, "ab ", 1, 24) + ["äöü straße 12", "x😀yz 1234567", "the old bolt 0a1b2c3d", ""]
    needles = sorted({x[i:i + q] for x in hay for i in (0, 2, 5) for q in (1, 2, 3, 4, 5, 7, 8, 12)} | {"zzz", "old bolt 0a1b2c3e", "ba" * 9}) + [""]
    h = spark.createDataFrame([("k", x) for x in sorted(set(hay))], "k string, t string")
    n = spark.createDataFrame([("k", x) for x in needles], "k string, s string")
    rows = [(r["t"], r["s"]) for r in TJ.containment_pairs(h, n, "t", "t", "s", "s", ["k"], short=True).collect()]
    assert sorted(rows) == sorted((x, y) for x in set(hay) for y in set(needles) if y and y in x)

    codes = sorted(set("".join(random.Random(i).choices("abcd", k=8)) for i in range(400)))
    names = spark.createDataFrame([("k", "old bolt " + x) for x in codes], "k string, t string")
    monkeypatch.setattr(TJ.F, "contains", lambda *_: F.lit(True))  # what is left are the pairs to be checked
    pairs = TJ.containment_pairs(names, spark.createDataFrame([("k", x) for x in codes], "k string, s string"), "t", "t", "s", "s", ["k"], short=True)
    assert pairs.count() == len(codes)


def test_common_names_need_no_patterns(spark):
    from claimspark.functions.names import normalize_name

    names = {"Old  Bolt": "old bolt", " a b ": "a b", "A_1 b2": "a_1 b2", "O'Hara": "ohara", "Straße\t5": "straße 5", "": "", " ": "", "a\n": "a",
             "x y": "x y", "ab-c": "abc", "İx": None}
    df = spark.createDataFrame([(x,) for x in names], "n string").select("n", normalize_name(F.col("n")).alias("got"), F.regexp_replace(F.regexp_replace(
        F.regexp_replace(F.lower("n"), r"(?U)^\s+|\s+$", ""), r"(?U)[^\p{L}\p{N}_\s]", ""), r"(?U)\s+", " ").alias("slow"))
    for r in df.collect():
        assert r["got"] == r["slow"] and names[r["n"]] in (None, r["got"])


def test_no_shuffle_files_are_left_by_a_stored_table(spark):
    import time

    from claimspark.session import checkpoint

    files = lambda: {f.getName() for f in _java_files(spark) if f.getName().startswith("shuffle_")}
    before = files()
    stored = checkpoint(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and sorted(tuple(r) for r in stored.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]


def _java_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i) for i in range(found.size())]


def test_status_of_claims_is_read_from_stored_counts(spark):
    from claimspark.plans import validate as V

    dates = "birth_date date, death_date date, start_date date, end_date date, date_value date"
    nodes = spark.createDataFrame([(c, 0, "Person", "Ann Lee", None, *[None] * 5) for c in "ab"] + [("b", 1, "Location", "Nowhere", None, *[None] * 5)],
                                  f"claim_id string, ordinal int, node_type string, name string, description string, {dates}")
    rels = spark.createDataFrame([("b", 0, "Ann Lee", "LOCATED_AT", "Nowhere")], "claim_id string, ordinal int, source_name string, relation_type string, target_name string")
    facts = spark.createDataFrame([("f", 0, "Ann Lee", "Person", [])], "fact_id string, ordinal int, name string, node_type string, aliases array<string>")
    edges = spark.createDataFrame([("Ann Lee", "LOCATED_AT", "Rome")], "source_name string, relation_type string, target_name string")
    claims = spark.createDataFrame([("a",), ("b",), ("c",)], "claim_id string")
    rule = lambda n, r: V.res.issue_rows(n.filter("ordinal = 1"), "odd", "high", "odd")
    run = lambda **kw: V.validate_claims(claims, nodes, rels, facts, edges, rules=[rule], **kw)
    stored, lazy = run(), run(materialize=False)
    rows = lambda v: sorted(tuple(r) for r in v.claims.collect())
    assert rows(stored) == rows(lazy) and [r[1] for r in rows(stored)] == ["verified", "suspicious", "unverifiable"]
    assert [r[4:6] for r in rows(stored)] == [(0, 0), (1, 2), (0, 0)]
    assert stored.issues.count() == lazy.issues.count() == 3
    # the checks are counted one after the other, so the last step does not shuffle the nodes and relationships of all of them
    shuffles = lambda v: v.claims._jdf.queryExecution().sparkPlan().toString().count("Join")
    assert shuffles(stored) == 2 < shuffles(lazy)


def test_slices_have_all_rows_once(spark):
    from claimspark.session import checkpoint_slices

    rows = spark.createDataFrame([(f"c{i}" if i % 9 else None, i) for i in range(200)], "k string, v int")
    got = checkpoint_slices(lambda within: rows.filter(within), rows, "k", slice_rows=40)
    assert sorted(r["v"] for r in got.collect()) == list(range(200))
