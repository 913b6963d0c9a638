"""The training-data operators next to their SQL or a brute-force version, and on awkward rows."""

import collections
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from checks import compare  # noqa: E402
from claimspark.llm import chat, decontam, exactspans, linededup, neardup, packing, passages, pii, quality, queries, shingles, toxicity  # noqa: E402
from claimspark.llm.components import connected_components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, columns that clash with internal names."""
    long = " ".join(f"word{i * 7919 % 5003} and" for i in range(12000))
    data = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "xx", None, 4),
            (None, "a b c d e f g", "en", "s", 13), (5, long, "de", "t", len(long)), (6, long + " end", "de", None, 3), (1, "other text under the same id", "fr", "u", 3), (7, "é\U0001f600 x", "", "", 4)]
    return spark.createDataFrame(data, DOCS).withColumns({"words": F.lit(1), "rep": F.lit("x"), "_id": F.lit(2), "line": F.lit("y"), "doc": F.lit(None).cast("long")})


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, duck, sf_dir, name):
    ok, note = compare.check(spark, duck, name, queries.QUERIES[name], queries.ORACLE[name], sf_dir)
    assert ok and "TYPES" not in note, note


def test_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# 1 near-duplicates


def test_near_duplicates_of_a_family(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    data = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        data.append((i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(data, DOCS)
    want = brute.components([(r[0], r[1]) for r in data])
    assert len({c for _, c in want.values()}) > 3
    for limit in (neardup.MAX_REGION, 40):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, max_region=limit).collect()}
        if limit == neardup.MAX_REGION:
            assert got == want
        else:  # deeper regions may miss a link but never make one
            assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def test_near_duplicates_in_split_regions(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    data = []
    for i in range(260):  # pairs near the bound, of which few others are linked
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            w[at] = f"x{i}-{at}"
        data.append((i, " ".join(w), "en", "s", 1))
    df = spark.createDataFrame(data, DOCS)
    want = brute.components([(r[0], r[1]) for r in data])
    assert len({c for _, c in want.values()}) > 20
    for limit in (40, 12):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, max_region=limit).collect()}
        assert got == want


def test_blocks_meet_every_pair_once(spark):
    rows = [(i, 3, 77, 50, 0 if i < 30 else i) for i in range(50)]
    placed = spark.createDataFrame(rows, "rep long, tree int, region long, n long, component long")
    groups = collections.defaultdict(list)
    for r in neardup.met_blocks(placed, 10).collect():
        groups[r["region"]].append((r["rep"], r["component"], r["block"]))
    met = collections.Counter((min(a[0], b[0]), max(a[0], b[0])) for g in groups.values() for i, a in enumerate(g) for b in g[:i] if a[1] != b[1] and a[2] != b[2])
    assert met == {(a, b): 1 for b in range(30, 50) for a in range(b)} and max(map(len, groups.values())) < 30


def test_near_duplicates_of_odd_rows(odd):
    got = [tuple(r) for r in neardup.near_duplicates(odd).orderBy("doc_id", "n_shingles").collect()]
    assert got == [(None, 3, None, True), (1, 2, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True),
                   (5, got[7][1], 5, True), (6, got[8][1], 5, False), (7, 1, 7, True)]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150)] + [(300, i) for i in range(301, 340)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 150: 150, 200: 150, **{i: 300 for i in range(300, 340)}}


def test_word_hashes_split_as_the_pattern():
    text = "\x0bA bc\t\td e é\n\x1cF  "
    assert len(shingles.word_hashes(text)) == len(brute.words(text))
    assert (shingles.word_hashes("Ab CD ab") == shingles.word_hashes("aB cd AB")).all() and len(shingles.word_hashes(" \n")) == 0


# 2 line dedup


def test_lines_near_the_bound(spark):
    data = [(i, f"line on {n}\nown {i}-{n}\n\nline on {n}", "en", f"site{i}", 1) for n in (8, 9, 10, 11, 30) for i in range(100 * n, 100 * n + n)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(data, DOCS)).collect()}
    want = brute.dedup_lines([(r[0], r[1], r[3]) for r in data], linededup.MIN_SITES)
    assert got == want and sum("line on" in t for t in got.values()) == 8 + 9 + 1 + 1 + 1


def test_lines_of_odd_rows(odd):
    out = linededup.dedup_lines(odd, min_sites=1)
    assert out.columns == [*odd.columns, "_n_lines", "_n_removed"] and out.count() == odd.count()
    assert {r["text"] for r in out.filter("doc_id = 2").collect()} == {None}
    assert [r["text"] for r in out.filter("doc_id = 1").orderBy("text").collect()] == ["", "", "other text under the same id"]  # null comes first
    assert out.filter("doc_id is null").first()["text"] == "a b c d e f g" and linededup.dedup_lines(odd.limit(0)).count() == 0


# 3 chat


def test_perspectives(spark):
    data = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, None, None, "x"), (3, 0, "system", "only"), (None, 5, "cy", "z"), (1, 2, "bob", "yo")]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("own", F.lit(1))
    got = {(r["conv_id"], r["participant"]): r for r in chat.rotate_perspectives(d).collect()}
    assert sorted(got, key=str) == sorted([(1, "ann"), (1, "bob"), (2, "unknown"), (None, "cy")], key=str)
    ann = got[(1, "ann")]
    assert ann["n_turns"] == 5 and ann["text"].startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\nyo<|end|>\n")
    assert [ann["text"][a:b] for a, b in zip(ann["mask_starts"], ann["mask_ends"])] == ["hi < |end|><|end|>", "<|end|>"]
    bob = got[(1, "bob")]
    assert [bob["text"][a:b] for a, b in zip(bob["mask_starts"], bob["mask_ends"])] == ["yo<|end|>", "yo<|end|>"]
    assert chat.rotate_perspectives(d.limit(0)).count() == 0


def test_long_dialogue_comes_in_parts(spark):
    d = spark.range(0, 250).selectExpr("7L conv_id", "id turn", "if(id % 2 = 0, 'a', 'b') role", "'t' text")
    got = chat.rotate_perspectives(d, part_turns=100).groupBy("part").agg(F.sum("n_turns").alias("n")).orderBy("part").collect()
    assert [tuple(r) for r in got] == [(0, 200), (1, 200), (2, 100)]


# 4 exact spans


def test_repeated_bytes(rows, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in exactspans.remove_repeats(docs).collect()}
    assert got == brute.remove_repeats([(r[0], r[1]) for r in rows])


def test_repeated_bytes_in_hard_texts(spark):
    rng = random.Random(5)
    fresh = lambda n: "".join(rng.choice("abcde é\n") for _ in range(n))
    passage = fresh(180)
    data = [(i, fresh(rng.randrange(90)) + passage[rng.randrange(40):140 + rng.randrange(40)] + fresh(rng.randrange(90)), "en", "s", 1) for i in range(60)]
    data += [(100, "a" * 700, "en", "s", 1), (101, "ab" * 300 + "a" * 99, "en", "s", 1), (102, passage[:99], "en", "s", 1), (103, None, "en", "s", 1), (104, "a" * 100, "en", "s", 1)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in exactspans.remove_repeats(spark.createDataFrame(data, DOCS).repartition(5)).collect()}
    assert got == brute.remove_repeats([(r[0], r[1]) for r in data])


def test_repeated_bytes_of_odd_rows(odd):
    out = exactspans.remove_repeats(odd)
    assert out.count() == odd.count() and exactspans.remove_repeats(odd.limit(0)).count() == 0
    removed = {r["doc_id"]: r["n_removed"] for r in out.filter("doc_id > 1").collect()}
    assert removed[5] < removed[6] and removed[2] == removed[3] == 0


def test_pieces_of_a_long_text(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choices(b"abc ", k=3000)), dtype=np.uint8)
    whole = [np.concatenate(c) for c in zip(*exactspans.blocks(data, 100, 32))]
    monkeypatch.setattr(exactspans, "PIECE", 700)
    parts = [np.concatenate(c) for c in zip(*exactspans.blocks(data, 100, 32))]
    starts = lambda places: sorted(i for p in places.tolist() for i in range(p >> 16, (p >> 16) + (p & 255) + 1))
    assert starts(whole[2]) == starts(parts[2]) == list(range(2901))
    cells = exactspans.cells(data, whole[2], 100)
    assert starts(cells[2]) == list(range(2901))
    singles = [np.concatenate(c) for c in zip(*exactspans.starts(cells[0], cells[2], cells[3]))]
    assert starts(singles[2]) == list(range(2901))


# 5 pseudonyms


@pytest.fixture(scope="module")
def pseudonyms(spark):
    values = ["4539 1488 0343 6467", "4539148803436467", "4539148803436468", "(415) 555-2671", "+1 (415) 555-2671", "192.168.1.300", "10.0.0.1", "2024-02-30", "2024-02-29", "1900-01-01", "2099-12-31", "Ann.B-7@mail.example.com"]
    df = spark.createDataFrame([(i, f"x {v}, y") for i, v in enumerate(values)] + [(90, None), (91, ""), (92, "no value 12"), (93, f"{values[1]} and 10.0.0.1 10.0.0.1")], "doc_id long, text string").withColumn("_values2", F.lit(1))
    out = {r["doc_id"]: r for r in pii.pseudonymize(df, "k").collect()}
    return values, out


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) % 10 + (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_the_format(pseudonyms):
    values, out = pseudonyms
    new = [out[i]["text"][2:-3] for i in range(len(values))]
    assert luhn(new[1]) and new[0].replace(" ", "") == new[1] != values[1] and [c == " " for c in new[0]] == [c == " " for c in values[0]]
    assert new[2] == values[2] and new[5] == values[5] and new[7] == values[7]  # fail their checks
    assert new[4] == "+1 " + new[3] and new[3] != values[3] and new[3][0] == "(" and new[3][1] in "23456789"
    assert all(0 <= int(x) < 256 for x in new[6].split(".")) and new[6] != values[6]
    import datetime
    assert all("1900-01-01" <= datetime.date.fromisoformat(new[i]).isoformat() <= "2099-12-31" for i in (8, 9, 10)) and len({new[8], new[9], new[10]}) == 3
    assert new[11].endswith("@mail.example.com") and len(new[11]) == len(values[11]) and new[11][3] == "." and new[11][5] == "-"
    assert out[90]["text"] is None and out[91]["text"] == "" and out[92]["text"] == "no value 12"
    assert out[93]["text"] == f"{new[1]} and {new[6]} {new[6]}"


def test_pseudonyms_of_cards_beside_digits_and_of_low_areas(spark):
    card, ip = "4111 1111 1111 1111", "97.51.17.173"
    plain = card.replace(" ", "")
    texts = [card, ip, f"{card} 12", f"12 {plain}", f"{plain} {ip}", f"{card} 4539148803436467", f"1 {plain} 2 1", "4111 1111 1111 1112 12", f"{plain}.",
             "+1 (017) 555-7713", "(000) 200-0000", "199-999-9999", "017 155 7713", "(415) 555-2671"]
    got = [r["text"] for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    new, new_ip = got[0], got[1]
    assert new != card and new_ip != ip and luhn(new.replace(" ", ""))
    bare = new.replace(" ", "")
    assert got[2] == f"{new} 12" and got[3] == f"12 {bare}" and got[4] == f"{bare} {new_ip}" and got[6] == f"1 {bare} 2 1" and got[8] == f"{bare}."
    assert got[5].startswith(new + " ") and got[5][20:] != "4539148803436467" and luhn(got[5][20:])
    assert got[7] == texts[7] and got[12] == texts[12]  # no card, no exchange
    for old, mapped in zip(texts[9:12], got[9:12]):
        shape = lambda x: "".join("9" if c.isdigit() else c for c in x)
        area = int(mapped.removeprefix("+1 ").lstrip("(")[:3])
        assert mapped != old and shape(mapped) == shape(old) and area < 200, (old, mapped)
    assert int(got[13][1:4]) >= 200 and got[13] != texts[13]


def test_feistel_is_a_permutation(spark):
    d = spark.range(30).select(*[F.col("id").alias("a")]).crossJoin(spark.range(7).select(F.col("id").alias("b")))
    got = d.select(pii.feistel(F.col("a"), F.col("b"), 30, 7, "k", "t").alias("p")).select("p.*").distinct()
    assert got.count() == 210 and got.filter("a >= 30 or b >= 7 or a < 0 or b < 0").count() == 0


def test_dates_are_permuted(spark):
    d = spark.range(0, pii.DAYS, 7).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    got = d.select(pii._date(F.col("day"), "k").alias("new"))
    assert got.select("new").distinct().count() == d.count() and got.filter("new < '1900-01-01' or new > '2099-12-31'").count() == 0


# 6 decontamination


def test_contamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(12)] + [(50, None), (51, "short"), (52, "twelve chars")]
    data = []
    for i in range(70):
        t = list(items[i % 12][1])
        for _ in range(rng.randrange(0, len(t) // 8)):
            at = rng.randrange(len(t))
            t[at:at + rng.randrange(2)] = rng.choice(["", "z", "zz"])
        data.append((i, " ".join(word() for _ in range(rng.randrange(20))) + " " + "".join(t).upper() + " " + word()))
    data += [(100, None), (101, ""), (102, items[0][1]), (103, "xx Twelve Chars yy")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_CHARS, 300):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.benchmark_hits(d, bench, block_chars=block).collect()}
        assert got == brute.contaminated(data, [x for x in items if x[1] and len(x[1]) >= decontam.Q], decontam.Q, decontam.RATE)
    assert 20 < len(got) < 70
    clean = decontam.clean_documents(d.withColumn("item_id", F.lit(1)), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in data} - {i for i, _ in got} and clean.columns == ["doc_id", "text", "item_id"]
    assert decontam.benchmark_hits(d, bench.limit(0)).count() == 0 and decontam.benchmark_hits(d.limit(0), bench).count() == 0


# 7 passages


def test_fuzzy_passages(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = text(90)
    data = []
    for i in range(40):
        p = list(passage)
        for _ in range(5):
            p[rng.randrange(90)] = f"e{i}"
        del p[30 + i % 5]
        data.append((i, " ".join(text(20 + i) + p + text(30))))
    data += [(100, " ".join(text(100))), (101, None), (102, ""), (103, " ".join(passage[:30]))]
    got = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").withColumn("at", F.lit(0))).collect()
    by = collections.Counter(r["doc_id"] for r in got)
    assert set(by) == set(range(1, 40)) and all(r["partner_id"] < r["doc_id"] for r in got)
    for r in got:
        t = dict(data)[r["doc_id"]]
        assert abs(len(t[:r["start"]].split()) - (20 + r["doc_id"])) <= 30 and 50 <= r["n_words"] <= 95 and r["n_edits"] <= 18


def test_passages_of_odd_rows(odd):
    got = [tuple(r)[:2] for r in passages.repeated_passages(odd).collect()]
    assert set(got) == {(6, 5)} and passages.repeated_passages(odd.limit(0)).count() == 0


def test_a_passage_between_others_that_hold_its_seeds(spark):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    passage = text(70)
    pieces = lambda: " ".join(" ".join(passage[i:i + 20] + text(40)) for i in rng.sample(range(0, 60, 6), 10))
    whole = lambda: " ".join(text(20) + passage + text(20))
    data = [(1, pieces()), (2, whole()), (3, pieces()), (4, pieces()), (5, whole()), (6, pieces())]
    got = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string"), rest=True).collect()
    assert [(r["doc_id"], r["partner_id"], r["n_words"], r["n_edits"]) for r in got] == [(5, 2, 70, 0)]


def test_the_passage_query_finds_a_passage_between_others_that_hold_its_seeds(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    passage = text(70)
    pieces = lambda: " ".join(" ".join(passage[i:i + 20] + text(40)) for i in rng.sample(range(0, 60, 6), 10))
    whole = lambda: " ".join(text(20) + passage + text(20))
    data = [(1, pieces()), (2, whole()), (3, pieces()), (4, pieces()), (5, whole()), (6, pieces())]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_passage_chaining(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["partner_id"], r["n_words"], r["n_edits"]) for r in got] == [(5, 2, 70, 0)]


def test_a_line_of_many_documents_makes_no_pairs(spark):
    rng = random.Random(7)
    text = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    line, passage = text(16), text(60)
    texts = [text(30) + line + text(30) for _ in range(40)]
    texts[30] += passage
    texts[39] += passage
    k, window, apart = passages.SEED_WORDS, passages.WINDOW, 50 - 2 * (passages.WINDOW + passages.SEED_WORDS) - passages.SEED_WORDS
    docs = spark.createDataFrame([(i, " ".join(t).encode()) for i, t in enumerate(texts)], "doc long, data binary")
    seeds = docs.mapInArrow(lambda it: passages.all_seeds(it, k, window), "seed long, doc long, at long").coalesce(1).sortWithinPartitions("seed", "doc", "at")
    shared = seeds.mapInArrow(lambda it: passages.shared_seeds(it, k + window), passages.SHARED).cache()
    places = shared.filter("side = 0").select("doc", "at", "seed", F.lit(True).alias("open"))
    pairs = passages.open_pairs(shared, places, docs, passages.MAX_GAP + k + window, apart).collect()
    assert [tuple(r) for r in pairs] == [(39, 30)]


def test_pair_keys_meet_on_every_chain():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    reach, apart = 45, 19
    keys = lambda at, seed, is_open, earlier: {r["key"] for b in passages.pair_keys(iter([pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(len(at), dtype=np.int64)), pa.array(at.astype(np.int64) << passages.BYTE_BITS), pa.array(seed), pa.array(is_open)],
        names=["doc", "at", "seed", "open"])]), reach, apart, earlier) for r in b.to_pylist()}
    for _ in range(300):
        n = int(rng.integers(2, 12))
        steps = lambda: np.cumsum(rng.choice([1, 4, 9, 20, reach], n))
        x, y, seed = steps(), steps(), rng.integers(0, 5, n)
        is_open = np.arange(n) == rng.integers(0, n)
        if x[-1] - x[0] >= apart and y[-1] - y[0] >= apart:
            assert keys(x, seed, is_open, False) & keys(y, seed, np.ones(n, dtype=bool), True)


def test_shared_seeds_do_not_depend_on_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = np.unique(np.column_stack([rng.integers(0, 12, 300), rng.integers(0, 5, 300), rng.integers(0, 200, 300) << passages.BYTE_BITS]), axis=0)
    rows = rows[~((rows[:, 0] == 7) & (rows[:, 1] > 0))]  # a seed of one document
    want = []
    for seed in range(12):
        docs = sorted({d for s, d, _ in rows.tolist() if s == seed})
        for earlier, doc in enumerate(docs if len(docs) > 1 else []):
            at = [a for s, d, a in rows.tolist() if (s, d) == (seed, doc)]
            runs = [[at[0]]]
            for a in at[1:]:
                runs[-1].append(a) if (a - runs[-1][-1]) >> passages.BYTE_BITS <= 13 else runs.append([a])
            for run in runs:
                want += [(seed, doc, a, 0, i, earlier) for i, a in enumerate(run)]
                want += [(seed, doc, a, 1, i, earlier) for i, a in enumerate(run[::-1]) if len(run) > 1]
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i:i + size].T.copy()], names=["seed", "doc", "at"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in passages.shared_seeds(iter(batches), 13) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)


def test_chains_equal_the_quadratic_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = 25
        x, y = rng.integers(0, 80, n), rng.integers(0, 80, n)
        runs = np.column_stack([x, x + 5, y, y + 5, np.arange(n), np.arange(n)])
        got = passages.chains_of(runs, 0.2, 10 ** 6)
        score = [0.0] * n
        for i in sorted(range(n), key=lambda i: x[i]):
            gains = [score[j] - 0.2 * (x[i] - x[j] - 5 + y[i] - y[j] - 5) for j in range(n) if x[j] + 5 <= x[i] and y[j] + 5 <= y[i]]
            score[i] = 5 + max([0.0, *gains])
        best = got[0]
        total = sum(5 for _ in best) - sum(0.2 * (x[b] - x[a] - 5 + y[b] - y[a] - 5) for a, b in zip(best, best[1:]))
        assert math.isclose(total, max(score)) and sorted(i for c in got for i in c) == list(range(n))


def test_chains_take_the_best_predecessor_in_reach():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = 40
        x, y = rng.integers(0, 150, n), rng.integers(0, 150, n)
        size = np.where(np.arange(n) % 13 == 0, 60, 5)
        runs = np.column_stack([x, x + size, y, y + size, np.arange(n), np.arange(n)])
        got = passages.chains_of(runs, 0.2, 32)
        score = [0.0] * n
        for i in sorted(range(n), key=lambda i: x[i]):
            gains = [score[j] - 0.2 * (x[i] - x[j] - size[j] + y[i] - y[j] - size[j]) for j in range(n)
                     if 0 <= x[i] - x[j] - size[j] <= 32 and 0 <= y[i] - y[j] - size[j] <= 32]
            score[i] = size[i] + max([0.0, *gains])
        total = sum(size[a] for a in got[0]) - sum(0.2 * (x[b] - x[a] - size[a] + y[b] - y[a] - size[a]) for a, b in zip(got[0], got[0][1:]))
        assert math.isclose(total, max(score)) and sorted(i for c in got for i in c) == list(range(n))
    # a long passage, then a fuzzy one of five runs a hundred words later
    starts = [0, *range(400, 465, 13)][:6]
    runs = np.array([(s, s + (300 if s == 0 else 12), s, s + (300 if s == 0 else 12), i, i) for i, s in enumerate(starts)])
    assert sorted(passages.chains_of(runs, 0.2, 32)) == [[0], [1, 2, 3, 4, 5]]


# 8 packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()


def test_packing(docs, rows, tokenizer):
    got = [tuple(r) for r in packing.pack_documents(docs.repartition(3), queries.tokenizer_path()).collect()]
    assert brute.check_packing(got, {r[0]: ids_of(tokenizer, r[1]) for r in rows}) < 0.02


def test_packing_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "a<|endoftext|>b", "Ǻ ΣΣ. it's 12½\t x y\r\nz", "'s's <|startoftext|> ퟿", "word " * 5000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("offset", F.lit(1))
    got = [tuple(r) for r in packing.pack_documents(d, queries.tokenizer_path()).collect()]
    brute.check_packing(got, {i: ids_of(tokenizer, t) for i, t in enumerate(texts)})
    assert packing.pack_documents(d.limit(0), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [1, 31, 32, 33, 66, 500, 1023, 1024, 1025, 1500, 2047, 2048, 2049, 9999])
def test_cut(n):
    pieces = list(packing.cut(n, 2048, 32))
    assert sum(p for p, _ in pieces) == n and all(0 <= 2048 - k * p <= 32 for p, k in pieces)


# 9 toxicity


def test_toxicity_on_held_out_labels(spark):
    d = queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = [tuple(r) for r in d.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()]
    good = sum(p == t for _, p, t in seen) / len(seen)
    ranks = {s: i for i, s in enumerate(sorted({s for s, _, _ in seen}))}
    pos, neg = [ranks[s] for s, _, t in seen if t], [ranks[s] for s, _, t in seen if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert good > 0.93 and auc > 0.94
    assert d.filter("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0


def test_segments_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        scores = np.where(rng.random(30) < 0.5, -0.1, rng.normal(0, 2, 30))
        model = toxicity.Model(scores, 0.1, 1.0)
        got = model.segments(np.arange(30))
        best = max((scores[a:b].sum() for a in range(30) for b in range(a + 1, 31)), default=0)
        assert math.isclose(max(s for s, _, _ in got), best, rel_tol=1e-9)
        assert all(math.isclose(s, scores[a:b].sum(), abs_tol=1e-9) for s, a, b in got)
        spans = sorted((a, b) for _, a, b in got)
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))


def test_toxicity_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 1), (5, 1, 0), (None, 1, 1), (6, 0, None), (999, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(odd, labels, buckets=1024)
    assert got.count() == odd.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity_scores(odd.limit(0), labels, buckets=1024).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(odd, labels.filter("toxic = 0"), buckets=1024).collect()} == {0.0}


# 10 quality


def test_quality(docs, rows):
    got = {r["doc_id"]: ((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]), r["base_failed"], r["kept"]) for r in quality.quality_report(docs).collect()}
    assert got == brute.quality([r[:3] for r in rows], quality)


def test_quality_of_odd_rows(odd):
    got = quality.quality_report(odd)
    assert got.count() == odd.count() and quality.quality_report(odd.limit(0)).count() == 0
    assert got.filter("base_failed is null or kept is null").count() == 0 and not got.filter("doc_id = 2").first()["kept"]


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "x " * 40, "l1 a\nl1 a\n \n \nl1 a", "1 2 3 4 5 6 1 2 3 4 5 9 3 4 5 9 1", "   x"])
def test_counts(spark, text):
    r = quality.quality_report(spark.createDataFrame([(1, text, "en", "s", 1)], DOCS)).first()
    assert tuple(r[1:6]) == brute.counts(text)


# pipeline


def test_pipeline_equals_brute_force(spark, sf_dir, rows, tokenizer):
    kept = brute.quality([r[:3] for r in rows], quality)
    left = [r for r in rows if kept[r[0]][2]]
    cut = brute.dedup_lines([(r[0], r[1], r[3]) for r in left], linededup.MIN_SITES)
    left = [(i, cut[i]) for i, t, _, _ in left if cut[i] == t or brute.words(cut[i])]
    parts = brute.components(left, 80)
    left = [(i, t) for i, t in left if parts[i][1] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute.contaminated(left, items, decontam.Q, decontam.RATE)}
    left = [(i, t) for i, t in left if i not in bad]
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert bad and len(left) > 100
    brute.check_packing(got, {i: ids_of(tokenizer, t) for i, t in left})


def test_pipeline_takes_odd_rows(spark, odd, sf_dir):
    for data in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, data, sf_dir)
            assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
            out.collect()
