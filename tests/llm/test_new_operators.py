"""Prefix tree, compressed token ids and phrases: brute force, awkward rows, both ways of every join."""

import hashlib
import random
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from claimspark.llm import decontam, phrases, rans, tokenids, toxicity, trie  # noqa: E402
from claimspark.llm.queries import tokenizer_path  # noqa: E402
from claimspark.session import shared_scratch  # noqa: E402

BYTES = tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a\n b", "a \nb", "a\n\n\nb", "a\n\nb ", "\n", " a", "don't Don'T  x's", "É́a étÉ ßİ", "a\u00a0b", "a \u00a0b", "x\x1cy \x1c z", "1234 56,7 a1b",
       "a\tb \t c", "日本語 テキスト 🙂", "word.\nNext", "a.b,c", "A" * 200 + " b", "x:\n\n", "e\u0301 E\u0301,", " , .", "µ ª º à", "ab\n\ncd\n\n\n\nef  gh\r\nij", "augepf$$$, (x) y%%%"]


# token ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_tokenizer(name):
    from tokenizers import Tokenizer

    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "b", " ", "\n", "É", ",", ".", "'s", "1", "  ", "\t"]) for _ in range(40)) for _ in range(200)]
    texts += ["\n".join(texts) * 60, "abc def. " * 40_000]
    whole = Tokenizer.from_file(tokenizer_path(name))
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for cache in (20, tokenids.CACHE_WORDS):  # a tiny dictionary changes generations all the time
        encode = tokenids.text_encoder(tokenizer_path(name), cache)
        assert encode(texts) == want and [encode([t])[0] for t in texts] == want


# 12 compressed ids


def test_frequencies_sum_to_the_scale():
    for counts in ([0, 5, 0, 1], [1] * 1000, [10 ** 12] + [1] * 5000, [7]):
        freqs = rans.shared_frequencies(np.array(counts), 13)
        assert freqs.sum() == 1 << 13 and ((freqs > 0) == (np.array(counts) > 0)).all()
    assert not rans.shared_frequencies(np.zeros(3)).any()
    with pytest.raises(ValueError):
        rans.shared_frequencies(np.ones(9), 3)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 200, 4096, 5001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 900).astype("<u4")
    table = rans.Table(rans.shared_frequencies(np.bincount(ids)))
    marks, states, words = rans.encode(ids, table, 8, 16)
    for first, last in ((0, n), (n // 3, n // 2 + 1), (n - 1, n), (n, n + 5)):
        got = rans.decode(n, table, np.array(marks), states, words, 8, 16, first, last)
        assert (got == ids[first:last]).all()
    data = rans.pack_block(3, 1, 77, ids, 5, b"", table)
    block = rans.Block(data)
    assert (block.ids(table) == ids).all() and (block.shard, block.start, block.first_ord) == (3, 77, 5)
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.Block(bytes(broken))


def test_checksums_combine():
    data = bytes(random.Random(2).randrange(256) for _ in range(3000))
    for cut in (0, 1, 17, 2999, 3000):
        assert rans.crc32_shift(zlib.crc32(data[:cut]), len(data) - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)


def token_rows(rows):
    """(doc_id, start, n, crc) of (doc_id, text) in order, straight from the tokenizer."""
    from tokenizers import Tokenizer

    whole, at, out = Tokenizer.from_file(BYTES), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "")[:64])):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [37, rans.BLOCK_IDS])
def test_store_round_trip(spark, block_ids):
    rows = [(i % 9 if i % 5 else None, None if i % 7 == 0 else f"{ODD[i % len(ODD)]} {i} " * (i % 4)) for i in range(60)] + [(3, "same"), (3, "same"), (100, "long text " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "shard": F.lit(1), "_place": F.lit(2)})
    path = shared_scratch(spark, "store")
    rans.write_ids(docs, path, BYTES, block_ids=block_ids)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rans.read_documents(spark, path).collect())
    assert [(d, s, n, c) for s, d, n, c in got] == token_rows(rows)
    total = got[-1][0] + got[-1][2]
    part = sorted((r["at"], r["ids"]) for r in rans.read_range(spark, path, 100, total - 50).collect())
    whole = [i for r in sorted((r["at"], r["ids"]) for r in rans.read_range(spark, path, 0, total).collect()) for i in r[1]]
    assert len(whole) == total and [i for _, ids in part for i in ids] == whole[100:total - 50]


def test_empty_store(spark):
    path = shared_scratch(spark, "store")
    rans.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, BYTES)
    assert rans.read_documents(spark, path).count() == 0


def test_store_of_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = shared_scratch(spark, "store")
    rans.write_ids(docs, path, BYTES)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rans.read_documents(spark, path).collect()))
    assert got == token_rows([(r["doc_id"], r["text"]) for r in docs.collect()])


# 13 phrases


def test_summary_keeps_every_frequent_item():
    r = random.Random(5)
    stream = [r.choice([1, 2, 3, r.randrange(10 ** 6)]) for _ in range(20_000)]
    for capacity in (50, 2500, 30_000):
        summary = phrases.MisraGries(capacity, 10)
        for at in range(0, len(stream), 700):
            items, counts = np.unique(np.array(stream[at:at + 700], dtype=np.uint64), return_counts=True)
            summary.merge(items, counts)
        kept = set(summary.survivors().tolist())
        assert {x for x in set(stream) if stream.count(x) >= 10} <= kept and summary.mass == len(stream) and summary.lost < 10


def phrase_rows(rows, low=10, max_words=3, top=2000):
    """{lang: [(phrase, a, l, r, n, score)]} by counting everything."""
    import collections
    import re

    f = collections.defaultdict(collections.Counter)
    sizes = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        sizes[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= low}
        rows = []
        for p, a in found.items():
            inner = [b for q, b in found.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 50 * a for b in inner):
                continue
            score, cut = min((10 ** 6 * a * a // (counts[p[:c]] * counts[p[c:]]), c) for c in range(1, len(p)))
            rows.append((" ".join(p), a, counts[p[:cut]], counts[p[cut:]], sizes[lang], score))
        out[lang] = sorted(rows, key=lambda r: (-r[5], -r[1], r[0].encode()))[:top]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("options", [{}, {"capacity": 40, "max_bits": 64}, {"max_words": 4}])
def test_phrases_equal_full_counts(spark, options):
    r = random.Random(9)
    words = ["new", "york", "City", "the", "of", "é", "a\x1cb", "x"]
    rows = [(r.choice(["en", "de", None, "und"]), None if i % 40 == 0 else "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "; "]) for _ in range(30))) for i in range(120)]
    rows += [("en", "hot phrase here " * 3000), ("en", ""), ("en", "one"), ("fr", "only once")] + [("de", "same line of words")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("z"), "k": F.lit(1), "f": F.lit(2)})
    got = {}
    for x in phrases.collocations(docs, **options).orderBy("lang", "rank").collect():
        got.setdefault(x["lang"], []).append((x["phrase"], x["a"], x["l"], x["r"], x["n"], x["score"]))
    assert got == phrase_rows(rows, max_words=options.get("max_words", 3))


def test_long_texts_are_counted_in_parts(monkeypatch):
    import pyarrow as pa

    text = ("alpha beta gamma. delta epsilon " * 200).strip()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    whole = np.sort(np.concatenate([phrases.occurrences(s, 3) for _, s in phrases.slabs(iter([batch]), 3)]))
    monkeypatch.setattr(phrases, "PART_BYTES", 50)
    parts = list(phrases.slabs(iter([batch]), 3))
    assert len(parts) > 50 and (np.sort(np.concatenate([phrases.occurrences(s, 3) for _, s in parts])) == whole).all()


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


# 11 prefix tree


def tree_rows(turns):
    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for p, members in nodes.items():
        below = {q: m for q, m in nodes.items() if q[:len(p)] == p}
        kids = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in below) for q in below)
        saved = sum((len(m) - 1) * len(brute.words(q[-1][1])) for q, m in below.items() if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(p)))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("small", [200_000, 0])
def test_tree_equals_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "BATCH_SHARES", (0.2, 0.6))
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    r = random.Random(6)
    rows = []
    for c in range(90):
        n = r.randrange(12) if c % 9 else 40
        rows += [(c, None if t == 3 else t, r.choice(["user", None]), "a b" if t < 6 and c % 2 else r.choice(["x", "y z", "", None])) for t in range(n)]
    rows += [(200 + c, t, "user", f"step {t}") for c in range(15) for t in range(c + 4)] + [(300 + c, t, "user", "copy") for c in range(20) for t in range(4)]
    rows += [(400, 1, "u", "same")] * 3 + [(401, 0, "u", "lone"), (None, 1, "u", "nobody")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"x": F.lit(1), "hi": F.lit(2), "_part": F.lit(3), "depth": F.lit(4)})
    got = [tuple(x) for x in trie.prefix_nodes(df, small).collect()]
    assert len(got) == len(set(got)) and set(got) == tree_rows(rows)


def test_tree_of_an_empty_table(spark):
    assert trie.prefix_nodes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# earlier operators


def test_items_without_their_first_or_last_characters():
    item = "what is the tallest mountain on earth and how high above the level of the sea does its summit rise in metres today"
    index = decontam.Index.of([(1, item)], decontam.Q, decontam.RATE)
    k = int(index.budget[0])
    for cut in range(k + 1):
        for text in (item[cut:] + " and something else follows", "something else before " + item[:len(item) - cut], item[cut:], item[:len(item) - cut]):
            assert index.search(text, decontam.Q), (cut, text)


def test_segments_of_a_million_tokens():
    model = toxicity.Model(np.array([1.0, -2.0]), 0.25, 1.0)
    start = time.process_time()
    assert len(model.segments(np.tile(np.array([0, 1]), 500_000))) == 500_000
    assert time.process_time() - start < 30
