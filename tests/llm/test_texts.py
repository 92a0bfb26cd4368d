"""SentencePiece, importance resampling and collocations against the library and brute force, with the odd rows of the contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from typeloom.llm import collocations, common, importance, sentences
from typeloom.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
CLASH = ("ids", "decoded", "n", "tie", "at", "part", "first", "fit", "weight", "rank", "lang_", "size", "stream", "score")
ODD = [(1, None, None), (2, "", "en"), (3, "one", "en"), (4, "Same words here", "de"), (4, "Same words here", "de"), (5, "same WORDS here", None), (6, "x " * 60_000, "en"), (7, "é\U0001f600 \x0b z", ""), (None, "the null id", "en"), (8, "  a  b ▁c▁▁ \n\td  ", "en"), (9, "y" * 30_000, "fr"), (10, " ", "en"), (11, "\x00 \x1c q", "und")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({c: F.lit(-1) for c in CLASH})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- SentencePiece -------------------------------------------------------------------------------------------------


def by_library(rows):
    model = sentences.loaded(sentences.model_path())
    out = []
    for doc_id, text in rows:
        ids = model.encode(text or "", add_eos=True)
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids))))
    return sorted(out, key=str)


def test_sentencepiece_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    got = QUERIES["op11_sentencepiece"](spark, DIR)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == by_library(rows)


def test_sentencepiece_odd(spark, odd):
    model = sentences.loaded(sentences.model_path())
    got = sentences.decode(sentences.encode(odd)).collect()
    want = [(i, model.encode(t or "", add_eos=True), model.decode(model.encode(t or ""))) for i, t, _ in ODD]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plain = sentences.encode(odd, end=False).filter("doc_id = 2 OR doc_id = 3").collect()
    assert sorted((r.doc_id, r.ids) for r in plain) == [(2, []), (3, model.encode("one"))]
    assert sentences.decode(sentences.encode(odd.limit(0))).count() == 0
    null = spark.createDataFrame([(1, None), (2, [264])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in sentences.decode(null).collect()) == [(1, None), (2, "a")]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list(" ▁ab.\nTé\U0001f600<s>0the")), max_size=60))
def test_sentencepiece_windows(text):
    """Words one by one, in small windows and with a table that starts anew all the time, are as the library has them whole."""
    table = test_sentencepiece_windows.__dict__.setdefault("table", sentences.ChunkTable(sentences.model_path(), memo=3, window=4))
    assert np.frombuffer(table.of(text), "<i4").tolist() == table.model.encode(text)


def test_sentencepiece_splits():
    model = sentences.loaded(sentences.model_path())
    assert sentences.splits_at_markers(model)
    whole = sentences.ChunkTable(sentences.model_path())
    whole.apart = False
    assert np.frombuffer(whole.of(" some words\nhere"), "<i4").tolist() == model.encode(" some words\nhere")


# --- importance ----------------------------------------------------------------------------------------------------


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def by_definition(docs, target, percent=5):
    source, aim = Counter(), Counter()
    made = [(i, *grams(t)) for i, t in docs]
    for _, _, g in made:
        source.update(g)
    for t in target:
        aim.update(grams(t)[1])
    s_all, t_all = source.total(), aim.total()
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in source}
    rows, fit = [], []
    for i, n, g in made:
        weight = sum(gain[b] for b in g)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        fit += [rows[-1]] if n >= 20 else []
    fit.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def test_importance_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DIR}/benchmark.parquet'").fetchall()]
    got = QUERIES["op12_importance"](spark, DIR)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == by_definition(docs, target)


def test_importance_odd(spark, odd):
    """Half of the rows drawn, so that ties, repeated rows and null ids are among them."""
    words = " ".join(f"w{i}" for i in range(30))
    more = [(20, words, "en"), (20, words, "en"), (21, words, "en"), (None, words, "en"), (22, "many " * 25, "de")]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    target = spark.createDataFrame([(1, "Many words, some w1 w2"), (2, None)], "item_id long, text string")
    got = importance.resampled(docs, target, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == by_definition([r[:2] for r in ODD + more], ["Many words, some w1 w2", None], 50)
    assert importance.resampled(docs.limit(0), target).count() == 0
    assert importance.resampled(docs, target.limit(0)).count() == len(ODD + more)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list(" aB9é.\n")), max_size=60), st.integers(1, 20))
def test_importance_windows(text, window):
    n, want = grams(text)
    words, got = importance.features(text.encode(), window=window)
    assert words == n and sorted(got.tolist()) == sorted(want)


def test_numbered(spark):
    """Places within groups, over many ranges, with equal rows and clashing names."""
    rows = [(g, v) for g in "abc" for v in [3, 1, 2, 2, 2, 9, *range(50)]] + [("d", 1)]
    df = common.saved(spark.createDataFrame(rows, "g string, v int").withColumns({c: F.lit("x") for c in ("at", "part", "n", "tie", "first")}))
    got = defaultdict(list)
    for r in common.numbered(df, [F.desc("v")], "place", "g").collect():
        got[r.g].append((r.place, r.v))
    for g, some in got.items():
        want = sorted((v for x, v in rows if x == g), reverse=True)
        assert sorted(some) == list(enumerate(want, 1))
    every = common.numbered(df, [F.asc("v")], "place").collect()
    assert [r.v for r in sorted(every, key=lambda r: r.place)] == sorted(v for _, v in rows)


# --- collocations --------------------------------------------------------------------------------------------------


def phrases_of(rows, least=10, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        longest = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longest[q] = max(longest[q], a)
        some = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * longest[p] < 50 * a:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                some.append((" ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score))
        some.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(some[:top], 1)]
    return sorted(out)


def test_collocations_query(spark):
    rows = duckdb.sql(f"SELECT text, lang FROM '{DIR}/documents.parquet'").fetchall()
    got = QUERIES["op13_collocations"](spark, DIR)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_of(rows)


@pytest.mark.parametrize("shard", [1, 700, collocations.SHARD])
def test_collocations_shards(spark, odd, shard):
    """Ties, overlaps, rare phrases, a hot pair, many languages, shards of one text, and ranges that cut through one word."""
    draw = random.Random(5)
    rows = [(None, " ".join(draw.choices(["a", "b", "c", "Dé", "e\t\x0c", "f.", "\x01", "a b", "  ", "g\U0001f600"], k=60)), draw.choice(["en", "en", "de", None, "und", "en-x"])) for _ in range(150)]
    rows += [(1, "hot pair of words " * 40, "en"), (1, "a a a a a a a a a a a a a a a a a", "fr")]
    docs = odd.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string")).withColumns({c: F.lit(1) for c in CLASH})
    got = collocations.ranked(collocations.collocations(docs, shard=shard), 20).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == phrases_of([r[1:] for r in ODD + rows], top=20)
    assert collocations.ranked(collocations.collocations(docs.limit(0))).count() == 0


def test_trie_cuts():
    """What a trie's ranges hold together is the trie; serialised arrays come back as they were."""
    draw = random.Random(3)
    trie = collocations.Trie([collocations.tokens(" ".join(draw.choices("abcdefgh.", k=400)).encode())])
    limits = [("en", b"b", b"c"), ("en", b"b", b"e"), ("en", b"bb", b"a"), ("en", b"h", b"h")]
    counts, words = Counter(), Counter()
    for low, high in zip([None, *limits], [*limits, None], strict=True):
        names, a = collocations.unpacked(trie.cut(low, high))
        for w, n in zip(a[0], a[1], strict=True):
            words[names[w]] = n
        for p, q, n in zip(a[2], a[3], a[4], strict=True):
            assert (low is None or low[1:] <= (names[p], names[q])) and (high is None or (names[p], names[q]) < high[1:])
            counts[names[p], names[q]] += n
        for p, q, n in zip(a[5], a[6], a[7], strict=True):
            counts[names[a[2][p]], names[a[3][p]], names[q]] += n
    n = len(trie.words)
    pairs = [(trie.words[k // n], trie.words[k % n]) for k in trie.pairs]
    want = dict(zip(pairs, trie.pair_counts, strict=True)) | {(*pairs[k // n], trie.words[k % n]): c for k, c in zip(trie.triples, trie.triple_counts, strict=True)}
    assert counts == want and words == dict(zip(trie.words, trie.word_counts, strict=True))


def test_collocations_large_numbers(spark):
    """Products beyond 64 bits."""
    rows = [(10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 9), (10, 10, 10), (99_999_999_999_999,) * 3]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.quotient(F.col("a"), F.col("l"), F.col("r")).alias("q")).collect()
    assert [r.q for r in got] == [10**6 * r.a * r.a // (r.l * r.r) for r in got]
