"""Spelling variants, URL filters and importance resampling against brute force; nulls, empty tables, ties, long texts, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crcs, importance, url_filter, variants

from test_operators import EDGE, corpus, docs


def test_composed_crcs():
    rng = random.Random(1)
    a = [rng.randbytes(rng.randint(0, 50)) for _ in range(300)]
    b = [rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 127, 1000, 70_000])) for _ in a]
    got = crcs.joined(*(np.array([f(x) for x in v], t) for v, f, t in ((a, zlib.crc32, np.uint32), (b, zlib.crc32, np.uint32), (b, len, np.int64))))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
    assert list(itertools.chain(*crcs.parts(b"ab  c defg h" * 50, 7))) == (b"ab  c defg h" * 50).split()


# ---- 11 ----


def plain_variants(rows, every=31, shortest=7, least=2, ratio=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in by.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(by[w]), n[form[w]] if w in form else None))
    return out


def words_of_letters(rng):
    """Words around three stems, some of them many times as frequent as others, with double letters and letters beyond ASCII."""
    stems = ["banana", "aabbcc", "éàüstr"]
    word = lambda: "".join([rng.choice(stems)] + [rng.choice("ABabé") for _ in range(rng.randint(0, 4))])
    common = [word() for _ in range(6)]
    return [" ".join(rng.choice(common) if rng.random() < 0.7 else word() for _ in range(60)) + rng.choice([" 漢banana", "×÷ banana1banana", " Bananaa_", ""]) for _ in range(80)]


@pytest.mark.parametrize("every,shortest,ratio", [(31, 7, 10), (3, 5, 2), (2, 1, 3)])
def test_variants_equal_brute_force(spark, every, shortest, ratio):
    texts = [None, "", *words_of_letters(random.Random(3))]
    ids = [None, None, *range(len(texts) - 4), 5, 5]
    got = variants.spelling_variants(docs(spark, texts, ids=ids, n="clash", word="clash"), every, shortest, 2, ratio)
    want = plain_variants(zip(ids, texts, strict=True), every, shortest, 2, ratio)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40 and any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want) == (ratio < 10)
    with pytest.raises(ValueError):
        variants.spelling_variants(docs(spark, texts), ratio=1)


def test_variants_of_very_long_words(spark):
    long = "ab" * 30_000
    texts = [long] * 40 + [long + "x"] * 3 + [long[:-1] + "y"] * 3 + ["x " * 5000 + "bananas"] * 2
    got = {r["word"]: (r["form"], r["n"], r["n_near"]) for r in variants.spelling_variants(docs(spark, texts), 1 << 30).collect()}
    assert got == {long: (None, 40, 2), long + "x": (long, 3, 1), long[:-1] + "y": (long, 3, 1), "bananas": (None, 2, 0)}
    assert variants.spelling_variants(docs(spark, texts).limit(0)).count() == 0 and variants.spelling_variants(docs(spark, EDGE)).count() == 0


# ---- 12 ----


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme/x", "HTTP://A.Example.NET/en/x?q#z", "http://example.net", "x://net/a/b?c", "x://Net?/a", "x://badnet/a", "x://a.org/fr/#y", "x://a.org#/fr/", "x://example.com/de/?u=y://z", "x://u://v/w", "x:///p"]
    host, path = url_filter.url_parts(F.col("url"))
    rule, verdict = url_filter.rule_of(F.col("h"), F.col("p"))
    d = spark.createDataFrame(list(enumerate(urls)), "i long, url string").select("i", host.alias("h"), path.alias("p")).select("i", "h", "p", rule.alias("r"), verdict.alias("v")).orderBy("i")
    assert [tuple(r)[1:] for r in d.collect()] == [
        ("", "", None, None), ("", "", None, None), ("", "", None, None), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "", None, None), ("net", "/a/b", "net/", "block"), ("net", "", None, None),
        ("badnet", "/a", None, None), ("a.org", "/fr/", "org/fr/", "allow"), ("a.org", "", None, None), ("example.com", "/de/", "example.com/de/", "block"), ("u:", "//v/w", None, None), ("", "/p", None, None)]


def plain_lexical(url, host, path):
    n, last = len(url), path.split("/")[-1]
    bits = math.log2(n) - sum(k * math.log2(k) for k in Counter(url).values()) / n if n else 0
    some = lambda s, chars: sum(c in chars for c in s)
    out = [n // 4, some(path, "/"), int(some(url, "0123456789") * 63 / max(n, 1)), bits * 8, some(url, "&=?"), some(host, "."), len(host), some(host, "-")]
    return [min(63, x) for x in out], (host.split(".")[-1], ".".join(host.split(".")[-2:]), host, last.split(".")[-1] if "." in last else "/" if not last else "")


def test_lexical_features_equal_plain_ones(spark):
    rng = random.Random(8)
    urls = [None, "", "x://h", "x://a.b.c/d/e.html?x=1&y=2", "x://q/" + "z9" * 5000, *("http://" + "".join(rng.choice("ab1-.é漢😀/?&=\n") for _ in range(rng.randint(0, 60))) for _ in range(150))]
    host, path = url_filter.url_parts(F.col("url"))
    d = url_filter.lexical(spark.createDataFrame(list(enumerate(urls)), "i long, url string").select("i", "url", host.alias("h"), path.alias("p")), "url", "h", "p").orderBy("i")
    for url, r in zip(urls, d.collect(), strict=True):
        want, suffixes = plain_lexical(url or "", r["h"], r["p"])
        got = [r[f] for f in url_filter.FEATURES[:8]]
        assert got[:3] + got[4:] == want[:3] + want[4:] and abs(got[3] - want[3]) < 1 and tuple(r[s] for s in url_filter.SUFFIXES) == suffixes


def test_trees_learn_labelled_urls(spark):
    """Held-out URLs whose hosts were never seen: long hosts of digits and hyphens are blocked, whatever their suffix."""
    rng = random.Random(5)
    letters = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    good = lambda: f"https://{letters(6)}.{rng.choice(['com', 'org'])}/{letters(4)}/{letters(6)}.html"
    bad = lambda: f"http://{letters(5)}-{rng.randint(100, 9999)}-{letters(5)}.{rng.choice(['com', 'xyz'])}/?{letters(2)}={rng.randint(0, 99999)}&u={letters(9)}"
    labelled = spark.createDataFrame([((bad if k % 3 == 0 else good)(), int(k % 3 == 0)) for k in range(900)] + [(None, 1), ("x", None)], "url string, y int")
    new = [((bad if k % 2 else good)(), k % 2) for k in range(200)]
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, (u, _) in enumerate(new)] + [(None, None, None, None), (7, "", "", "")], "page_id long, url string, host string, tld string")
    got = url_filter.judge_urls(pages, (), labelled)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    rows = [r for r in got.collect() if r["page_id"] is not None and not (r["page_id"] == 7 and r["host"] == "")]
    assert got.count() == 202 and sum((r["verdict"] == "block") == bool(new[r["page_id"]][1]) for r in rows) >= 195 and all(r["rule"] is None for r in rows)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0 and {r["verdict"] for r in url_filter.judge_urls(pages, ()).collect()} == {"allow"}


def test_bounded_sample_of_labels(spark):
    d = spark.range(4000).select(F.concat(F.lit("x://"), "id").alias("url"))
    some = url_filter.bounded(d, 1000)
    assert 850 < some.count() < 1150 and url_filter.bounded(d, 4000).count() == 4000
    assert sorted(some.collect()) == sorted(url_filter.bounded(d.repartition(7), 1000).collect())


# ---- 13 ----


def plain_resampling(rows, target, share=5, least=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    def grams(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[a : a + k]).encode()) % 10_000 for k in (1, 2, 3) for a in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(grams(x))
    for x in target:
        t.update(grams(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        g = grams(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), w := sum(gain[b] for b in g), w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("share,least", [(5, 20), (60, 3), (100, 0)])
def test_resampling_equals_brute_force(spark, monkeypatch, share, least):
    texts = [*corpus(n=150), *EDGE, "W1 w1\u00e9 A_b-c 9", "one two", "é" * 30]
    ids = [None if k == 3 else k for k in range(len(texts) - 2)] + [1, 1]
    target = ["w1 w2 w3 the a", None, "", "漢字 é w7", "q q q"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    want = plain_resampling(list(zip(ids, texts, strict=True)), target, share, least)
    for block in (importance.BLOCK, 50):
        monkeypatch.setattr(importance, "BLOCK", block)
        monkeypatch.setattr(importance, "VOCABULARY", 1 << 20 if block > 50 else 10)
        monkeypatch.setattr(crcs, "PART", 64)
        got = importance.resample(docs(spark, texts, ids=ids, rank="clash", score="clash", bucket="clash"), bench, share, least).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any(r[4] for r in want)


def test_words_after_a_cut_know_those_before(monkeypatch):
    text = " ".join(f"w{k % 37}" for k in range(500))
    whole = list(importance.Grams().blocks([text, "x"]))
    monkeypatch.setattr(importance, "BLOCK", 40)
    monkeypatch.setattr(importance, "parts", lambda raw: crcs.parts(raw, 100))
    cut = list(importance.Grams().blocks([text, "x"]))
    count = lambda bs: Counter(zip(np.concatenate([b[0] for b in bs]).tolist(), np.concatenate([b[1] for b in bs]).tolist(), strict=True))
    assert len(cut) > 5 and count(cut) == count(whole) and sum(len(b[2]) for b in cut) == 501


def test_empty_tables_of_resampling(spark):
    d, none = docs(spark, corpus(n=5)), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(d, none).count() == d.count() and importance.resample(d.limit(0), none).count() == 0


# ---- earlier operators ----


@pytest.mark.parametrize("name,cuts", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library_for_other_tokenizers(name, cuts):
    import public_tokenizers
    import pyarrow as pa

    from tidemark.llm import token_files

    e = token_files.WordEncoder(public_tokenizers.path(name))
    texts = [None, "", " ", "Hello  World's end", "it's 12 a.m.\n\nand É è", "a" * 5000, "<|endoftext|> x", *(t for t in corpus() if t)]
    ids, sizes = e.encode(pa.array(texts), 7)
    want = [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert e.cuts == cuts and sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_quality_features_equal_plain_ones():
    """Each feature counted in the plainest way, over bytes, words and lines."""
    from tidemark.llm import quality

    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "*#$%&@^~<>{}[]\\_=+", "!?", "|/", ".,;:'\"()-", " \t\n\x0b\x0c\r", "\n"]
    texts = [None, "", "a", *EDGE, *corpus(), "A|B  !! 12\n\n= é漢\n\n", "same same Same", "\x00 \x7f\x80", "x y\u2003z"]
    for text, got in zip(texts, quality.features(texts), strict=True):
        raw = (text or "").encode()
        n, words, lines = len(raw), re.split(rb"[ \t\n\x0b\x0c\r]+", raw.strip(b" \t\n\x0b\x0c\r")), raw.split(b"\n")
        words = [w for w in words if w]
        if not n:
            assert not got.any()
            continue
        k = max(1, len(words))
        want = [math.log(1 + n), math.log(1 + len(words)), n / k, *(sum(b in kind.encode() for b in raw) / n for kind in kinds), sum(b >= 128 for b in raw) / n]
        want += [len(set(words)) / k, sum(a == b for a, b in itertools.pairwise(words)) / k, len(set(lines)) / len(lines)]
        want += [-sum(c / n * math.log2(c / n) for c in Counter(raw).values()), max((len(w) for w in words), default=0)]
        assert got == pytest.approx(want, abs=1e-8)


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    """Shards of 40 words: an item of 300 words hits as it does whole, wherever the window lies; shards follow the count of words."""
    from tidemark.llm import decontaminate

    rng = random.Random(3)
    long, short = [f"q{rng.randrange(60)}" for _ in range(300)], "z1 z2 z3"
    texts = [" ".join(long[a : a + 13]) for a in range(0, 288, 7)] + [" ".join(long[280:292]), "a z1 z2 z3 b", "z1 z2", None, " ".join(long)]
    items = spark.createDataFrame([("L", " ".join(long)), ("S", short), ("S", short), ("N", None)], "item_id string, text string")
    read = lambda: {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["spans"]], r["items"]) for r in decontaminate.contamination(docs(spark, texts), items).collect()}
    whole = read()
    n = len(texts)
    assert all(whole[k][2] == ["L"] for k in [*range(n - 5), n - 1]) and [whole[n - 5 + k][2] for k in range(4)] == [[], ["S"], [], []]
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 40)
    assert read() == whole and decontaminate.Automata(items).count == -(-(300 + 12 * 10 + 3) // 40)
