"""The ten operators against brute force, round trips and held-out labels; nulls, empty tables, ties, long texts, clashing names."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, media, near_duplicates, pieces, quality, queries, secret_scan, sharding, substring_dedup, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(40)] + ["the", "a", "é", "漢字", "x,", "Y."]


def docs(spark, texts, ids=None, source=lambda i: f"s{i % 3}", **extra):
    rows = [(ids[i] if ids else i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, DOCS)
    for c, v in extra.items():
        d = d.withColumn(c, F.lit(v))
    return d


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    base, passage = say(300), say(50)
    out = [say(rng.randint(1, 120)) for _ in range(n)]
    for _ in range(6):  # near copies
        w = base.split()
        for k in rng.sample(range(len(w)), 6):
            w[k] = rng.choice(WORDS)
        out.append(" ".join(w))
    out += [base, base, say(20) + " " + passage + " " + say(9), passage + "\n" + say(5), None, "", " \n", "one", "q " * 90, say(3000)]
    return out


EDGE = [None, "", " ", "\n", "a", "é" * 3, "x" * 5000, "same text", "same text", "\u0000\u0001", "a b 😀"]
OPERATORS = {
    "shard": lambda d: sharding.assign_shards(d, 3),
    "secrets": secret_scan.scan_secrets,
    "redact": secret_scan.redact,
    "pieces": lambda d: pieces.round_trip(d, pieces.model_path()),
    "media": lambda d: media.media_features(media.texts_to_media(d)),
    "words": substring_dedup.repeated_words,
    "near": near_duplicates.near_duplicates,
    "keep": near_duplicates.keep_one,
    "hits": lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(1, "a b"), (None, "same"), (2, None)], "item_id long, text string")),
    "quality": lambda d: quality.score_quality(d, quality.fit_quality(d, d.selectExpr("doc_id", "if(doc_id > 4, 1, null) as quality"))),
    "matches": lambda d: substring_dedup.reference_matches(d, d),
    "tokens": lambda d: token_rows(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_and_empty_tables(spark, name):
    op = OPERATORS[name]
    d = docs(spark, EDGE, ids=[None, 1, 2, 2, 4, 5, 6, 7, 7, 9, 10], source=lambda i: None if i % 2 else "s", shard="old", n_words="clash", spans="clash", node="clash")
    n = op(d).count()
    assert n == (len(EDGE) if name != "keep" else n) and n > 0
    assert op(d.limit(0)).count() == 0


# ---- 1 ----


def test_pieces_equal_the_library(spark):
    import sentencepiece

    rng = random.Random(4)
    texts = [t for t in corpus() if t] + ["", " ", "  a  b ", "\n \n", "▁x ▁", "a" * 400, "漢字 é😀"] + ["".join(rng.choice("ab ehtino .,\n▁é漢😀 ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    m = pieces.PieceModel.of(pieces.model_path())
    for t in texts:
        ids = np.frombuffer(m.packed(t), "<u4").tolist()
        assert ids == sp.encode(t) and m.decode(m.packed(t)) == sp.decode(ids)
    got = pieces.decode_pieces(pieces.encode_pieces(docs(spark, texts), pieces.model_path()), pieces.model_path())
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


def test_unigram_paths_are_the_best(spark):
    m, rng = pieces.PieceModel.of(pieces.model_path(), pieces.UNIGRAM), random.Random(2)
    for _ in range(300):
        s = "".join(rng.choice("▁thean ing\noué漢😀") for _ in range(rng.randint(0, 14)))
        best = [0.0] + [None] * len(s)
        for e in range(1, len(s) + 1):
            for a in range(e):
                k = m.id.get(s[a:e])
                c = m.score[k] if k is not None else m.unknown_score if e - a == 1 else None
                if c is not None and best[a] is not None and (best[e] is None or best[a] + c > best[e]):
                    best[e] = best[a] + c
        assert sum(m.score[p] if p >= 0 else m.unknown_score for p in m.path(s)) == pytest.approx(best[-1])


# ---- 2 ----


def test_shards_follow_the_mixture(spark):
    d = docs(spark, ["t"] * 1000, source=lambda i: "hot" if i % 3 else f"s{i % 7}")
    got = sharding.assign_shards(d, 7).collect()
    size = Counter(r["shard"] for r in got)
    assert max(size.values()) - min(size.values()) <= 1
    for s in size:
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["source"] == "hot" for r in mine) / len(mine) - 666 / 1000) < 0.02
    again = sharding.assign_shards(d.repartition(7), 7).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


# ---- 3 ----


def hit_positions(text, items):
    return contaminated(text, items, True)


def contaminated(text, items, places=False):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for k, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        m = min(13, len(v))
        for a in range(len(v) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[a : a + m]:
                    hit.update(range(i, i + m))
                    found.add(str(k))
    return hit if places else (len(w), len(hit), sorted(found))


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, say(rng.choice([2, 5, 13, 14, 30]))) for k in range(12)] + [(12, None), (13, ""), (14, "Zed"), (3, say(15))]
    texts = [say(rng.randint(0, 60)) for _ in range(25)] + [items[4][1] + " x " + items[4][1], "zed, ZED", None, "", say(50) + "," + items[7][1].upper()]
    b = spark.createDataFrame(items, "item_id long, text string")
    for words in (decontaminate.MAX_WORDS, 60):  # one automaton, and several
        monkeypatch.setattr(decontaminate, "MAX_WORDS", words)
        assert (decontaminate.Automata(b).count > 1) == (words == 60)
        got = {r["doc_id"]: (r["n_words"], sum(s["e"] - s["s"] for s in r["spans"]), sorted(r["items"])) for r in decontaminate.contamination(docs(spark, texts), b).collect()}
        assert got == {i: contaminated(t, items) for i, t in enumerate(texts)}
    want = [i for i, t in enumerate(texts) if not ((c := contaminated(t, items))[1] and 20 * c[1] >= c[0])]
    for words in (decontaminate.MAX_WORDS, 250_000):
        monkeypatch.setattr(decontaminate, "MAX_WORDS", words)
        kept = decontaminate.decontaminate(docs(spark, texts, extra=1), b)
        assert sorted(r["doc_id"] for r in kept.collect()) == want and "extra" in kept.columns
        left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs(spark, texts), b, mode="cut").collect()}
        assert len(left) == len(texts) and all(left[i] == texts[i] for i in want)
        for i in set(range(len(texts))) - set(want):
            assert decontaminate.words_of(left[i]) == [w for k, w in enumerate(decontaminate.words_of(texts[i])) if k not in hit_positions(texts[i], items)]
    assert decontaminate.decontaminate(docs(spark, texts), b.limit(0)).count() == len(texts)
    assert decontaminate.cut("One, two three!", {1}) == "One,  three!"


# ---- 4 ----

PATTERNS = (("assign", secret_scan.ASSIGN, 2, 8), ("access", secret_scan.ACCESS, 0, 16), ("hex", r"[0-9a-f]+", 0, 32))


def test_base_secrets_equal_regular_expressions(spark):
    rng = random.Random(8)
    parts = ["password", 'TOKEN="', "= ", ":", "api_key", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef" * 2, "abcd1234", " ", "é😀", "\n", "secret=", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(200)] + EDGE
    got = secret_scan.scan_secrets(docs(spark, texts)).select("doc_id", secret_scan.joined(F.filter("secret_spans", lambda x: x["k"] < 3)).alias("s")).collect()
    for r in got:
        t, want = texts[r["doc_id"]] or "", []
        for k, (kind, p, g, n) in enumerate(PATTERNS):
            want += [(m.start(), k, m.end(), kind) for m in re.finditer(p, t, re.ASCII) if len(m[g]) >= n]
        assert r["s"] == ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(want))


def test_window_entropy_and_allow_list(spark):
    strings = ["aB3dE5fG7hJ9kL1mN2pQ4rS6", "aaaaaaaaaaaaaaaaaaaa1", "123e4567-e89b-12d3-a456-426614174000", "onlylettersareneverasecret", "ab12" * 8]
    d = spark.createDataFrame([(s,) for s in strings], "s string")
    entropy = lambda x: -sum(c / 20 * np.log2(c / 20) for c in Counter(x).values())
    for s, v in d.select("s", secret_scan.window_entropy(F.col("s"))).collect():
        assert v == pytest.approx(max(entropy(s[i : i + 20]) for i in range(len(s) - 19)), abs=1e-8)
    found = secret_scan.scan_secrets(docs(spark, strings)).select(F.transform("secret_spans", lambda x: x["kind"]).alias("k")).collect()
    assert [r["k"] for r in found] == [["entropy"], [], [], [], ["hex"]]
    masked = secret_scan.redact(docs(spark, ["x password=hunter2hunter2 y", None, "clean"])).orderBy("doc_id").collect()
    assert [r["text"] for r in masked] == ["x [SECRET] y", None, "clean"]


# ---- 5 ----


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_files, "BLOCK", 500)
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), corpus() + ["a  b", " \n x", "tail ", "<|endoftext|> x", "\n\n y"]
    ids = random.Random(1).sample(range(1000), len(texts))
    token_files.write_token_files(docs(spark, texts, ids=ids), path, f"file://{tmp_path}/f", work=f"file://{tmp_path}/w")
    # Read in another session, which has nothing but the files.
    got = {x["doc_id"]: x for x in token_files.read_token_files(spark.newSession(), f"file://{tmp_path}/f", with_ids=True).collect()}
    at, t = 0, token_files.WordEncoder.of(path).tokenizer
    for i, text in sorted(zip(ids, texts, strict=True)):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i]["ids"], got[i]["start"], got[i]["n_tokens"]) == (want, at, len(want))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_range_coder(spark):
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.05, 5000) - 1, 299)
    t = token_files.RangeTable(Counter(ids.tolist()), 300)
    assert int(t.freq.sum()) == 1 << t.bits
    for n in (0, 1, 7, 1024, 1025, 5000):
        block = t.encode(ids[:n])
        assert (t.decode(block) == ids[:n]).all()
    p = np.bincount(ids) / len(ids)
    p = p[p > 0]
    assert len(t.encode(ids, 64)) * 8 < len(ids) * -(p * np.log2(p)).sum() * 1.01 + 64 * 64 + 64
    data = t.encode(ids, 64, 640)
    for a, e in ((0, 5000), (0, 1), (639, 641), (640, 1280), (1281, 1300), (4999, 5000), (4990, 9000), (7, 7)):
        assert (t.decode(data, a, e) == ids[a:e]).all() and len(t.decode(data, a, e)) == len(ids[a:e])
    same = token_files.RangeTable.of(t.freq)
    assert (same.decode(data) == ids).all()
    damaged = bytearray(data)
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        t.decode(bytes(damaged))


def test_damaged_token_files_fail(spark, tmp_path):
    import public_tokenizers

    token_files.write_token_files(docs(spark, ["some words", "more of them"]), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/f")
    blocks = spark.read.parquet(f"file://{tmp_path}/f/blocks")
    for k, bad in enumerate((blocks.withColumn("data_crc32", F.col("data_crc32") + 1), blocks.withColumn("ids_crc32", F.col("ids_crc32") + 1))):
        bad.write.parquet(f"file://{tmp_path}/{k}/blocks")
        spark.read.parquet(f"file://{tmp_path}/f/table").write.parquet(f"file://{tmp_path}/{k}/table")
        with pytest.raises(Exception, match="checksum is wrong"):
            token_files.read_token_files(spark, f"file://{tmp_path}/{k}").collect()


def token_rows(d, id_col="doc_id"):
    import tempfile

    import public_tokenizers

    path = "file://" + tempfile.mkdtemp()
    token_files.write_token_files(d, public_tokenizers.path("byte_bpe_50k.json"), path + "/f", id_col)
    return token_files.read_token_files(d.sparkSession, path + "/f", id_col, with_ids=True)


def test_token_files_of_odd_ids_and_rows(spark):
    texts = ["x", None, "", "same", "same", "long " * 200_000, "y"]
    d = spark.createDataFrame([(i, t, "clash") for i, t in zip([None, None, "a", "b", "b", "", "Z"], texts, strict=True)], "name string, text string, ids string").withColumn("start", F.lit(1))
    got = sorted(token_rows(d, "name").collect(), key=lambda r: r["start"])
    assert [r["name"] for r in got] == [None, None, "", "Z", "a", "b", "b"]
    assert [r["n_tokens"] for r in got[2:]] == [len(got[2]["ids"]), 2, 1, 2, 2] and got[5]["ids"] == got[6]["ids"]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(7)]


# ---- 6 ----


def brute_links(texts):
    sets = {}
    for t in {t or "" for t in texts}:
        w = t.lower().split()
        sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    return links


@pytest.mark.parametrize("block", [400, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    texts = corpus(3, 20) + corpus(5, 20)
    links, ids = brute_links(texts), defaultdict(list)
    for i, t in enumerate(texts):
        ids[t or ""].append(i)
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs(spark, texts)).collect()}
    assert len(got) == len(texts) and sum(map(len, links.values())) > 20
    for t, mine in ids.items():
        seen, todo = {t}, [t]
        while todo:
            for u in links[todo.pop()] - seen:
                seen.add(u)
                todo.append(u)
        for i in mine:
            r = got[i]
            assert (r["class_id"], r["class_size"], r["n_links"], r["group_id"]) == (mine[0], len(mine), len(links[t]), min(ids[u][0] for u in seen))
    kept = {r["doc_id"] for r in near_duplicates.keep_one(docs(spark, texts)).collect()}
    assert kept == {r["group_id"] for r in got.values()}


def pair_without_a_band():
    """Two texts of 45 shingles, 40 in common (0.8), whose signatures share no band."""
    sign, rng = near_duplicates.MinHash(*near_duplicates.choose_bands()), random.Random(11)
    while True:
        w = [f"v{rng.randrange(10**6)}" for _ in range(49)]
        a, b = " ".join(w), " ".join(w[:44] + [f"u{rng.randrange(10**6)}" for _ in range(5)])
        x, y = set(near_duplicates.shingles(a).tolist()), set(near_duplicates.shingles(b).tolist())
        if len(x & y) >= 0.8 * len(x | y) and not any(p == q for p, q in zip(sign(near_duplicates.shingles(a)), sign(near_duplicates.shingles(b)), strict=True)):
            return a, b


@pytest.mark.parametrize("block,hashes", [(200, 500_000), (4, 500_000), (200, 150)])
def test_a_pair_without_a_common_band_is_linked_nowhere(spark, monkeypatch, block, hashes):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "HASHES_A_BLOCK", hashes)
    a, b = pair_without_a_band()
    alone = near_duplicates.near_duplicates(docs(spark, [a, b])).collect()
    assert [(r["n_links"], r["group_id"]) for r in sorted(alone)] == [(0, 0), (0, 1)]
    # Copies of both with one word more or less lie between them: the two are in one group, and still not a pair.
    texts = [a, b] + [f"{t} x{k}" for t in (a, b) for k in range(8)] + [" ".join(a.split()[:46])] * 2
    sign = near_duplicates.MinHash(*near_duplicates.choose_bands())
    sets, bands = [set(near_duplicates.shingles(t).tolist()) for t in texts], [sign(near_duplicates.shingles(t)) for t in texts]
    pair = lambda i, j: texts[i] != texts[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and any(x == y for x, y in zip(bands[i], bands[j], strict=True))
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == [len({texts[j] for j in range(len(texts)) if pair(i, j)}) for i in range(len(texts))]
    assert len({got[i]["group_id"] for i in range(10)}) == 1


def test_a_chain_of_copies_is_compared_by_buckets(spark, monkeypatch):
    """Each text shares most words with the next one only: one component, whose buckets hold few pairs."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 10)
    monkeypatch.setattr(near_duplicates, "HOT", 5)
    rng = random.Random(3)
    base = [f"c{rng.randint(0, 10**6)}" for _ in range(400)]
    texts = [" ".join(base[4 * k : 4 * k + 120]) for k in range(70)] + [" ".join(base[:120])] * 3 + [" ".join(base[:119] + [f"e{k}"]) for k in range(30)]
    links = brute_links(texts)
    ids = defaultdict(list)
    for i, t in enumerate(texts):
        ids[t].append(i)
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicates(docs(spark, texts)).collect()}
    want = {i: len(links[t]) for i, t in enumerate(texts)}
    assert {i: r["n_links"] for i, r in got.items()} == want and len({r["group_id"] for r in got.values()}) == 1 and max(want.values()) > 30


def test_groups_without_ids(spark):
    say = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    d = spark.createDataFrame([(None, say), (7, say + "end"), (None, say + "fin"), (3, "else")], "doc_id long, text string")
    got = {(r["doc_id"], r["class_id"]): (r["group_id"], r["n_links"]) for r in near_duplicates.near_duplicates(d).collect()}
    assert got == {(None, None): (7, 2), (7, 7): (7, 2), (3, 3): (3, 0)}
    assert sorted(str(r["doc_id"]) for r in near_duplicates.keep_one(d).collect()) == ["3", "7"]


def test_bands_reach_the_recall():
    b, r = near_duplicates.choose_bands()
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= near_duplicates.HASHES


# ---- 7 ----


def brute_repeats(texts, n):
    every = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in every for i in range(len(w) - n + 1))
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append(([x for k, x in enumerate(w) if k not in gone], len(w)))
    return out


@pytest.mark.parametrize("window", [35, 8])
def test_repeated_words_equal_brute_force(spark, window):
    rng = random.Random(9)
    texts = corpus(11, 30) + [" ".join(rng.choice("ab") for _ in range(k)) for k in (5, 34, 35, 36, 80, 80)] + ["p q r " * 40]
    got = {r["doc_id"]: r for r in substring_dedup.repeated_words(docs(spark, texts), window).collect()}
    for i, (kept, n) in enumerate(brute_repeats(texts, window)):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (n, n - len(kept), " ".join(kept))
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_reference_automata_equal_brute_force(spark):
    texts, n = corpus(12, 20), 35
    ref = [texts[-10], "z " * 40, None, " ".join((texts[-9] or "").split()[5:60])]
    windows = {tuple(w[i : i + n]) for t in ref for w in [(t or "").split()] for i in range(len(w) - n + 1)}
    for shard_words in (1_000_000, 60):
        got = defaultdict(set)
        out = substring_dedup.reference_matches(docs(spark, texts), spark.createDataFrame([(t,) for t in ref], "text string"), shard_words=shard_words)
        for r in out.collect():
            got[r["doc_id"]].update(k for s in r["spans"] for k in range(s["s"], s["e"]))
        for i, t in enumerate(texts):
            w = (t or "").split()
            assert got[i] == {k for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for k in range(a, a + n)}


# ---- 8 ----


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op8_quality_classifier"](spark, sf).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert len(got) > 500 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.97
    none = quality.fit_quality(d.limit(0), labels)
    assert set(none.score(quality.features([None, "", "x y"]))) == {0.5}
    one = quality.fit_quality(d, labels.filter("quality = 1"), max_rows=300)
    assert (one.score(quality.features([None, "x y"])) > 0.9).all()
    kept = quality.keep_quality(docs(spark, ["w " * 50, None]), none)
    assert kept.count() == 2 and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def plain_boosting(x, y, m):
    """The model of quality.AdditiveModel by loops over rows: cyclic trees of two cuts, then pairs with one cut of either feature."""
    n, k = x.shape
    f = [m.base] * n
    bins = lambda v, cuts: sum(c <= v for c in cuts)
    fine = [[bins(x[r, j], m.cuts[j]) for j in range(k)] for r in range(n)]
    tables = [[0.0] * (len(m.cuts[j]) + 1) for j in range(k)]

    def stats(rows):
        p = [1 / (1 + np.exp(-f[r])) for r in rows]
        return sum(y[r] - q for r, q in zip(rows, p, strict=True)), sum(q * (1 - q) for q in p), len(rows)

    worth = lambda g, h, _: g * g / (h + 1)
    for _ in range(quality.ROUNDS):
        for j in range(k):
            leaves = [(0, len(tables[j]))]
            for _ in range(2):
                best = (1e-9, None)
                for a, b in leaves:
                    for c in range(a + 1, b):
                        left, right = ([r for r in range(n) if lo <= fine[r][j] < hi] for lo, hi in ((a, c), (c, b)))
                        if min(len(left), len(right)) >= quality.LEAF:
                            gain = worth(*stats(left)) + worth(*stats(right)) - worth(*stats(left + right))
                            if gain > best[0] + 1e-12:
                                best = (gain, (a, b, c))
                if best[1] is None:
                    break
                a, b, c = best[1]
                leaves = sorted([x for x in leaves if x != (a, b)] + [(a, c), (c, b)])
            steps = []
            for a, b in leaves if len(leaves) > 1 else ():
                g, h, _ = stats([r for r in range(n) if a <= fine[r][j] < b])
                steps.append((a, b, quality.RATE * g / (h + 1)))
            for a, b, v in steps:
                for i in range(a, b):
                    tables[j][i] += v
                for r in range(n):
                    if a <= fine[r][j] < b:
                        f[r] += v
    coarse = [[bins(x[r, j], m.coarse[j]) for j in range(k)] for r in range(n)]

    def quarters(i, j):
        best = (1e-9, None)
        for a in range(1, len(m.coarse[i]) + 1):
            for b in range(1, len(m.coarse[j]) + 1):
                parts = [[r for r in range(n) if (coarse[r][i] < a) == u and (coarse[r][j] < b) == v] for u in (True, False) for v in (True, False)]
                if min(map(len, parts)) >= quality.LEAF:
                    gain = sum(worth(*stats(q)) for q in parts) - worth(*stats(range(n)))
                    if gain > best[0] + 1e-12:
                        best = (gain, parts)
        return best

    gains = sorted((-quarters(i, j)[0], i, j) for i in range(k) for j in range(i + 1, k) if quarters(i, j)[1])
    chosen = [(i, j) for _, i, j in gains[: quality.PAIRS]]
    for _ in range(quality.PAIR_ROUNDS):
        for i, j in chosen:
            found = quarters(i, j)[1]
            for rows, (g, h, _) in [(q, stats(q)) for q in found or ()]:
                for r in rows:
                    f[r] += quality.RATE * g / (h + 1)
    return tables, chosen, 1 / (1 + np.exp(-np.array(f)))


def test_fitted_tables_equal_plain_boosting(monkeypatch):
    for name, v in (("ROUNDS", 3), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 8), ("PAIR_BINS", 4), ("LEAF", 5)):
        monkeypatch.setattr(quality, name, v)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 3)), 2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0.1)).astype(float)
    m = quality.AdditiveModel(x, y)
    tables, pairs, score = plain_boosting(x, y, m)
    for got, want in zip(m.tables, tables, strict=True):
        assert got == pytest.approx(want, abs=1e-9)
    assert [(i, j) for i, j, _ in m.pairs] == pairs and len(pairs) == 2
    assert m.score(x) == pytest.approx(score, abs=1e-8)


# ---- 9 ----


def filtered(rows, kind):
    out, prior = [], [0] * len(rows[0])
    for row in rows:
        line = [kind]
        for x, v in enumerate(row):
            a, b, c = row[x - 1] if x else 0, prior[x], prior[x - 1] if x else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            paeth = a if pa <= pb and pa <= pc else b if pb <= pc else c
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out.append(line)
        prior = row
    return np.array(out, np.uint8)


def test_png(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (9, 24)).tolist()
    for kind in range(5):
        assert media.unfilter(filtered(rows, kind)).tolist() == rows
    mixed = np.vstack([filtered(rows, k)[i : i + 1] for i, k in enumerate([0, 1, 2, 3, 4, 2, 2, 1, 4])])
    assert media.unfilter(mixed).tolist() == rows
    data = media.encode_png(media.payload_of("héllo" * 300))
    for i in (3, 20, len(data) - 30):
        with pytest.raises((media.BadImage, zlib.error)):
            media.decode_png(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    d = media.media_features(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:-5])), (3, None)], "doc_id long, media binary"))
    assert [r["error"] is None for r in d.orderBy("doc_id").collect()] == [True, False, False]
    none = [media.SIGNATURE + media._chunk(b"IHDR", media.struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"")) + media._chunk(b"IEND", b"") for w, h in ((0, 5), (5, 0), (0, 0))]
    bomb = media.SIGNATURE + media._chunk(b"IHDR", media.struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(1 << 20))) + media._chunk(b"IEND", b"")
    d = media.media_features(spark.createDataFrame([(str(k), bytearray(x)) for k, x in enumerate([*none, bomb])], "name string, media binary"), keep=("name",))
    assert [(r["name"], r["error"], r["feature"]) for r in d.orderBy("name").collect()] == [("0", "no samples", None), ("1", "no samples", None), ("2", "no samples", None), ("3", "size", None)]


def test_cosine_hash_equals_a_plain_transform():
    """Bit k: the k-th of 8 x 8 cosine terms of a 32 x 32 grid of means is above the median of all but the first."""
    rng = np.random.default_rng(7)
    for h, w in ((24, 24), (1, 24), (200, 24), (33, 5), (32, 32), (64, 96)):
        img = rng.integers(0, 256, (h, w)).astype(np.uint8)
        cut = lambda n, i: min(i * n // 32, n - 1)
        span = lambda n, i: range(cut(n, i), max(cut(n, i) + 1, cut(n, i + 1) if i < 31 else n))
        grid = [[sum(int(img[y, x]) for y in span(h, i) for x in span(w, j)) / (len(span(h, i)) * len(span(w, j))) for j in range(32)] for i in range(32)]
        cos = [[np.cos(np.pi * k * (2 * i + 1) / 64) for i in range(32)] for k in range(8)]
        terms = [round(sum(grid[i][j] * cos[u][i] * cos[v][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
        bits = "".join("1" if t > np.median(terms[1:]) else "0" for t in terms)
        assert media.cosine_hash(img) == f"{int(bits, 2):016x}"


def test_media_query_columns(spark, tmp_path):
    texts = EDGE + ["b" * 576, "b" * 577]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op9_media_columns"](spark, f"file://{tmp_path}").collect():
        p = media.payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((texts[r["doc_id"]] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert [len(media.payload_of(t)) for t in (None, "b" * 576, "b" * 577)] == [576, 576, 1152]


# ---- 10 ----


def test_chat_links_order_and_faults(spark):
    call = lambda i, name, args: json.dumps({"tool_call_id": i, "name": name, "arguments": args})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", '{"tool_call_id": "c1", "content": 5}'), (1, 2, "assistant", call("c1", "search", {"query": "x", "limit": 2})),
        (1, 3, "assistant", call("c2", "search", {"limit": "no"})), (1, 4, "assistant", call("c3", "get_weather", {"city": "y", "zip": 1})), (1, 5, "tool", '{"tool_call_id":"c9"}'),
        (1, 6, "assistant", call("c1", "nope", {})), (1, 7, "tool", '{"tool_call_id":"c3"}'), (1, 8, "tool", '{"tool_call_id":"c3", "z": {"b": 1, "a": [2, 1]}}'),
        (2, 0, "assistant", '{"broken": '), (2, None, None, None), (None, 0, "user", 'quote " and \n'),
    ]
    d = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")))
    got = {(r["conv_id"], r["turn"]): r for r in d.collect()}
    assert [got[1, t]["pos"] for t in range(9)] == [1, 3, 2, 4, 5, 6, 7, 8, 9]
    assert {t: got[1, t]["link"] for t in range(9)} == {0: None, 1: "linked", 2: "linked", 3: "unanswered", 4: "linked", 5: "orphan", 6: "repeated", 7: "linked", 8: "repeated"}
    # A schema's fields are tested in their order, then what it doesn't have.
    assert {t: got[1, t]["fault"] for t in (2, 3, 4, 6)} == {2: None, 3: "type of limit", 4: "extra zip", 6: "unknown tool"}
    assert got[1, 8]["json"] == '{"content":{"tool_call_id":"c3","z":{"a":[2,1],"b":1}},"pos":9,"role":"tool"}'
    assert got[2, None]["json"] == '{"content":null,"pos":1,"role":null}' and got[2, 0]["kind"] == "message" and json.loads(got[None, 0]["json"])["content"] == 'quote " and \n'
    assert chat.format_chat(d.select("conv_id", "turn", F.lit("r").alias("role"), F.lit("t").alias("text")).limit(0)).count() == 0
    plan = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_chat_lists_of_calls_and_needs(spark):
    listed = json.dumps({"tool_calls": [{"id": "a", "function": {"name": "search", "arguments": '{"query": "x"}'}}, {"id": "b", "function": {"name": "calculator", "arguments": {"expression": 1}}}]})
    need = lambda i, *on: json.dumps({"tool_call_id": i, "name": "search", "arguments": {"query": i}, "depends_on": list(on) if len(on) != 1 else on[0]})
    rows = [
        (1, 0, "assistant", listed), (1, 1, "tool", '{"tool_call_id": "b"}'), (1, 2, "tool", '{"tool_call_id": "a"}'), (1, 3, "assistant", '{"tool_calls": [], "x": 1}'), (1, None, "tool", '{"tool_call_id":"a"}'),
        # d needs e, which needs f, whose result comes last; g has an unknown need; h and i need each other, j needs h.
        (2, 0, "assistant", need("d", "e")), (2, 1, "assistant", need("e", "f", "f")), (2, 2, "assistant", need("f")), (2, 3, "tool", '{"tool_call_id":"e"}'), (2, 4, "tool", '{"tool_call_id":"d"}'), (2, 5, "tool", '{"tool_call_id":"f"}'),
        (2, 6, "assistant", need("g", "zz")), (2, 7, "assistant", need("h", "i")), (2, 8, "assistant", need("i", "h")), (2, 9, "assistant", need("j", "h")), (2, 10, "user", "end"),
        (3, None, "tool", '{"tool_call_id":"n"}'), (3, None, "assistant", need("n")),
    ]
    d = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {k: sorted((r for r in d.collect() if r["conv_id"] == k), key=lambda r: r["pos"]) for k in (1, 2, 3)}
    assert [(r["kind"], r["call_id"], r["link"], r["fault"]) for r in got[1]] == [
        ("call", "a", "linked", None), ("call", "b", "linked", "type of expression"), ("result", "a", "linked", None), ("result", "b", "linked", None), ("result", "a", "repeated", None), ("message", None, None, None)]
    assert got[1][0]["json"] == '{"content":{"function":{"arguments":"{\\"query\\": \\"x\\"}","name":"search"},"id":"a"},"pos":1,"role":"assistant"}'
    at = {(r["kind"][0], r["call_id"]): r["pos"] for r in got[2]}
    assert at["c", "f"] < at["r", "f"] < at["c", "e"] < at["r", "e"] < at["c", "d"] < at["r", "d"]
    assert {r["call_id"] for r in got[2] if r["fault"] == "cycle"} == {"h", "i", "j"} and [r["call_id"] for r in got[2] if r["kind"] == "call"][-4:] == ["g", "h", "i", "j"]
    assert sorted(r["pos"] for r in got[2]) == list(range(1, 12)) and [r["kind"] for r in got[3]] == ["call", "result"]


def test_rounds_follow_the_longest_chain(spark):
    """A chain of five calls and a star of 3,000 around it, with a cycle of two and calls behind it: five rounds and one that settles none."""
    chain = [(1, f"c{k}", f"c{k + 1}") for k in range(5)]
    star = [(1, f"s{k}", "c5") for k in range(3000)]
    cycle = [(1, "x", "y"), (1, "y", "x"), (1, "z", "x"), (1, "me", "me"), (1, "v", "x"), (1, "v", "c5")]
    needs = spark.createDataFrame(chain + star + cycle, "key long, call_id string, need string").withColumn("key", F.col("key").cast("string"))
    names = sorted({c for _, a, b in chain + star + cycle for c in (a, b)})
    at = "struct<turn:bigint,tie:string,seq:int>"
    ids = spark.createDataFrame([("1", c, (k, "", 0), None) for k, c in enumerate(names)], f"key string, call_id string, first_call {at}, first_result {at}")
    got = {r["call_id"]: r for r in chat.dependency_places(ids, needs).collect()}
    assert chat.dependency_places.rounds == 6 and {c for c, r in got.items() if r["cyclic"]} == {"x", "y", "z", "me", "v"}
    spot = lambda c: (got[c]["place"], got[c]["depth"])
    assert len(got) == len(names) and all(spot(a) > spot(b) for _, a, b in chain + star)


def test_chat_edges(spark):
    """Rows alike in all columns, conversations without turns, very long texts: each row comes out once, at places without gaps."""
    call = '{"tool_call_id": "a", "name": "search", "arguments": {"query": "' + "q" * 300_000 + '"}}'
    rows = [(1, 0, "assistant", call)] * 3 + [(1, 1, "tool", '{"tool_call_id": "a"}')] * 2 + [(2, None, None, None)] * 4 + [(2, None, "user", "z" * 500_000), (None, None, None, ""), (3, 5, "user", "{" * 50_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("link", F.lit("clash"))
    got = chat.format_chat(d).collect()
    assert len(got) == len(rows) and all(sorted(r["pos"] for r in got if r["conv_id"] == c) == list(range(1, n + 1)) for c, n in ((1, 5), (2, 5), (3, 1), (None, 1)))
    assert Counter(r["link"] for r in got) == {"linked": 5, None: 7} and all(len(r["json"]) > 500_000 for r in got if r["text" if "text" in r else "json"].startswith('{"content":"zz'))


@pytest.mark.parametrize("name", ["chat_tool_calls", "op10_chat_formatting"])
def test_chat_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM read_parquet('{sf}/conversations.parquet')")
    want = con.execute(queries.ORACLES[name]).fetchall()
    got = queries.QUERIES[name](spark, sf)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 50
