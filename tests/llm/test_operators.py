"""Each operator against a brute-force version, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import byte_bpe, language_id, ngram_trie, packing, quality_classifier, quality_rules, scaled_sketch, simhash, suffix_dedup, token_files
from skyloom.llm.queries import tokenizer_file
from skyloom.llm.rans import Coder, block_head, crc32_joined, table_of

BASE = "the quick brown fox jumps over the lazy dog and then runs far away from here "
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, BASE * 3), (6, BASE * 3), (7, BASE + "été à la plage 日本 it's 1234!!\n\n" + BASE), (8, "a\nb\na\nb\n" + BASE), (9, "A B c " * 40), (9, "A B c " * 40),
    (10, " ".join(f"w{i}" for i in range(120))), (11, " ".join(f"w{i}" for i in range(120)) + " more"), (-3, "minus " + BASE), (12, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "lang", "q", i) for i, (k, t) in enumerate(ROWS)], "doc_id long, text string, q_words string, key string, n_words long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id > 1000")


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_counts(docs).collect()}
    for k, t in ROWS:
        w = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        cover = {i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"], r["word_chars"]) == (len(w), len(cover), len(lines) - len(set(lines)), 0, sum(map(len, w)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    kept = sum(r["kept"] for r in quality_rules.quality_counts(docs).collect())
    out = quality_rules.quality_filter(docs)
    assert out.columns == docs.columns and out.count() == kept
    assert {r["q_words"] for r in out.collect()} <= {"lang"}
    assert quality_rules.quality_counts(empty).count() == 0


def test_cascade_order():
    """The rule of most rejections a second first, then of what is left; of two that catch nothing more, the cheaper."""
    rejects = {frozenset("ab"): 10, frozenset("a"): 2, frozenset("c"): 5, frozenset(): 100}
    assert quality_rules.greedy_order(rejects, {"a": 1.0, "b": 0.5, "c": 1.0, "d": 2.0, "e": 1.0}) == ["b", "c", "a", "e", "d"]
    assert quality_rules.greedy_order({}, {"x": 1.0, "y": 0.5}) == ["y", "x"]


def brute_fingerprint(t):
    w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("hot", [simhash.HOT, 1])
def test_simhash(docs, empty, hot):
    got = simhash.near_duplicates(docs, hot=hot).collect()
    fp = {k: brute_fingerprint(t) for k, t in ROWS}
    assert len(got) == len(ROWS) and all(r["fp"] % (1 << 64) == fp[r["doc_id"]] for r in got)
    root = {k: k for k in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert all(r["component_id"] == root[r["doc_id"]] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        bits = rng.choice(64, 2, replace=False)
        assert any(not any(m >> int(b) & 1 for b in bits) for m in simhash.masks(2))
    base = int(rng.integers(1 << 62))
    members = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(20, 2)) for _ in range(400)], np.uint64))
    a, b = simhash.forest(members, 0, 2)
    assert len(a) <= len(members) - 1 and len(a) > 0


def test_scaled_sketch(docs, empty):
    rows = scaled_sketch.sketch_and_edits(docs, bytes_a_range=200).collect()
    order = sorted(ROWS, key=lambda r: -r[0])
    want = set()
    for i, (k, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        want.add((k, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    assert len(rows) == len(ROWS) and {(r["doc_id"], r["edited_sha256"]) for r in rows} == want
    same = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert same[5] == same[6] and all(0 <= r["near_edited"] <= 1 for r in rows)
    assert scaled_sketch.sketch_and_edits(empty).count() == 0
    s = docs.sparkSession.range(1)
    a, b = F.lit("a b c d e f g"), F.lit("c d e f g h i")
    assert s.select((scaled_sketch.merge(scaled_sketch.sketch(a, share=1), scaled_sketch.sketch(b, share=1), 1) == scaled_sketch.merge(scaled_sketch.sketch(b, share=1), scaled_sketch.sketch(a, share=1), 1)).alias("x")).first()["x"]


@pytest.mark.parametrize("share", [scaled_sketch.SHARE, 8])
def test_scaled_sketch_sees_short_texts(spark, share):
    """A short text that a longer one contains is found; with all hashes the likeness is exact."""

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rng = np.random.default_rng(9)
    words = [[f"w{x}" for x in rng.integers(0, 10**6, 60)] for _ in range(60)]
    pairs = [(i, " ".join(w[:10]), " ".join(w)) for i, w in enumerate(words)]
    s, t = F.col("s"), F.col("t")
    like = scaled_sketch.text_likeness(s, t, scaled_sketch.sketch(s, share=share), scaled_sketch.sketch(t, share=share), share)
    got = spark.createDataFrame(pairs, "i long, s string, t string").select(like.alias("x")).collect()
    assert all(r["x"] == 1 for r in got)
    rows = [(2 * i, s) for i, s, _ in pairs] + [(2 * i + 1, t) for i, _, t in pairs]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in scaled_sketch.sketch_and_edits(docs, bytes_a_range=500, share=share).collect():
        a, b = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % len(rows)]
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        exact = [len(shingles(a) & shingles(x)) / min(len(shingles(a)), len(shingles(x))) for x in (e, b)]
        if share == 1:
            assert np.allclose([r["near_edited"], r["near_next"]], exact)
        elif r["doc_id"] % 2:
            assert r["near_next"] == 1


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs, empty):
    folder, freq = token_files.write_tokens(docs, tokenizer_file("byte_bpe_50k.json"), 2)
    got = sorted(token_files.read_tokens(spark, folder, freq).collect(), key=lambda r: r["start"])
    rows = sorted(zip([k for k, _ in ROWS], library_ids([t or "" for _, t in ROWS]), strict=True), key=lambda r: r[0])
    at = 0
    for r, (k, ids) in zip(got, rows, strict=True):
        ids = ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    folder, freq = token_files.write_tokens(empty, tokenizer_file("byte_bpe_50k.json"), 2)
    assert len(freq)


def test_rans_round_trip_and_checksum():
    ids = np.random.default_rng(6).zipf(1.3, 9000).clip(max=499).astype(np.uint32)
    c = Coder(table_of(np.bincount(ids, minlength=500)))
    for n in (0, 1, 7, 63, 64, 9000):
        assert (c.decode(c.encode(ids[:n])) == ids[:n]).all()
    block = c.encode(ids, 8, 100)
    assert block_head(block)[:4] == (9000, 8, 100, 12)
    for k in range(12):  # each checkpoint opens a part of its own
        asked = []

        def read(at, size):
            asked.append(size)
            return block[at : at + size]

        assert (c.part(read, k) == ids[800 * k : 800 * (k + 1)]).all()
        assert sum(asked) < len(block) / 4
    with pytest.raises(ValueError):
        c.decode(block[:-4] + b"\0\1\2\3")
    rng = np.random.default_rng(7)
    for a, b in ((b"", b"xyz"), (rng.bytes(1000), rng.bytes(12345)), (b"a", b"")):
        assert crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files_have_checkpoints(spark, tmp_path):
    """A file of several blocks of several parts: every part decodes by itself, and documents across parts are whole again."""
    rng = np.random.default_rng(8)
    rows = [rng.zipf(1.4, n).clip(max=99).astype(np.uint32) for n in (5, 700, 1, 4000, 2500, 300, 9000, 1, 1)]
    keys = [None, -5, 0, 1, 2, 2, 3, 4, 5]
    every = np.concatenate(rows)
    freq = table_of(np.bincount(every, minlength=100))
    data = token_files.file_bytes(Coder(freq), 10, keys, rows, block_ids=3000, lanes=8, every=64)
    blocks = token_files.block_table(lambda at, size: data[at : at + size])
    assert len(blocks) == 6 and blocks["parts"].tolist() == [6, 6, 6, 6, 6, 3]
    token_files.write_whole(str(tmp_path), "table.freq", freq.astype("<u4").tobytes())
    token_files.write_whole(str(tmp_path), "x.tok", data)
    got = sorted(token_files.read_tokens(spark, str(tmp_path), freq).collect(), key=lambda r: r["start"])
    starts = 10 + np.cumsum([0, *map(len, rows[:-1])])
    assert [tuple(r) for r in got] == [(k, int(a), len(r), zlib.crc32(r.astype("<u4").tobytes())) for k, a, r in zip(keys, starts, rows, strict=True)]
    with pytest.raises(ValueError):
        bad = bytearray(data)
        bad[-9] ^= 255
        token_files.read_part(Coder(freq), lambda at, size: bytes(bad[at : at + size]), blocks[-1], 2)


def test_byte_bpe(docs, monkeypatch):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((k, hashlib.sha256(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in ROWS)
    for long in (byte_bpe.LONG, 600):
        monkeypatch.setattr(byte_bpe, "LONG", long)
        got = byte_bpe.encode_and_decode(docs, path, P.PATTERN).collect()
        assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    b = byte_bpe.ByteBpe.of(path, P.PATTERN)
    text = BASE * 5 + " " * 70 + "x" * 90 + "\n" * 60 + " a" * 50
    assert all(b.split(text, c, o) == b.pattern.findall(text) for c, o in ((100, 20), (64, 8), (30, 1)))


def test_packing(docs, empty):
    got = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), 0, length=64).toPandas()
    assert got["length"].sum() == sum(len(x) + 1 for x in library_ids([t or "" for _, t in ROWS]))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 64) + 2
    assert packing.pack(empty, tokenizer_file("byte_bpe_50k.json"), 0).count() == 0
    few = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), 0, length=64, group=4).toPandas()
    assert sorted(zip(few["doc_id"], few["piece"], few["ids_crc32"], strict=True)) == sorted(zip(got["doc_id"], got["piece"], got["ids_crc32"], strict=True))
    for _, g in few.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= 64
    assert few["sequence_id"].nunique() <= got["sequence_id"].nunique() + 1
    bins = packing.local_search([[0, 1], [2], [3]], np.array([5, 4, 6, 1]), 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3]


def test_local_search_goes_on_until_no_bin_has_a_change():
    sizes = np.random.default_rng(1).integers(600, 761, 2000)
    first = packing.best_fit(sizes)
    bins = packing.local_search(first, sizes)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and max(sizes[b].sum() for b in bins) <= 2048
    assert len(first) - len(bins) > 40
    sizes = np.random.default_rng(2).integers(30, 60, 120)
    bins = packing.local_search([[i] for i in range(120)], sizes, 100)
    fill = [int(sizes[b].sum()) for b in bins]
    if sum(100 - f for f in fill) >= 100:  # by brute force: no move or exchange raises the squares
        for d, give in enumerate(bins):
            for k, take in enumerate(bins):
                outs = [0, *sizes[take]]
                pairs = [sizes[a] + sizes[b] for x, a in enumerate(take) for b in take[x + 1 :]]
                two = [sizes[a] + sizes[b] for x, a in enumerate(give) for b in give[x + 1 :]]
                gains = [i - o for i in sizes[give] for o in outs + pairs] + [i - o for i in two for o in outs]
                assert d == k or not any(0 < g <= 100 - fill[k] and fill[k] + g > fill[d] for g in gains)


def test_suffix_dedup(docs, empty):
    seen, want = {}, []
    for k, t in sorted(ROWS, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], k)
    for k, t in ROWS:
        b = (t or "").encode()
        g = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < k:
                g[i : i + 50] = True
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        want.append((k, len(b), int(g.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    assert sorted(tuple(r) for r in suffix_dedup.removal_digests(docs).collect()) == sorted(want)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert suffix_dedup.removal_digests(empty).count() == 0


def test_interval_tree():
    text = b"banana$"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [next((k for k in range(9) if text[a : a + k + 1] != text[b : b + k + 1] or a + k >= 7 or b + k >= 7), 9) for a, b in zip(order, order[1:])]  # noqa: B905
    left = np.array([text[i - 1] if i else 256 for i in order])
    got = {text[order[a] : order[a] + n]: (b - a, m) for a, b, n, m, _ in suffix_dedup.intervals(np.array(lcp), left, 1)}
    assert got[b"ana"] == (2, True) and got[b"a"] == (3, True) and got[b"na"] == (2, False)


def test_ngram_trie(docs, empty):
    trie = ngram_trie.train(docs)
    got = ngram_trie.score(docs, trie).collect()
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in ROWS}
    tokens = [((t or "").encode().lower().split() + [b"\n"], k) for k, t in ROWS]
    train = [w for t, k in tokens if not out[k] for w in t]
    v = set(train)
    want = sorted((k, len(t), sum(w in v for w in t), round(sum(np.log10((train.count(w) + 1) / (len(train) + len(v) + 1)) for w in t), 6)) for t, k in tokens)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == len(train) and r["score"] < 0 for r in got)
    assert ngram_trie.score(empty, ngram_trie.train(empty)).count() == 0
    grams = [{tuple(x[i : i + n]) for t, k in tokens if not out[k] for x in [[b"\n", *t]] for i in range(len(x) - n + 1)} for n in (2, 3)]
    # every bigram and trigram of the training texts is in the trie, however rare; a text opens with the end token
    assert [int(s[-1]) for s in trie.starts[1:]] == [len(g) for g in grams]
    x = np.sort(np.random.default_rng(7).integers(0, 1 << 40, 500).astype(np.uint64))
    e = ngram_trie.EliasFano(ngram_trie.EliasFano.build("q", x), "q")
    assert (e.access(np.arange(500)) == x).all() and (x[e.find(x)] == x).all()


def test_language_id(spark, docs):
    rows = [(i, t, l, None) for i in range(60) for t, l in [(BASE + str(i), "en")]] + [(100 + i, "der schnelle braune fuchs springt über den faulen hund und läuft weg " * 2, "de", None) for i in range(60)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language_id.learn(learn, F.lit(True))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[5]["lang_pred"] == "en"
    both = spark.createDataFrame([(1, rows[0][1] * 10 + rows[-1][1] * 10)], "doc_id long, text string")
    r = language_id.predict(both, model).first()
    assert "en:" in r["langs"] and "de:" in r["langs"]
    assert language_id.predict(docs, language_id.learn(learn.where("doc_id < 0"), F.lit(True))).first()["lang_pred"] == "und"


def test_quality_classifier(spark, docs):
    rows = [(i, (BASE if i % 2 else "BUY NOW!! ### CLICK %%% ") * 3 + str(i)) for i in range(200)]
    learn = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality_classifier.learn(learn, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.predict(learn, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in range(0, 200, 5)]) > 0.9
    assert quality_classifier.predict(docs, model).count() == len(ROWS)
    out = quality_classifier.predict(docs, model, keep="all")
    assert out.columns == [*docs.columns, "quality_score"]
    assert quality_classifier.predict(docs, quality_classifier.learn(docs, labels.where("doc_id < 0"), F.lit(True))).first()["score"] == 1.0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), before.schema)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name


def brute_components(texts):
    """Smallest key of each group of links of five-word Jaccard similarity 0.8 or more."""
    sets = {}
    for k, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = regex.findall(r"[^\x20\x09-\x0D]+", w)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in sets}


@pytest.mark.parametrize("sf", [None, "/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_near_dedup_stage_finds_all_similar_pairs(spark, docs, sf):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = [f"v{i}" for i in rng.integers(0, 900, 200)]
    rows = [(k, t) for k, t in ROWS if k != 9]
    for k in range(100, 130):  # near copies: one to four words changed
        w = list(words)
        for i in rng.choice(200, rng.integers(1, 5), replace=False):
            w[i] = f"new{k}{i}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string") if sf is None else spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(texts)
    got = corpus_pipeline.without_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(k for k in want if want[k] == k)
    assert corpus_pipeline.without_near_copies(spark, docs.where("doc_id > 100000000"), sf).count() == 0
