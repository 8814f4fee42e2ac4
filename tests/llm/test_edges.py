"""Odd inputs, and values against plain versions: equal hashes, added tokens, null ids, very long texts, empty tables."""

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import byte_bpe, language_id, ngram_trie, packing, quality_classifier, quality_rules, queries, scaled_sketch, shingle_join, simhash, spans, suffix_dedup, token_files
from skyloom.llm.common import KeyRanges
from skyloom.llm.queries import tokenizer_file
from skyloom.llm.rans import Coder, table_of
from skyloom.llm.token_ids import PieceEncoder

from test_operators import BASE, brute_components, brute_fingerprint

FILE = "byte_bpe_50k.json"


def thue_morse(n):
    """Two words whose polynomial hashes modulo 2**64 are equal for every base."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def library(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(tokenizer_file(FILE)).encode_batch(texts, add_special_tokens=False)]


def text_ids(encoder, texts):
    return [np.frombuffer(x, encoder.wide).tolist() for x in encoder.batch(texts)]


def test_ids_are_the_librarys():
    texts = [*thue_morse(1024), *thue_morse(4096), "hello <|endoftext|> world", "<|endoftext|>", "a <|endoftext| > b", " x  y\t\tz\n\n", "é ß ſ × ÷", "日本 語", "it's we'll I'd", "\x1c\x1d a"]
    encoder = PieceEncoder(tokenizer_file(FILE))
    assert text_ids(encoder, texts) == library(texts)
    assert text_ids(encoder, texts[::-1]) == library(texts[::-1])  # all pieces are known now


@pytest.mark.parametrize("same_hash", [False, True])
def test_spans_are_told_apart_by_their_bytes(monkeypatch, same_hash):
    if same_hash:
        monkeypatch.setattr(spans, "stirred", lambda x: np.zeros_like(x))
    words = [*thue_morse(1024), "ab", "ab", "abcdefgh", "abcdefghi", "abcdefghj", thue_morse(1024)[0], "x" * 64, "x" * 65, "x" * 66, "x" * 65, "abcdefghj", "a\0", "a"]
    raw = "".join(words).encode()
    size = np.array([len(w) for w in words])
    first, group = spans.distinct_spans(raw, np.cumsum(size) - size, size)
    assert len(first) == len(set(words)) == len(set(zip(words, group.tolist(), strict=True)))
    assert [words[i] for i in first] == [words[group.tolist().index(g)] for g in range(len(first))]


def test_words_of_the_trie_are_told_apart():
    a, b = thue_morse(1024)
    names, at, many = ngram_trie.tokens_of([f"{a} {b} {a}", None, "  ", b.upper()])
    assert many.tolist() == [4, 1, 1, 2] and names[at[0]] == names[at[2]] != names[at[1]] == names[at[6]]
    assert names[at[0]] == xxhash.xxh64_intdigest(a) and (names[at[[3, 4, 5, 7]]] == ngram_trie.END).all()


def plain_scores(texts, trained, order=3):
    """Absolute discounting by plain counting, with the probabilities rounded as the trie stores them."""
    end, step = "\n", ngram_trie.STEP
    tokens = [[*regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), end] for t in texts]
    grams = [{} for _ in range(order + 1)]
    for t, use in zip(tokens, trained, strict=True):
        for n in range(1, order + 1):
            x = t if n == 1 else [end, *t]
            for i in range(len(x) - n + 1):
                g = tuple(x[i : i + n])
                grams[n][g] = grams[n].get(g, 0) + use
        grams[1].setdefault((end,), 0)
    grams = [{g: c for g, c in x.items() if c} for x in grams]
    whole = sum(grams[1].values()) + len(grams[1]) + 1
    code = lambda p: 10 ** ((min(255, max(0, round(255 + np.log10(max(p, 1e-12)) / step))) - 255) * step)
    first = lambda w: 10 ** (round(np.log10(grams[1].get((w,), 0) + 1) / ngram_trie.WORD_STEP) * ngram_trie.WORD_STEP) / whole
    cut = {}
    for n in range(2, order + 1):
        once, twice = sum(c == 1 for c in grams[n].values()), sum(c == 2 for c in grams[n].values())
        cut[n] = once / (once + 2 * twice) if once and twice else ngram_trie.DISCOUNT
    follow = [{} for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            follow[n].setdefault(g[:-1], []).append(c)

    def p(context, w):
        n = len(context) + 1
        if n == 1:
            return first(w)
        low = p(context[1:], w)
        seen = follow[n].get(context)
        if not seen:
            return low
        total = sum(seen)
        own = grams[n].get((*context, w), 0)
        left = 1 - sum((c - cut[n]) / total for c in seen)
        return low * code(left) + (code((own - cut[n]) / total) if own else 0)

    out = []
    for t in tokens:
        x, score = [end, *t], 0.0
        for i in range(1, len(x)):
            score += np.log10(p(tuple(x[max(0, i - order + 1) : i]), x[i]))
        out.append(score)
    return out


def test_trie_scores_are_those_of_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, "no id here"), (10**12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    want = dict(zip([k for k, _ in rows], plain_scores([t for _, t in rows], [0 if o else 1 for o in out]), strict=True))
    trie = ngram_trie.train(docs)
    got = ngram_trie.score(docs, trie).collect()
    assert len(got) == len(rows)
    held, base, model = 0, 0.0, 0.0
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 * max(1, r["n_tokens"])
        if r["held_out"]:
            held, base, model = held + r["n_tokens"], base + r["base_score"], model + r["score"]
    assert held and model > base  # better than single words on texts that it hasn't seen
    # many small shards hold the same n-grams
    small = ngram_trie.train(docs, mass=500)
    assert len(small.cuts[2]) > 10 and [int(s[-1]) for s in small.starts] == [int(s[-1]) for s in trie.starts]


def removal(rows):
    """The bytes that go, by all strings of 50 bytes; a null id is the smallest."""
    low = lambda k: -(1 << 63) if k is None else k
    seen, out = {}, []
    for k, t in sorted(rows, key=lambda r: low(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            seen.setdefault(b[i : i + 50], low(k))
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < low(k):
                gone[i : i + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((k, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_a_passage_in_many_contexts(spark, hot):
    """One passage with other words around it in each document, and a part of it inside others."""
    rng = np.random.default_rng(3)
    passage = "this very passage stands in a great many documents of the collection, word for word and letter for letter"
    word = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, rng.integers(0, 12)))
    rows = [(int(k), f"{word()} {passage[int(rng.integers(0, 30)) :]} {word()} {passage if k % 3 else ''} {word()}") for k in rng.permutation(60)] + [(None, passage), (None, "é" * 40), (7, "é" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.removal_digests(docs, hot=hot).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted((r[:5] for r in removal(rows)), key=key)


def test_maximal_repeats_by_brute_force(spark):
    """All strings that two places share and that can't be extended, with all their places."""
    from skyloom.llm import repeats

    rng = np.random.default_rng(5)
    passages = ["".join(rng.choice(list("abcdefgh "), n)) for n in (60, 90, 400)]
    rows = []
    for k in range(14):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            p = passages[int(rng.integers(3))]
            a = int(rng.integers(0, 8))
            parts += ["".join(rng.choice(list("xyz"), int(rng.integers(0, 9)))), p[a : len(p) - int(rng.integers(0, 8))]]
        rows.append((k, "".join(parts)))
    rows += [(20, rows[0][1]), (None, passages[0]), (21, None), (22, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    raw = [(k, (t or "").encode()) for k, t in rows]
    at = [(i, p) for i, (_, b) in enumerate(raw) for p in range(len(b) - 49)]
    heads = {}
    for i, p in at:
        heads.setdefault(raw[i][1][p : p + 50], []).append((i, p))
    found = set()
    for some in heads.values():
        for x, (i, p) in enumerate(some):
            for j, q in some[:x]:
                a, b = raw[i][1], raw[j][1]
                if p and q and a[p - 1] == b[q - 1]:
                    continue
                n = 50
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                    n += 1
                found.add(a[p : p + n])
    want = sorted((len(s), s, raw[i][0] if raw[i][0] is not None else -1, p) for s in found for i, p in heads[s[:50]] if raw[i][1][p : p + len(s)] == s)
    text = {k: b for k, b in raw}
    got = repeats.maximal_repeats(docs).collect()
    mine = sorted((r["length"], text[r["doc_id"]][r["start"] : r["start"] + r["length"]], -1 if r["doc_id"] is None else r["doc_id"], r["start"]) for r in got)
    assert len(found) > 10 and mine == want
    assert len({r["repeat"] for r in got}) == len(found)
    assert repeats.maximal_repeats(docs.where("doc_id > 100")).count() == 0


NULLS = [(None, BASE * 2), (None, "short"), (3, BASE * 2), (1, None), (1 << 60, BASE + "more of it"), ((1 << 60) + 1, "x y z " * 30)]


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(k, t, "en" if i % 2 else None, i) for i, (k, t) in enumerate(NULLS)], "doc_id long, text string, lang string, key int")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


def test_null_ids(spark, nulls):
    ids = [x + [2] for x in library([t or "" for _, t in NULLS])]
    folder, freq = token_files.write_tokens(nulls, tokenizer_file(FILE), 2, bytes_a_range=100)
    got = token_files.read_tokens(spark, folder, freq).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert ordered((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == ordered((k, len(x), crc(x)) for (k, _), x in zip(NULLS, ids, strict=True))
    assert {r["doc_id"] for r in sorted(got, key=lambda r: r["start"])[:2]} == {None}
    packed = packing.pack(nulls, tokenizer_file(FILE), 0).collect()
    assert ordered((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed) == ordered((k, len(x), crc([*x[:-1], 0])) for (k, _), x in zip(NULLS, ids, strict=True))
    fps = simhash.near_duplicates(nulls).collect()
    assert ordered((r["doc_id"], r["fp"] % (1 << 64)) for r in fps) == ordered((k, brute_fingerprint(t)) for k, t in NULLS)
    assert {r["component_id"] for r in fps if r["doc_id"] is None} == {3, None}
    kept = simhash.deduplicate(nulls)
    assert kept.columns == nulls.columns and {r["key"] for r in kept.collect()} >= {0, 1, 2, 3}
    assert {r["key"] for r in shingle_join.deduplicate(nulls).collect()} == {0, 1, 2, 3, 4, 5}
    sketches = scaled_sketch.sketch_and_edits(nulls, bytes_a_range=100).collect()
    assert len(sketches) == len(NULLS) and sum(r["doc_id"] is None for r in sketches) == 2
    for frame in (quality_rules.quality_counts(nulls), byte_bpe.encode_and_decode(nulls, tokenizer_file("byte_bpe_multi_50k.tiktoken"), __import__("public_tokenizers").PATTERN), language_id.predict(nulls, language_id.learn(nulls, F.lit(True)))):
        assert sum(r["doc_id"] is None for r in frame.collect()) == 2
    labels = spark.createDataFrame([(3, 1), (None, 0), (1, 0)], "doc_id long, quality int")
    assert quality_classifier.predict(nulls, quality_classifier.learn(nulls, labels, F.lit(True))).count() == len(NULLS)
    assert {r["key"] for r in suffix_dedup.remove_repeats(nulls).collect()} == set(range(len(NULLS)))


def brute_sketch(text):
    """Sorted hashes of five-word shingles: each word's XXH64 seeded with the hash of the words before."""
    words = regex.findall(r"[^ \t-\r]+", text)
    out = set()
    for i in range(max(1, len(words) - 4)) if words else ():
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def test_sketch_values(spark):
    rows = [(k, t) for k, t in NULLS if k is not None] + [(k, " ".join(f"w{(k * i) % 37}" for i in range(80))) for k in range(20, 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: -r[0])
    texts = {k: t or "" for k, t in rows}
    after = {k: texts[order[(i + 1) % len(order)][0]] for i, (k, _) in enumerate(order)}
    likeness = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / min(len(a), len(b))
    for r in scaled_sketch.sketch_and_edits(docs, bytes_a_range=300).collect():
        t, n = texts[r["doc_id"]], after[r["doc_id"]]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        hexes = lambda s: "".join(f"{h % (1 << 64):016X}" for h in sorted(s))
        a, b, c = map(brute_sketch, (t, e, n))
        assert r["fingerprint"] == hexes(a) and r["edited_fingerprint"] == hexes(b) and r["n_chars"] == len(t)
        assert np.isclose(r["near_edited"], likeness(a, b)) and np.isclose(r["near_next"], likeness(a, c))


def test_query_sketches_are_scaled(spark, tmp_path):
    """The query's fingerprints are the hashes below the bound and the smallest; short texts' likenesses are exact, long ones' near."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 500 if k % 3 else 3, n))) for k, n in enumerate([0, 3, 20, 60, 250, 1500, 3000, 700, 40, 2000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts, size = dict(rows), 1 << 64
    bound, estimated = size // scaled_sketch.QUERY_SHARE - (size >> 1), 0
    assert scaled_sketch.QUERY_SHARE > 1
    for r in queries.op8_document_fingerprints(spark, str(tmp_path)).collect():
        t, n = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % len(rows)]
        sets = [brute_sketch(x) for x in (t, t[: len(t) - len(t) // 2] + n[: len(t) // 2], n)]
        kept = [{h for h in s if h < bound} for s in sets]
        hexes = ["".join(f"{h % size:016X}" for h in sorted(k | {min(s)} if s else k)) for s, k in zip(sets, kept, strict=True)]
        assert [r["fingerprint"], r["edited_fingerprint"]] == hexes[:2]
        for i, got in ((1, r["near_edited"]), (2, r["near_next"])):
            exact = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / min(len(a), len(b))
            rough = min(len(kept[0]), len(kept[i])) >= scaled_sketch.ENOUGH
            assert np.isclose(got, exact(kept[0], kept[i]) if rough else exact(sets[0], sets[i])) and abs(got - exact(sets[0], sets[i])) < 0.25
            estimated += rough
    assert estimated


def test_key_ranges(spark):
    keys = [k * k for k in range(500)] + [7] * 300 + [None]
    docs = spark.createDataFrame([(k,) for k in keys], "k long")
    for count in (1, 2, 9, 60):
        ranges = KeyRanges(docs, "k", count)
        flat = ranges.flat()
        assert flat == sorted(set(flat)) and len(flat) == ranges.count - 1 <= count + 2 * count**0.5 + 1
        for r in docs.select("k", ranges.place(F.col("k")).alias("p")).collect():
            assert r["p"] == (0 if r["k"] is None else int(np.searchsorted(flat, r["k"])))
    assert KeyRanges(docs.where("k < 0"), "k", 10).count == 1


def test_languages_by_all_subsets():
    """The set of languages found one at a time is the best of all sets by penalised likelihood."""
    text = {"en": BASE, "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann weit weg von hier ", "fr": "le renard brun saute par dessus le chien paresseux puis court très loin de chez nous "}
    names = sorted(text)
    counts = np.stack([np.bincount(language_id.grams(text[n] * 5), minlength=language_id.BINS) for n in names]).astype(float)
    logp = np.log((counts + 0.02) / (counts.sum(axis=1, keepdims=True) + 0.02 * language_id.BINS))
    for mix in (text["en"] * 3, text["de"] * 4 + text["fr"] * 4, text["en"] * 6 + text["de"] * 3, "".join(text.values()) * 4, text["fr"] + text["en"][:20]):
        got = language_id.languages(mix, logp)
        bins, n = np.unique(language_id.grams(mix), return_counts=True)
        p = np.exp(logp[:, bins])

        def value(some):
            likelihood = float(np.log(p[some[0]]) @ n) if len(some) == 1 else language_id.mixture(p[list(some)], n, 300)[1]
            return likelihood - language_id.PENALTY * np.log(n.sum()) / 2 * (len(some) - 1)

        best = max((s for k in (1, 2, 3) for s in itertools.combinations(range(3), k)), key=value)
        assert {k for k, _ in got} == set(best) and np.isclose(sum(s for _, s in got), 1)
        if len(best) > 1:  # the shares are where the likelihood has no slope
            share = np.array([dict(got)[k] for k in best])
            slope = (p[list(best)] / (share @ p[list(best)])) @ n / n.sum()
            assert np.allclose(slope, 1, atol=0.03)


def test_network_by_loops_and_differences():
    rng = np.random.default_rng(4)
    z, y = rng.normal(size=(12, 5)), rng.integers(0, 2, 12).astype(float)
    p = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]

    def loss(q):
        total = 0.0
        for row, label in zip(z, y, strict=True):
            hidden = [np.tanh(sum(row[i] * q[0][i, j] for i in range(5)) + q[1][j]) for j in range(3)]
            out = 1 / (1 + np.exp(-(sum(hidden[j] * q[2][j] for j in range(3)) + q[3][0])))
            total -= np.log(out if label else 1 - out) / len(z)
        return total + 0.05 * ((q[0] ** 2).sum() + (q[2] ** 2).sum())

    for k, g in enumerate(quality_classifier.gradients(p, z, y, 0.1)):
        for at in np.ndindex(g.shape):
            ahead, behind = ([x.copy() for x in p] for _ in range(2))
            ahead[k][at] += 1e-5
            behind[k][at] -= 1e-5
            assert np.isclose(g[at], (loss(ahead) - loss(behind)) / 2e-5, atol=1e-6)
    model = quality_classifier.train(rng.normal(size=(40, 4)), (np.arange(40) % 2).astype(float), steps=20)
    words = {"words": rng.normal(size=(quality_classifier.WORDS, quality_classifier.WIDTH)).astype(np.float32), "shapes": rng.normal(size=(quality_classifier.SHAPES, quality_classifier.WIDTH)).astype(np.float32)}
    text = "Some words, some More words"
    u = quality_classifier.units(text)
    a, b = u // quality_classifier.SHAPES, u % quality_classifier.SHAPES
    x = quality_classifier.features(u, (words["words"], words["shapes"]))
    w = quality_classifier.WIDTH
    for j in range(w):
        assert np.isclose(x[j], sum(words["words"][i, j] for i in a) / len(a), atol=1e-5) and np.isclose(x[w + j], sum(words["shapes"][i, j] for i in b) / len(b), atol=1e-5)
    assert np.isclose(x[-3], np.log1p(5) / 8) and np.isclose(x[-1], len(set(a.tolist())) / 5) and model["t"] > 0


def test_held_out_accuracy(spark):
    """Language and quality of documents that weren't learned from."""
    from skyloom.llm import queries

    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op5_language_id(spark, sf).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(got) > 100 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.97
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["quality"] is not None}
    got = [r for r in queries.op9_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in marks]
    assert len(got) > 30 and np.mean([r["predicted"] == marks[r["doc_id"]] for r in got]) > 0.9


LONG = [(1, ("word%d " * 7 % tuple(range(7)) + BASE) * 4000), (2, "y" * 300_000), (3, BASE * 4000 + "é日" * 20_000), (4, " \n" * 100_000)]


def test_very_long_texts(spark):
    import public_tokenizers as P
    import tiktoken

    docs = spark.createDataFrame(LONG, "doc_id long, text string").repartition(2)
    texts = dict(LONG)
    assert min(map(len, texts.values())) > byte_bpe.LONG
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encode_and_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        t = texts[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(core.encode_ordinary(t), "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    ids = dict(zip(texts, library(list(texts.values())), strict=True))
    folder, freq = token_files.write_tokens(docs, tokenizer_file(FILE), 2)
    for r in token_files.read_tokens(spark, folder, freq).collect():
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids[r["doc_id"]]) + 1, zlib.crc32(np.array([*ids[r["doc_id"]], 2], "<u4").tobytes()))
    cut = packing.pack(docs, tokenizer_file(FILE), 0).toPandas()
    assert cut["length"].sum() == sum(len(x) + 1 for x in ids.values()) and (cut[cut["piece"] > 0]["length"] == 2048).all()
    for r in simhash.near_duplicates(docs).collect():
        assert r["fp"] % (1 << 64) == brute_fingerprint(texts[r["doc_id"]])
    words = {r["doc_id"]: r["n_words"] for r in quality_rules.quality_counts(docs).collect()}
    assert words == {k: len(t.split()) for k, t in LONG}
    for r in ngram_trie.score(docs, ngram_trie.train(docs)).collect():
        assert r["n_tokens"] == len(texts[r["doc_id"]].split()) + 1
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.learn(docs.withColumn("lang", F.lit("en")), F.lit(True))).collect()} == {1: "en", 2: "en", 3: "en", 4: "und"}
    for r in scaled_sketch.sketch_and_edits(docs).collect():
        assert r["n_chars"] == len(texts[r["doc_id"]])
    gone = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removal_digests(docs).collect()}
    assert gone[1] == gone[2] == gone[4] == 0 and gone[3] >= len(BASE) * 3000
    assert {r["doc_id"] for r in shingle_join.deduplicate(docs).collect()} <= set(texts)


@pytest.mark.parametrize("top", [0, 40, 3_000, 1 << 20, 1 << 62])
def test_elias_fano_by_plain_search(top):
    """Lookups of all values, their neighbours and others, with crowded buckets and long empty stretches, in any order."""
    rng = np.random.default_rng(top % 97)
    values = np.unique(np.concatenate([rng.integers(0, top + 1, 500, np.uint64), np.arange(300, dtype=np.uint64) + np.uint64(top // 3)]))
    made = ngram_trie.EliasFano(ngram_trie.EliasFano.build("x", values), "x")
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top + 99, 2_000, np.uint64)])
    for x in (asked, np.sort(asked)):
        at = np.minimum(np.searchsorted(values, x), len(values) - 1)
        assert (made.find(x) == np.where(values[at] == x, at, -1)).all()
    i = np.array([0, 1, 2, 7, 8, 3, 3, len(values) - 2])
    lo, hi = made.both_ends(i)
    assert (lo == values[i].astype(np.int64)).all() and (hi == values[i + 1].astype(np.int64)).all()


def test_ngrams_are_read_once_a_group(spark, monkeypatch):
    """However often n-grams occur in a group of texts, each is read once at its level; the scores are those of one text alone."""
    docs = spark.createDataFrame([(k, f"a b c a b d {BASE}") for k in range(20)], "doc_id long, text string")
    trie = ngram_trie.train(docs)
    read, weights, asked = ngram_trie.Trie.read, ngram_trie.Trie.weights, []
    monkeypatch.setattr(ngram_trie.Trie, "read", lambda self, level, name, number: asked.append(len(number)) or read(self, level, name, number))
    monkeypatch.setattr(ngram_trie.Trie, "weights", lambda self, level, context: asked.append(len(context)) or weights(self, level, context))
    ngram_trie.score_tokens(trie, *ngram_trie.tokens_of(["a b c a b c a b d"] * 300))
    assert max(asked) < 20
    texts = ["a b c a b c a b d"] * 30 + ["a b q a b"] * 20  # with a word that no training text has
    tokens, at = ngram_trie.tokens_of(texts), 0
    whole = ngram_trie.score_tokens(trie, *tokens)
    for t, n in zip(texts, tokens[2].tolist(), strict=True):
        for x, one in zip(whole, ngram_trie.score_tokens(trie, *ngram_trie.tokens_of([t])), strict=True):
            assert (x[at : at + n] == one).all()
        at += n


def test_pieces_cross_record_batches():
    """Texts of small record batches are scored together; no row is lost, and keys stay with their texts."""
    rows = [(None if k == 5 else k, None if k % 7 == 3 else f"{k} " * 40) for k in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a : a + 3]], pa.int64()), pa.array([r[1] for r in rows[a : a + 3]], pa.string())], names=["k", "t"]) for a in range(0, 50, 3)]
    for most, least_texts in ((1_000, 9), (1 << 30, 50)):
        pieces = list(ngram_trie._pieces(iter(batches), most))
        assert [(k, t) for keys, texts in pieces for k, t in zip(keys.to_pylist(), texts, strict=True)] == rows
        assert all(sum(len(t or "") for t in texts) >= most and len(texts) >= least_texts for _, texts in pieces[:-1])
    assert len(pieces) == 1 and not list(ngram_trie._pieces(iter([])))


def test_word_hashes_and_ranges_by_plain_search():
    """Hashes of spans of any size and place are the library's; entries fall into the ranges that a search of each names."""
    rng = np.random.default_rng(5)
    raw = rng.bytes(5_000)
    size = np.repeat(np.arange(90), 4)
    start = rng.integers(0, len(raw) - size + 1)
    start[-1] = len(raw) - size[-1]
    assert spans.xxh64_spans(raw, start, size).tolist() == [xxhash.xxh64_intdigest(raw[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    assert len(spans.xxh64_spans(b"", size[:0], size[:0])) == 0
    edges = np.array([0, 0, 4, 9, 9, 9, 20, 31, 31])  # empty ranges, too
    for numbers in (rng.integers(0, 31, 200), np.sort(rng.integers(0, 31, 200)), np.array([4, 9]), np.array([30]), np.zeros(0, np.int64)):
        got = np.full(len(numbers), -1)
        for k, at in ngram_trie.between(edges, numbers):
            got[at] = k
        assert (got == np.searchsorted(edges, numbers, side="right") - 1).all()


def test_prefix_batches_are_bounded(tmp_path):
    """A batch of many large sets gives prefix rows in batches of about ``SENT_ROWS``, the same rows in all, and frees the sets as it goes."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 2_000, np.uint64)) for _ in range(400)]
    sizes = np.array([len(x) for x in sets])
    at = np.cumsum(sizes) - sizes
    (tmp_path / "7-0.sets").write_bytes(np.concatenate(sets).tobytes())
    places = (np.int64(7) << shingle_join.PLACE) + at
    batch = pa.RecordBatch.from_arrays([pa.array(np.tile(places, 20)), pa.array(np.tile(sizes, 20).astype(np.int32)), pa.array(np.tile(places, 20))], names=["place", "n", "label"])
    often = SimpleNamespace(value=(np.sort(np.concatenate([x[:5] for x in sets])), np.ones(2_000, np.int32)))
    tracemalloc.start()
    rows = 0
    for out in shingle_join.prefixes(str(tmp_path), often, shingle_join.LEAST)([batch]):
        assert out.num_rows < shingle_join.SENT_ROWS + 2_000
        rows += out.num_rows
        assert set(out.column(1).to_pylist()) <= set(places.tolist())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 20 * sum(shingle_join.prefix_length(int(n)) for n in sizes)
    assert most < 48 << 20  # the whole sets would be 128 MB


def test_workers_drop_the_caches_of_other_operators():
    from skyloom.llm import token_ids
    from skyloom.llm.common import drop_caches

    quality_classifier.units("some words")
    encoder = PieceEncoder.of(tokenizer_file(FILE))
    drop_caches(but="pieces")
    assert not quality_classifier._seen and PieceEncoder.of(tokenizer_file(FILE)) is encoder
    quality_classifier.units("some words")
    drop_caches(but="classifier")
    assert quality_classifier._seen and not token_ids._made


def test_empty_tables(spark):
    import public_tokenizers as P

    sf = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < -5")
    assert byte_bpe.encode_and_decode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert language_id.predict(none, language_id.learn(none, F.lit(True))).count() == 0
    assert quality_classifier.predict(none, quality_classifier.learn(none, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))).count() == 0
    folder, freq = token_files.write_tokens(none, tokenizer_file(FILE), 2)
    assert token_files.read_tokens(spark, folder, freq).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == none.columns), name


def test_pipeline_by_brute_force(spark):
    """Stages two to five by plain versions, from what the classifier keeps (its network is tested above)."""
    import duckdb

    from skyloom.llm.queries import OP1_SQL

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.good_quality(spark, docs, sf).select("doc_id", "text").toPandas()
    assert 0 < len(good) < docs.count()
    con = duckdb.connect()
    con.register("documents", good)
    keep = {k for k, kept in con.execute(f"SELECT doc_id, kept FROM ({OP1_SQL})").fetchall() if kept}
    rows = [(int(k), t) for k, t in good.itertuples(index=False) if k in keep]
    root = brute_components(rows)
    rows = [(k, t) for k, t in rows if root[k] == k]
    rows = [(r[0], r[5]) for r in removal(rows)]
    want = set()
    for (k, _), x in zip(rows, library([t for _, t in rows]), strict=True):
        x, at = [*x, 0], 0
        for p, n in enumerate(packing.pieces(len(x))):
            want.add((k, p, at, n, zlib.crc32(np.array(x[at : at + n], "<u4").tobytes())))
            at += n
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(got) == len(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-int(got["length"].sum()) // 2048) + 1


class CountedLookups(dict):
    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)


@pytest.mark.parametrize("count", [1, 99, 100, 101, 1000])
def test_new_pieces_go_to_the_library_in_short_texts_and_are_looked_up_once(count):
    """Runs of letters over the bounds of such texts, contractions, digits, signs and letters of two bytes equal the library's ids."""
    rng = np.random.default_rng(count)
    letters = list("abcdefghijklmnopqrstuvwxyzéßŒſ")
    words = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(count)]
    texts = [" ".join(words), "\n".join(words[::-1]) + "it's they'll 'tis 'S d'été '' 2024 !? \t x  y'", words[0]]
    for line in (None, [1, 2]):  # a line feed of two ids: no texts of several pieces
        encoder = PieceEncoder(tokenizer_file(FILE))
        encoder.line = line or encoder.line
        encoder.known = CountedLookups()
        inner, sent = encoder.library, []

        class Library:
            def encode_batch_fast(self, texts, **options):
                sent.extend(texts)
                return inner.encode_batch_fast(texts, **options)  # noqa: B023

        encoder.library = Library()
        ids = text_ids(encoder, texts)
        assert ids == library(texts)
        assert encoder.known.asked == len(encoder.known)
        assert max(len(t.split("\n")) for t in sent) <= 101 and sum(len(t) for t in sent) <= sum(len(p.decode()) + 1 for p in encoder.known)
        assert text_ids(encoder, texts[::-1]) == ids[::-1]  # all pieces are known now


def test_parts_of_a_document_are_joined_as_they_come(spark, tmp_path):
    """Documents over several parts, also with null keys and over bounds of Arrow batches; a part that is missing is an error."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 50, n).astype(np.uint32) for n in (3000, 1, 2500, 700, 4000)]
    keys, at, rows, want = [None, 3, 4, None, -7], 0, [], []
    for k, x in zip(keys, ids, strict=True):
        cuts = np.unique([0, *range(1024 - at % 1024, len(x), 1024), len(x)]).tolist()
        rows += [{"key": k, "start": at, "length": len(x), "before": a, "here": b - a, "crc": zlib.crc32(x[a:b].tobytes())} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        want.append((k, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    for size in (1, 2, 3, 100):
        got = [tuple(r.values()) for b in token_files._joined(pa.RecordBatch.from_pylist(rows[i : i + size]) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert got == want
    for gone in (0, 1, len(rows) - 1):
        with pytest.raises(ValueError):
            list(token_files._joined(iter([pa.RecordBatch.from_pylist(rows[:gone] + rows[gone + 1 :])])))
    freq = table_of(np.bincount(np.concatenate(ids), minlength=50))
    token_files.write_whole(str(tmp_path), "x.tok", token_files.file_bytes(Coder(freq), 0, keys, ids, block_ids=3000, lanes=8, every=64))
    read = token_files.read_tokens(spark, str(tmp_path), freq)
    assert sorted(tuple(r) for r in read.select("start", "n_tokens", "ids_crc32").collect()) == sorted(w[1:] for w in want)
    assert {r["start"]: r["doc_id"] for r in read.collect()} == {w[1]: w[0] for w in want}
    assert "FlatMapGroupsInPandas" not in read._jdf.queryExecution().toString()  # no pandas frame for each document
