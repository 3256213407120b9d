"""Text operators against the libraries and brute force, with the awkward cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from floatweave.llm import decontaminate, golay, language_id, rans, secrets, simhash, toxicity
from floatweave.llm.bpe import WordBPE, bpe_decode, bpe_encode, bpe_round_trip, digests
from floatweave.llm.common import new_path
from floatweave.llm.components import connected_components
from floatweave.llm.pretokens import ByteLevelEncoder
from floatweave.llm.queries import queries, vocabulary
from floatweave.llm.token_counts import token_counts
from floatweave.llm.token_files import read_tokens, write_tokens

SF = "/root/testdata/sf0.001"
BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = ["", None, "word", "a" * 6000, "hi <|endoftext|> there<|startoftext|>", "日本語 テキスト", "x  y \n z ", " lead", "don't we're 'LL", "½² ǅ İΣ", "a b", "a\x1cb\x85c", "\t\n", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated row, and columns with clashing names."""
    rows = [(k if k != 3 else None, t, "n", 1.0, k) for k, t in enumerate(ODD)] + [(2, "word", "n", 1.0, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double, component_id long")


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("the standard tables are not here")
    return spark.read.parquet(f"{SF}/documents.parquet")


def noise(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab cdeé'sT\n\t12½,.!ß ñ\xa0İıΣ日<| ") for _ in range(rng.randrange(60))) for _ in range(n)]


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_encoders_equal_the_library():
    byte, word = ByteLevelEncoder(BYTE, "<u2"), WordBPE(WORD, max_entries=50)
    tb, tw = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    texts = [t for t in ODD if t] + noise(800)
    for k in range(0, len(texts), 7):
        byte.table.limit = 500 + k  # the table begins anew at times
        ids, n = byte.encode(texts[k : k + 7])
        for text, own in zip(texts[k : k + 7], np.split(ids, np.cumsum(n)[:-1])):
            assert own.tolist() == tb.encode(text, add_special_tokens=False).ids
    for text in texts:
        ids = word.encode(text).tolist()
        assert ids == tw.encode(text, add_special_tokens=False).ids
        assert word.decode(ids) == tw.decode(ids, skip_special_tokens=False)


def test_token_counts(spark, odd):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts(odd, BYTE, block_chars=40).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(library(BYTE, r.text))) for r in odd.collect())
    assert got == want
    assert token_counts(odd.limit(0), BYTE).count() == 0
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts(odd, vocabulary("piece_bpe_32k.model")).collect())
    assert got == sorted((len((r.text or "").encode()), len(piece.encode(r.text or ""))) for r in odd.collect())


def test_bpe_round_trip(spark, odd):
    tok = Tokenizer.from_file(WORD)
    made = bpe_round_trip(odd, WORD)
    for r in made.join(odd.select("doc_id", "text"), "doc_id").collect():
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == tok.decode(want, skip_special_tokens=False)
    assert made.count() == odd.count()
    one = digests(made).filter("doc_id = 13").first()
    ids = library(WORD, ODD[13])
    assert one.n_tokens == len(ids) and one.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    again = bpe_decode(bpe_encode(odd, WORD), WORD)
    assert sorted(r.decoded for r in again.collect()) == sorted(r.decoded for r in made.collect())
    assert bpe_round_trip(odd.limit(0), WORD).count() == 0


@pytest.mark.parametrize("n", [1, 255, 257, 70_000, rans.BLOCK, rans.BLOCK + 3])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
    table = rans.Table(rans.scale(np.bincount(ids, minlength=50_257)))
    blocks = rans.encode(ids, table)
    assert np.array_equal(np.concatenate(rans.decode(blocks, table)), ids)
    assert np.array_equal(np.concatenate([rans.decode([b], table)[0] for b in blocks]), ids)  # each block alone
    bad = bytearray(blocks[-1])
    bad[-1] ^= 1
    if n > 1:
        with pytest.raises(ValueError):
            rans.decode([bytes(bad)], table)


def test_rans_scale():
    for counts in ([1], [1] * 50_000, [10**12, 1, 0, 1], [0, 0]):
        f = rans.scale(np.array(counts))
        assert f.sum() in (0, 1 << rans.SCALE_BITS) and all((f > 0) == (np.array(counts) > 0))


def test_token_files(spark, odd):
    path = new_path(spark, "files")
    write_tokens(odd, path, BYTE, segment_tokens=200)
    got = read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i or 0))
    start, texts = 0, {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        want = [*library(BYTE, texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    path = new_path(spark, "files")
    write_tokens(odd.limit(0), path, BYTE)
    assert read_tokens(spark, path).count() == 0


# --- SimHash ------------------------------------------------------------------------------


def test_golay_keys_cover():
    rng = np.random.default_rng(0)
    for x in rng.integers(0, 1 << 23, 300):
        a, b = (1 << int(k) for k in rng.choice(23, 2, replace=False))
        k, n = golay.keys(np.array([x, x ^ a, x ^ a ^ b]))
        keys = [set(k[i, : n[i]].tolist()) for i in range(3)]
        assert k[0, 0] in keys[1] and k[1, 0] in keys[0] and keys[0] & keys[2]


def linked(values, limit=4):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= limit:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    found = {v: root(v) for v in values}
    sizes = list(found.values())
    return {v: r for v, r in found.items() if sizes.count(r) > 1}


@pytest.mark.parametrize("hot", [4096, 1])
def test_fingerprint_links(spark, hot):
    rng = np.random.default_rng(3)
    values = set()
    for base in rng.integers(-(2**63), 2**63 - 1, 40).tolist():
        for _ in range(5):
            v = base & (2**64 - 1)
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                v ^= 1 << int(bit)
            values.add(v - 2**64 if v >= 2**63 else v)
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    got = dict(map(tuple, connected_components(simhash.fingerprint_links(table, hot)).collect()))
    assert got == linked(sorted(values))


def test_fingerprints(spark, odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert r.fp & (2**64 - 1) == want
    by = {r.doc_id: r.component_id for r in rows}
    assert by[13] == by[14] == 13 and by[0] == by[1] == by[12] == 0  # copies; texts without words
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_components_of_paths(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(k, k + 1) for k in range(100, 110)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 111)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    rows, sets = [], {}
    for g, words in enumerate(base):
        for c in range(4):
            own = list(words)
            for _ in range((0, 0, 2, 9)[c]):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), "en"))
    rows += [(None, "x y z", "en"), (None, "x y z", "en"), (200, None, "en"), (201, "", "en")]
    got = sorted(((r.doc_id is not None, r.doc_id or 0) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()))
    texts = [(i, t) for i, t, _ in rows[:48]]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = sorted([(True, i) for i in sets if root(i) == i] + [(False, 0), (True, 200)])
    assert got == want


def shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def edited(rng, words, n):
    own = list(words)
    for k in rng.sample(range(len(own)), n):
        own[k] = f"v{rng.randrange(10**9)}"
    return own


def kept_of_each(spark, texts):
    return {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_one_of_each_star(spark):
    """A base and 100 variants of J 0.82 to 0.88 to it, many farther than 0.8 from each other: the base joins all that met it."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(50000)}" for _ in range(450)]
    texts = [" ".join(base)] + [" ".join(edited(rng, base, rng.randrange(6, 9))) for _ in range(100)]
    own = shingles(texts[0])
    assert all(len(own & s) / len(own | s) >= 0.82 for s in map(shingles, texts[1:]))
    assert len(kept_of_each(spark, texts)) <= 3  # at 0.82 few pairs share no key


def test_one_of_each_boilerplate(spark):
    """Documents of few words of their own and one line many times over are no copies."""
    rng = random.Random(12)
    texts = []
    for _ in range(10):
        line = " ".join(f"w{rng.randrange(50000)}" for _ in range(11))
        texts += [" ".join([*(f"w{rng.randrange(50000)}" for _ in range(60)), *[line] * 120]) for _ in range(4)]
    assert kept_of_each(spark, texts) == set(range(40))


def test_one_of_each_repeated_lines(spark):
    """How often a line is repeated hardly changes the set of shingles."""
    rng = random.Random(13)
    texts = []
    for _ in range(20):
        body, line = (" ".join(f"w{rng.randrange(50000)}" for _ in range(n)) for n in (400, 10))
        texts += [f"{body} {line}", body + f" {line}" * 60]
    assert kept_of_each(spark, texts) == set(range(0, 40, 2))


def test_one_of_each_far_prints(spark):
    """Pairs of J 0.8 and more whose prints differ in over 26 bits."""
    rng = random.Random(14)
    texts = []
    for _ in range(600):
        base = [f"w{rng.randrange(50000)}" for _ in range(450)]
        pair = [" ".join(base), " ".join(edited(rng, base, 10))]
        a, b = map(shingles, pair)
        if len(a & b) < 0.8 * len(a | b):
            continue
        far = 0
        for mix in (lambda h: h, simhash._mix):
            x, y = (simhash.fingerprint(mix(np.unique(simhash.hashes(t, 5)))) for t in pair)
            far += ((x ^ y) & (2**64 - 1)).bit_count()
        if far > 26:
            texts += pair
    assert len(texts) >= 10
    assert len(kept_of_each(spark, texts)) <= len(texts) // 2 + 3  # few share no key


def test_one_of_each_tiles_and_columns(spark):
    """Hot keys in tiles, columns whose names clash, equal rows, rows that differ in another column only."""
    rng = random.Random(15)
    base = [f"w{rng.randrange(50000)}" for _ in range(200)]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(60)] + [" ".join(f"w{rng.randrange(50000)}" for _ in range(200)) for _ in range(60)]
    rows = [(k, t, "en", 1, {"a": k}) for k, t in enumerate(texts)]
    rows += [rows[70]] * 3 + [(71, texts[71], "de", 1, {"a": 0}), (300, texts[72], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_k1 string, row_marked int, bitmap_word map<string,int>")
    for tile in (8192, 16):
        got = simhash.one_of_each(docs, tile=tile)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == [0, *range(60, 120)]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n_edits, least", [(11, 0.94), (9, 0.97), (6, 0.99)])
def test_one_of_each_recall(n_edits, least):
    """Of pairs of a Jaccard index just above 0.80 (0.83, 0.88): the share that shares a key within the limit."""
    rng = np.random.default_rng(n_edits)
    met = total = 0
    while total < 1000:
        words = rng.integers(0, 2**63, 496).astype(np.uint64)
        other = words.copy()
        other[rng.choice(496, n_edits, replace=False)] = rng.integers(0, 2**63, n_edits).astype(np.uint64)
        x, y = (simhash._mix(sum(w[k : 492 + k] * np.uint64(2 * 7919**k + 1) for k in range(5))) for w in (words, other))
        both = len(np.intersect1d(x, y))
        if both < 0.8 * (len(x) + len(y) - both):
            continue
        f = np.array([[simhash.fingerprint(h), simhash.fingerprint(simhash._mix(h))] for h in (x, y)], np.int64)
        rows, keys = simhash.wide_keys(f[:, 0].copy(), f[:, 1].copy())
        near = int(np.bitwise_count((f[0] ^ f[1]).view(np.uint64)).sum()) <= simhash.WIDE_LIMIT
        met += near and len(np.intersect1d(keys[rows == 0], keys[rows == 1])) > 0
        total += 1
    print("recall", n_edits, met / total)
    assert met / total >= least


# --- decontamination, toxicity, language, secrets ------------------------------------------


def brute_tiles(item, text, m):
    free_i, free_t, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (m - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and free_i[p + k] and free_t[t + k]:
                    k += 1
                if k > best[0]:
                    best = k, p, t
        if best[0] < m:
            return total
        k, p, t = best
        total += k
        free_i[p : p + k], free_t[t : t + k] = [False] * k, [False] * k


def test_tiling():
    rng = random.Random(0)
    for _ in range(120):
        item, text = ([rng.randrange(1, 4) for _ in range(rng.randrange(3, n))] for n in (30, 50))
        assert sum(t[2] for t in decontaminate.tile(item, text, 3)) == brute_tiles(item, text, 3)


def test_contamination(spark, odd):
    one = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    two = "eins zwei drei vier fünf sechs sieben acht neun zehn"
    bench = spark.createDataFrame([(1, one), (2, two), (3, "too short"), (4, None)], "item_id long, text string")
    moved = "zeta eta theta iota kappa lambda mu. Alpha, beta gamma DELTA epsilon"
    texts = [(0, f"start {one} end"), (1, f"x {moved} y"), (2, "alpha beta gamma delta epsilon"), (3, f"{two} and {one}"), (None, two), (5, None), (6, "too short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 3), r.n_tiles) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {(0, 1): (1.0, 1), (1, 1): (1.0, 2), (3, 1): (1.0, 1), (3, 2): (1.0, 1), (None, 2): (1.0, 1), (6, 3): (1.0, 1)}
    kept = decontaminate.without_leaks(docs, bench).collect()
    assert sorted(r.doc_id for r in kept) == [2, 5]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_contamination_by_brute_force(spark):
    """Every document with every item, without seeds, bitmaps or joins; repeated rows and clashing columns."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(12)}"
    items = [[word() for _ in range(rng.randrange(1, 16))] for _ in range(25)]
    texts = []
    for _ in range(60):
        own = [f"x{rng.randrange(900)}" for _ in range(rng.randrange(0, 20))]
        for item in rng.sample(items, 2):
            cut = rng.randrange(len(item) + 1)
            at = rng.randrange(len(own) + 1)
            own[at:at] = item[cut:] + item[:cut] * rng.choice([0, 1, 1])
        texts.append(own)
    texts.append(texts[0])
    docs = spark.createDataFrame([(k % 60, " ".join(t), 7, "a") for k, t in enumerate(texts)], "doc_id long, text string, row_k1 int, item string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    want = []
    for k, t in enumerate(texts):
        for i, item in enumerate(items):
            part = brute_tiles(item, t, min(5, len(item))) / len(item)
            if part >= 0.8:
                want.append((k % 60, i, round(part, 9)))
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 9)) for r in decontaminate.contamination(docs, bench).collect())
    assert got == sorted(want) and len({d for d, _, _ in want}) < 60
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(60)) - {d for d, _, _ in want})


def test_marginals():
    import itertools

    rng = np.random.default_rng(2)
    emit, trans, start, n = rng.normal(size=10), rng.normal(size=(2, 2)), 0.3, 5
    first = np.zeros(10, bool)
    first[[0, 5]] = True
    p = toxicity.marginals(emit, first, trans, start)[0]
    for o in (0, 5):
        total, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            s = np.exp(start * y[0] + sum(emit[o + i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            total, ones = total + s, ones + s * np.array(y)
        assert np.allclose(ones / total, p[o : o + n])


def test_long_chains_chain():
    rng = np.random.default_rng(4)
    emit, trans = rng.normal(size=1000) * 3, rng.normal(size=(2, 2))
    first = np.zeros(1000, bool)
    first[[0, 64, 300]] = True
    p = toxicity.marginals(emit, first, trans, 0.1)[0]
    for a, b in ((0, 64), (64, 300), (300, 1000)):
        head = np.zeros(b - a, bool)
        head[0] = True
        assert np.allclose(toxicity.marginals(emit[a:b], head, trans, 0.1)[0], p[a:b])


def test_toxicity(spark, odd):
    rng = random.Random(1)
    plain = [f"w{k}" for k in range(300)]
    texts, labels = [], []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        if k % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vileword", "vileness", "grotty"])
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(k, y) for k, y in enumerate(labels) if k % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [k for k in range(400) if k % 3 == 0]
    assert sum((got[k].score >= 0.7) == labels[k] for k in held) >= 0.97 * len(held)
    span = got[0].spans[0]
    assert texts[0][span.start : span.end] in ("vileword", "vileness", "grotty")
    scored = toxicity.toxicity(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() < 400
    none = toxicity.train(docs, table.limit(0))
    assert {r.score for r in toxicity.toxicity(odd, none).collect()} == {0.0}


def test_language(spark, odd):
    samples = {"en": ["the cat sat on the mat with the other cats"] * 3, "de": ["der hund und die katze sitzen auf der matte"] * 3}
    filters = language_id.fit(samples)
    assert language_id.predict(filters, ["the mat", "die katze", None, "", "12, 3!"])[0] == ["en", "de", "und", "und", "und"]
    rows = language_id.language_id(odd, filters).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.language_id(odd, empty).collect()} == {"und"}


def test_language_by_brute_force(spark):
    """Predictions against plain sets of n-grams, for more languages than one mask has bits."""
    rng = random.Random(8)
    langs = [f"l{k:03d}" for k in range(70)]
    letters = {lang: rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèêçñåø", 12) for lang in langs}
    make = lambda lang, n=30: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    samples = {lang: [make(lang) for _ in range(8)] for lang in langs}
    filters = language_id.fit(samples, slot_bits=22)
    grams = lambda t: [g for g in ((" " + t + "   ")[k : k + 4] for k in range(len(t) + 1))]
    count = {lang: {} for lang in langs}
    for lang in langs:
        for t in samples[lang]:
            for g in grams(t)[: len(t) - 1]:
                count[lang][g] = count[lang].get(g, 0) + 1
    total = {lang: sum(count[lang].values()) for lang in langs}
    best = {}
    for lang in langs:
        for g, n in count[lang].items():
            best[g] = max(best.get(g, 0), n / total[lang])
    keep = {lang: {g for g, n in count[lang].items() if n / total[lang] >= 0.35 * best[g]} for lang in langs}
    texts = [make(lang) for lang in langs] + ["12 3", None, ""]
    got, _ = language_id.predict(filters, texts)
    for t, found in zip(texts[:70], got):
        share = {lang: sum(g in keep[lang] for g in grams(t)[: len(t) - 1]) for lang in langs}
        assert share[found] >= max(share.values()) - 1
    assert got[70:] == ["und"] * 3
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in langs for t in samples[lang])], "doc_id long, text string, lang string")
    trained = language_id.train(docs)
    assert trained.languages == langs and len(trained.slots) == 2
    assert language_id.predict(trained, texts[:70])[0] == got[:70]


def test_language_held_out(spark, docs):
    found = queries()["op9_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(spark, odd):
    key = "Zx9Q2mK8vLp4Tn7RbW3cYd6HsJ1fGk5N"
    texts = [None, "", "é日 token: abcdefgh1 SECRET='zzzzzzzz' password=short secret=token:abcdefghij", "AKIA" + "A" * 11, "AKIAAKIA" + "B" * 9, "a" * 31 + " " + "b" * 32, "tokentoken=aaaaaaaaa", "ſecret=aaaaaaaaa", f"see {key} now", "thththththththththththththth1"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    every = F.array_sort(F.concat("base", "added"))
    rows = secrets.secret_spans(docs, keep=("text",)).select("doc_id", secrets.span_text(F.col("base")).alias("base"), secrets.span_text(F.col("added")).alias("added"), secrets.redact(F.col("text"), every).alias("clean")).collect()
    for r in rows:
        assert r.base == ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(texts[r.doc_id] or ""))
    by = {r.doc_id: r for r in rows}
    assert by[8].added == f"random:4:{4 + len(key)}" and by[8].clean == "see [SECRET] now"
    assert by[9].added == "" and by[0].clean is None and by[4].clean == "[SECRET]"
    assert secrets.secret_spans(odd).count() == odd.count() and secrets.secret_spans(odd.limit(0)).count() == 0


def test_secrets_upper_case_and_in_paths(spark):
    keys = ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "ETQV5ZIPBUYAMKXC2F0648J9RHSL71OW", "P34TICWG75HSB2R9KQAUFVDL1XOMNEY6", "Zx9Q2mK8vLp4Tn7RbW3cYd6HsJ1fGk5N"]
    texts = [f"see {k} now" for k in keys] + [f"see api_v1/{keys[3]} now", "DEADBEEFDEADBEEFDEADBEEF1 api_v1/thththththththththththth1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.added for r in secrets.secret_spans(docs).select("doc_id", secrets.span_text(F.col("added")).alias("added")).collect()}
    for k in range(4):
        assert got[k] == f"random:4:{4 + len(keys[k])}", k
    assert got[4] == f"random:8:{11 + len(keys[3])}" and got[5] == ""  # with the path's v1/, which fits base64


def test_secret_statistics(spark):
    """The battery's numbers against plain ones."""
    import math

    rng = random.Random(4)
    alphabets = secrets.ALPHABETS
    made = {e: ["".join(rng.choice(a) for _ in range(n)) for n in (12, 19, 40, 300)] for e, a in alphabets.items()}
    tokens = [t for own in made.values() for t in own] + ["thththththththththththththth1", "a" * 20, "12345678901234567890", "Ab" * 5 + "1" * 9]
    table = spark.createDataFrame([(t,) for t in tokens], "token string")
    seen = {}
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    for r in secrets._tests(table).collect():
        a = alphabets[r.encoding]
        x, n, k = [a.index(c) for c in r.token], len(r.token), len(a)
        chi = k * sum(r.token.count(c) ** 2 for c in a) / n - n
        assert r.z_uniform == pytest.approx((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)))
        n1, mean = sum(2 * v >= k for v in x), sum(x) / n
        runs = 1 + sum((2 * p >= k) != (2 * q >= k) for p, q in zip(x, x[1:]))
        spread = 2 * n1 * (n - n1) * (2 * n1 * (n - n1) - n) / (n * n * (n - 1))
        z_runs = (runs - 2 * n1 * (n - n1) / n - 1) / math.sqrt(spread) if spread > 0 else 99
        var = sum((v - mean) ** 2 for v in x)
        z_serial = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / var * math.sqrt(n) if var else 99
        assert (r.z_runs, r.z_serial) == pytest.approx((z_runs, z_serial))
        p = [max(1e-300, v) for v in (tail(r.z_uniform) if r.z_uniform > 0 else 1, 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial)))]
        half = -sum(map(math.log, p))
        assert r.p_random == pytest.approx(math.exp(-half) * (1 + half + half * half / 2), rel=0.1, abs=1e-4)
        ic, skew = (secrets.HEX_IC, secrets.HEX_SKEW) if k == 16 else (secrets.TEXT_IC, secrets.TEXT_SKEW)
        z = (chi - (k * ((n - 1) * ic + 1) - n)) / math.sqrt(2 * (k - 1) + 4 * n * k * k * skew)
        assert r.log_p == pytest.approx(-math.log10(tail(-z)) if z < 0 else 0.0, abs=0.01)
        seen[r.token] = r
    assert set(seen) == set(tokens) - {"12345678901234567890"}
    for e, own in made.items():
        assert all(seen[t].encoding == e for t in own[3:]), e
    assert seen[tokens[-4]].p_random < 1e-3 and seen["a" * 20].p_random < 1e-3
    assert all(seen[t].p_random > 1e-3 for own in made.values() for t in own)


def test_secret_thresholds(spark):
    """The limits of the false-discovery control against a plain step-up rule over the same bins."""
    rng = random.Random(9)
    words = ["".join(rng.choice("eeeettaaooiinnsshhrrdlucm") for _ in range(n)) for n in range(12, 40) for _ in range(30)]
    keys = ["".join(rng.choice(secrets.ALPHABETS["lower"]) for _ in range(n)) for n in (200, 300, 36, 14)]
    mixed = ["".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(n)) for n in (13, 18, 24, 40, 64)]
    table = spark.createDataFrame([(t,) for t in words + keys + mixed], "token string")
    rows = secrets._tests(table).collect()
    want = set()
    for family in {(r.encoding, min(12, int(r.n // 8))) for r in rows}:
        own = [(int(min(40, r.log_p) * 8), r.p_random >= 1e-3, r.token) for r in rows if (r.encoding, min(12, int(r.n // 8))) == family]
        bins = [b for b, _, _ in own if 10 ** (-b / 8) * len(own) <= 0.01 * sum(ok and c >= b for c, ok, _ in own)]
        want |= {t for b, ok, t in own if ok and bins and b >= min(bins)}
    got = {r.token for r in secrets.random_tokens(table).collect()}
    assert got == want and keys[0] in got and mixed[3] in got and not got & set(words)


def test_secrets_in_long_texts(spark):
    """A long token, a long text with many matches, and kept columns of any name."""
    rng = random.Random(6)
    image = "".join(rng.choice(secrets.ALPHABETS["base64"]) for _ in range(200_000))
    many = " ".join(f"key{k} {'%032x' % rng.getrandbits(128)}" for k in range(3000))
    docs = spark.createDataFrame([(1, f"x {image} y", "t"), (2, many, "u")], "doc_id long, text string, tokens string")
    got = {r.doc_id: r for r in secrets.secret_spans(docs, keep=("tokens",)).collect()}
    assert [(s.start, s.end) for s in got[1].base + got[1].added if s.end - s.start > 10**5] == [(2, 2 + len(image))] and got[1].tokens == "t"
    assert [(s.start, s.end, s.kind) for s in got[2].base] == [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]{32,}", many)]
    with pytest.raises(ValueError):
        secrets.secret_spans(docs.withColumn("base", F.lit(1)), keep=("base",))


def test_secret_query(spark, docs):
    found = {r.doc_id: r for r in queries()["op2_secrets"](spark, SF).collect()}
    for r in docs.collect():
        spans = base_spans(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert found[r.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert found[r.doc_id].n_hex == sum(s[3] == "hex" for s in spans)


def test_secret_plan_is_native(spark):
    plan = queries()["op2_secrets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
