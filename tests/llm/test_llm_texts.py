"""Near copies, quality, toxicity, pieces, counts and repeats against plain computations."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from sluice.llm import components, minhash, quality, sentencepieces, simhash, suffix_dedup, token_counts, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = "the of and to in that with from this have stone river light paper glass cloud green winter seven orange table window garden letter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n", "s"]) for _ in range(n))


def rich(rng, n):
    """Words of many kinds, as varied as those of a real text."""
    return " ".join("".join(rng.choice("ka lo mi ret sun vor del pa ti gra shi mo ne ulk".split()) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".", "s"]) for _ in range(n))


def odd_texts():
    return [None, "", " \n\t ", "one", "Two Words", "ÀB É 中文 😀", "x" * 5000, "a b " * 4000, " x ", "a\x00b \x1c c"]


# SimHash


def plain_fingerprint(text, shingle):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(bits, ids, most):
    label = list(range(len(bits)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if bin(bits[i] ^ bits[j]).count("1") <= most:
                label[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(bits))]


@pytest.mark.parametrize("shingle", [3, 5])
def test_fingerprints(shingle):
    rng = random.Random(4)
    for text in odd_texts() + [prose(rng, n) for n in (1, 2, 3, 4, 5, 6, 50, 300)]:
        assert simhash.fingerprint((text or "").encode(), shingle) == plain_fingerprint(text, shingle)


def test_groups(spark):
    rng = random.Random(6)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    texts = odd_texts() + base + [b + " extra" for b in base[:15]] + [b.upper() for b in base[:10]] + base[:5]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(20, base[3]), (20, base[3])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, root int").repartition(3)
    found = simhash.groups(df).select("id", simhash.hex_bits("fingerprint").alias("f"), "component_id").collect()
    bits = [plain_fingerprint(t, 3) for _, t in rows]
    want = [(i, f"{b:016x}", c) for (i, _), b, c in zip(rows, bits, plain_components(bits, [i for i, _ in rows], 3))]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(zip(*[iter(_labels(bits))])))
    whole = {r.doc_id for r in kept.collect()}
    assert {c for _, _, c in want if c is not None} <= whole | {None}


def _labels(bits):
    return plain_components(bits, list(range(len(bits))), 3)


def test_links_lose_nothing_at_any_distance(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 12, dtype=np.int64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for c in centres for _ in range(12)]
    bits = sorted(set(near))
    df = spark.createDataFrame([(b,) for b in bits], "bits long")
    for most in (1, 3, 7):
        edges = [tuple(r) for r in simhash.links(df, "bits", most).collect()]
        assert all(bin(a ^ b).count("1") <= most for a, b in edges)
        at = {b: i for i, b in enumerate(bits)}
        label = list(range(len(bits)))
        for _ in bits:
            for a, b in edges:
                label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
        assert label == plain_components(bits, list(range(len(bits))), most)


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local, tmp_path):
    from sluice.llm._shared import save

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (200, 200), (300, 301), (301, 300), (7, 3)]
    df = save(spark.createDataFrame(edges, "a long, b long"), "edges")
    found = {r.node: r.root for r in components.components(df, local).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {100: 90, 95: 90, 301: 300}
    assert components.components(save(spark.createDataFrame([], "a long, b long"), "edges"), local).count() == 0


def test_a_variant_that_very_many_share_is_split(spark):
    from sluice.llm._shared import save

    rng = np.random.default_rng(9)
    half = 0x1234567 << 32  # one segment is the same in all
    low = rng.choice(2**32, 50_000, replace=False).astype(np.int64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(32, rng.integers(1, 4), replace=False)) for x in low[:300]]
    bits = np.unique(np.concatenate([low, near])) | half
    df = save(spark.createDataFrame([(int(b),) for b in bits], "bits long"), "crowd")
    crowded = simhash._crowded(df, 2, 4096)
    assert crowded.count() == 32 and crowded.where("needed").count() == 1
    other = half ^ (1 << 40)  # and one bit apart in some
    bits = np.unique(np.concatenate([bits, low[:200] | other]))
    df = save(spark.createDataFrame([(int(b),) for b in bits], "bits long"), "crowd")
    found = {tuple(r) for r in simhash.links(df, "bits", 3).collect()}
    sought = bits.astype(np.uint64)
    pairs = [(int(b), int(x)) for b in (half | low[:300]) for x in bits[np.bitwise_count(sought ^ np.uint64(b)) <= 3] if x != b]
    label = {}

    def root(x):
        while x in label:
            x = label[x]
        return x

    for a, b in found:
        assert bin(a ^ b).count("1") <= 3
        if root(a) != root(b):
            label[root(a)] = root(b)
    assert len(pairs) >= 290 and all(root(a) == root(b) for a, b in pairs)


def test_keys_that_hold_many_rows_are_joined_apart(spark, monkeypatch):
    from sluice.llm import _shared

    left = _shared.save(spark.range(3000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"), "id"), "left")
    right = _shared.save(spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 14)], "k long, v long")), "right")
    want = {how: sorted(map(tuple, left.join(right, "k", how).collect()), key=repr) for how in ("inner", "left")}
    for rows in (_shared.BROADCAST_ROWS, 10):
        monkeypatch.setattr(_shared.is_small, "__defaults__", (rows, _shared.BROADCAST_BYTES))
        for how, rows_wanted in want.items():
            assert sorted(map(tuple, _shared.join_on(left, right, "k", how=how).collect()), key=repr) == rows_wanted


def test_what_is_broadcast_is_bounded_in_bytes_too(spark):
    from sluice.llm._shared import is_small

    wide = spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    assert is_small(wide, 100) and not is_small(wide, 99) and not is_small(wide, 100, 900_000)


def test_simhash_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(df).count() == 0 and simhash.keep_one(df).count() == 0


# Quality


def plain_repeats(words, window=8):
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(window)})


def test_repeated_words():
    rng = random.Random(9)
    for n in (0, 7, 8, 9, 40, 400):
        for pool in (1, 2, 3, 12):
            words = [rng.choice(WORDS[:pool]).encode() for _ in range(n)]
            assert quality.repeated_words(words) == plain_repeats(words)
    assert quality.repeated_words([b"w%d" % i for i in range(100)] * 2) == 200


def test_quality(spark):
    rng = random.Random(7)
    noise = "".join(chr(rng.randint(0x21, 0x7E)) for _ in range(9000))
    texts = odd_texts() + [prose(rng, 100), "line one here\nline one here\n\n\nx", "#a $b %c & | <d> *", "same words again and again here now " * 60, " ".join(noise[k : k + 9] for k in range(0, 9000, 9))]
    df = spark.createDataFrame([(i, t, 5, "x", "keep") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string, body string").repartition(2)
    out = quality.quality(df)
    assert out.columns[:3] == ["doc_id", "text", "body"]
    found = {r.doc_id: r for r in out.collect()}
    compressor = zstandard.ZstdCompressor(level=3)
    for i, t in enumerate(texts):
        t, r = t or "", found[i]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        again = plain_repeats(words)
        failed = len(words) < 20 or 100 * again > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, failed)
        raw = t.encode()
        assert raw == b"" or r.ratio == len(raw) / len(compressor.compress(raw))
        low, high = quality.band(len(raw))
        parts = [raw[k : k + 4096] for k in range(0, len(raw), 4096)] if len(raw) > 4096 else []
        bad = sum(len(p) for p in parts if not quality.band(len(p))[0] <= len(p) / len(compressor.compress(p)) <= quality.band(len(p))[1])
        assert r.kept == (not failed and low <= r.ratio <= high and bad <= 0.3 * len(raw))
    assert quality.quality(df.limit(0)).count() == 0


# Toxicity


def test_toxicity_learns_words_and_locates_them(spark):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(500):
        text, bad = prose(rng, rng.randint(20, 120)).replace("\n", ". "), i % 5 == 0
        if bad:
            at = rng.randint(0, len(text))
            text = f"{text[:at]} {rng.choice(['zorgan', 'vilekind', 'vilesome', 'blort'])} {text[at:]}"
        rows.append((i, text, 0.5, "x"))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(500, None, 0.1, "x"), (501, "", 0.1, "x"), (None, "blort here", 0.1, "x"), (502, "vileheart came", 0.1, "x")], "doc_id long, text string, score double, body string")
    labels = spark.createDataFrame([m for m in marks if m[0] % 4] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "body", "score", "offending"]
    found = {r.doc_id: r for r in out.collect()}
    held = [m for m in marks if m[0] % 4 == 0]
    right = [(found[i].score >= 0.5) == bool(y) for i, y in held]
    assert np.mean(right) > 0.97
    assert found[500].score == found[501].score == 0 and found[None].score > 0.5
    assert found[502].score > 10 * np.median([found[i].score for i, bad in marks if not bad])  # by its beginning
    for r in found.values():
        assert 0 <= r.score <= 1
    sentence = next(r.offending[0] for i, r in found.items() if i in (0, 20, 40, 60) and r.offending)
    assert sentence.score >= 0.5 and sentence.end > sentence.start
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.score(docs, one).collect())


def test_gradient_of_the_noisy_or_loss():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 30)).replace("\n", ". ") for _ in range(25)] + [""]
    bags = toxicity.Bags(texts, [i % 3 == 0 for i in range(25)] + [0])
    theta = np.random.default_rng(1).normal(size=len(bags.seen)) * 0.3
    loss, by_weight, by_bias = bags.loss(theta, -1.0)
    weight_of = dict(zip(bags.seen.tolist(), theta))
    plain = []
    for text, y in zip(texts, bags.y):  # from the definition
        none = 1.0
        for bag in toxicity.bags(text):
            none *= 1 - 1 / (1 + np.exp(1.0 - sum(weight_of[f] for w in bag for f in toxicity.features(w))))
        plain.append(-np.log(max(1 - none, 1e-9)) if y else -np.log(none))
    assert abs(loss - np.mean(plain)) < 1e-6
    for k in range(0, len(theta), 7):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert abs((bags.loss(theta + step, -1.0)[0] - bags.loss(theta - step, -1.0)[0]) / 2e-5 - by_weight[k]) < 1e-6
    assert abs((bags.loss(theta, -1.0 + 1e-5)[0] - bags.loss(theta, -1.0 - 1e-5)[0]) / 2e-5 - by_bias) < 1e-6
    mask = np.arange(26) % 2 == 0
    part, own = bags.part(mask), toxicity.Bags([t for t, m in zip(texts, mask) if m], bags.y[mask])
    assert abs(part.loss(theta, 0.3)[0] - own.loss(np.array([weight_of[f] for f in own.seen.tolist()]), 0.3)[0]) < 1e-9


def test_scores_are_the_noisy_or_of_sentences():
    rng = random.Random(8)
    weights = np.random.default_rng(2).normal(size=toxicity.FEATURES).astype(np.float32)
    scorer = toxicity.Scorer((weights, -2.0), 0.5)
    texts = [x or "" for x in odd_texts()] + [prose(rng, n) for n in (1, 5, 40, 300)] + ["...", "One. TWO two! Three\nfour", "İstanbul ΑΣ.Β end", "no stop " * 20_000]
    scores, spans = scorer.score(texts)
    for text, score, found in zip(texts, scores, spans):
        none, want = 1.0, []
        places = [m.span() for m in re.finditer(r"[^.!?\n]+", text) if re.search(r"[^\W\d_]", m.group())]
        for place, part in zip(places, [x for x in re.split(r"[.!?\n]", text.lower()) if re.search(r"[^\W\d_]", x)]):
            p = 1 / (1 + np.exp(2.0 - sum(float(weights[toxicity.features(w)].astype(np.float64).sum()) for w in set(re.findall(r"[^\W\d_]+", part)))))
            none *= 1 - p
            if p >= 0.5:
                want.append(place)
        assert abs(score - (1 - none)) < 1e-6
        assert [(x["start"], x["end"]) for x in found] == want


def test_training_is_bounded_and_the_same_for_any_order_of_rows(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + (" blort" if i % 2 else "")) for i in range(400)] + [(1, "another text"), (1, "another text"), (3, "x " * 50_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, 0)], "doc_id long, toxic int")
    models = []
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        models.append(toxicity.train(docs, labels.repartition(n), max_rows=100, max_bytes=40_000))
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1] == models[1][1] and models[0][0].any()
    turned = labels.where("doc_id != 5").select(F.col("doc_id").alias("of"), "toxic", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 60) - 1)).alias("turn"))
    chosen = toxicity._chosen(turned, 50)
    counts = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    assert all(25 < n <= 50 for n in counts.values())


def test_the_charge_is_chosen_without_the_rows_it_is_tried_on():
    rng = random.Random(5)
    texts = [prose(rng, 40) + (" blort" if i % 2 else "") for i in range(120)]
    weights, bias, charge = toxicity.fit(texts, [i % 2 for i in range(120)])
    assert charge in toxicity.CHARGES and weights[toxicity.features("blort")].sum() > 1
    assert toxicity.fit(texts[:2], [0, 1])[2] == toxicity.CHARGES[0]


# Pieces and counts


def texts_for_pieces():
    rng = random.Random(12)
    alphabet = " \n\tabcdeéßñ😀中▁.,!0123ABC\x00"
    odd = [x or "" for x in odd_texts()] + ["a" * 3000, "ab" * 700 + " " * 50 + "x", "<s> </s> <unk> <0x0A>", "▁▁a", "中文字符测试" * 40, "é" * 600]
    return odd + [prose(rng, 80) for _ in range(20)] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_pieces_and_counts(spark):
    import sentencepiece

    library, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), texts_for_pieces()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(-1, None, "x", 1, "y")], "doc_id long, text string, ids string, n_tokens int, body string").repartition(3)
    out = sentencepieces.encode(df, MODEL)
    assert out.columns == ["doc_id", "n_tokens", "body", "ids", "decoded"]
    found = {r.doc_id: r for r in out.collect()}
    counts = {r.doc_id: r for r in token_counts.token_counts(df, MODEL).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t)
        assert found[i].ids == want and counts[i].n_tokens == len(want) and counts[i].n_bytes == len(t.encode())
        assert found[i].decoded == t.replace("▁", " ") == library.decode(want)
    assert found[-1].ids == [] and found[-1].decoded == "" and counts[-1].n_tokens == counts[-1].n_bytes == 0
    assert sentencepieces.encode(df.limit(0), MODEL).count() == token_counts.token_counts(df.limit(0), MODEL).count() == 0


def long_words():
    rng = random.Random(30)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return {"letters": draw("abcdefghijklmnopqrstuvwxyz", 100_000), "one": "a" * 100_000, "period": "abcdefg" * 14_000, "hex": draw("0123456789abcdef", 30_000), "cjk": draw("日本語中文字的是不", 30_000), "bare": draw("ab\x01\x02😀", 20_000), "two": "ab" * 20_000 + draw("xyz", 5000)}


def test_long_words_go_the_same_way():
    import sentencepiece
    from sluice.llm import piece_model

    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_model.load(open(MODEL, "rb").read())
    matcher, texts = sentencepieces.Matcher(model), long_words()
    import pyarrow as pa

    ids, at = sentencepieces.encode_texts(pa.array(list(texts.values()), pa.large_string()), matcher)
    for name, a, b in zip(texts, at, at[1:]):
        want = library.encode(texts[name])
        assert ids[a:b].tolist() == want, name
        assert int(token_counts.count_pretokens(model.pretokens(texts[name]), model).sum()) == len(want)


def test_texts_on_their_own_are_encoded_as_among_others():
    import pyarrow as pa
    import sentencepiece
    from sluice.llm import piece_model

    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_model.load(open(MODEL, "rb").read())
    matcher = sentencepieces.Matcher(model)
    for text in ["", " ", "\n", "\t\t a\n\n b", "a  b", "x\x01y", " lead", "tail ", "\n\n", "▁", "a", "😀", "  two", "é\tß"]:
        ids, at = sentencepieces.encode_texts(pa.array([text], pa.large_string()), matcher)
        assert ids.tolist() == library.encode(text) and at.tolist() == [0, len(ids)]
        assert model.decode(ids, at).to_pylist() == [library.decode(ids.tolist())]


def test_windows_that_share_no_token_are_made_longer():
    from sluice.llm import piece_model

    asked = []

    def threes(words):  # tokens of three letters from the beginning, so windows agree only where they begin alike
        asked.append(max(map(len, words)))
        rows = [(n, len(w[k : k + 3]), k) for n, w in enumerate(words) for k in range(0, len(w), 3)]
        return tuple(np.array(x, np.int64) for x in zip(*rows))

    words = ["x" * 100, "y" * 5, "z" * 41, "w" * 16]
    got = [x.tolist() for x in piece_model.in_windows(words, threes, size=16, overlap=6)]
    assert got == [x.tolist() for x in threes(words)] and max(asked[:-1]) > 16


def test_borders_are_those_of_the_merges():
    from sluice.llm import piece_model

    model = piece_model.load(open(MODEL, "rb").read())
    rng = np.random.default_rng(6)
    ids = np.array(sorted(model.pieces))
    left, right = np.append(rng.choice(ids, 3000), model.pair_keys[::20] // model.size), np.append(rng.choice(ids, 3000), model.pair_keys[::20] % model.size)
    of, token, _ = model.merge([model.pieces[a] + model.pieces[b] for a, b in zip(left.tolist(), right.tolist())])
    many = np.bincount(of)
    first = np.cumsum(many) - many
    assert model.borders(left, right).tolist() == [n == 2 and token[s] == a and token[s + 1] == b for n, s, a, b in zip(many, first, left, right)]


# Repeats


def plain_repeats_of(texts, length=200):
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(int)))
        out.append((len(b), edges.reshape(-1, 2).tolist(), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def repeating_texts():
    rng = random.Random(13)
    passages = [prose(rng, n) for n in (20, 33, 60, 150)]
    texts = odd_texts() + ["y" * 199, "y" * 200, "z" * 201, "ab" * 101, "abc" * 90, prose(rng, 40)[:199], "é" * 150]
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 80)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), rng.choice(passages)[rng.randint(0, 30) :])
        texts.append(" ".join(parts))
    near = prose(rng, 200)
    texts += [near[:k] + "#" + near[k + 1 :] for k in range(50, 900, 37)]
    return texts + texts[-20:-10]


@pytest.mark.parametrize("hot, heavy", [(suffix_dedup.HOT, (5000, 64)), (1, (5000, 64)), (suffix_dedup.HOT, (2, 1))])
def test_repeats(spark, hot, heavy):
    texts = repeating_texts()
    ids = [i if i % 13 else None for i in range(len(texts))]
    df = spark.createDataFrame([(i, k, t, 1, "x", "y") for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, k long, text string, ua int, spans string, body string").repartition(5)
    out = suffix_dedup.repeats(df, hot=hot, heavy=heavy)
    assert out.columns == ["doc_id", "k", "ua", "body", "n_bytes", "spans", "kept"]
    found = {r.k: r for r in out.collect()}
    for k, (n, spans, kept) in enumerate(plain_repeats_of(texts)):
        assert (found[k].n_bytes, [[s.start, s.end] for s in found[k].spans], bytes(found[k].kept)) == (n, spans, kept)


def test_repeated_rows_are_each_others_repeats(spark):
    text = prose(random.Random(1), 100)
    df = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    assert sorted(bytes(r.kept) for r in suffix_dedup.repeats(df).collect()) == [b"", b"", b"short"]
    assert suffix_dedup.repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeats(df, length=50)


def test_whole_characters_stay_whole(spark):
    rng = random.Random(2)
    shared = "é" + "".join(rng.choice("abcdef ") for _ in range(300)) + "é"
    df = spark.createDataFrame([(1, "x" + shared + "ü"), (2, "y" + shared + "ö")], "doc_id long, text string")
    for r in suffix_dedup.repeats(df, whole_chars=True).collect():
        assert r.kept.decode() in ("xü", "yö")


def test_very_long_texts_are_cut_into_overlapping_parts():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghij") for _ in range(suffix_dedup.BLOCK + 5000)).encode()
    items = list(suffix_dedup._items([b"short", text], 200))
    assert [(d, k) for d, k, _ in items] == [(1, 0), (1, suffix_dedup.BLOCK)] and sum(len(x) - 199 for _, _, x in items) == len(text) - 199


def test_cover_takes_every_pair_of_residues_along():
    cover = set(suffix_dedup.COVER.tolist())
    for a in range(suffix_dedup.PERIOD):
        for b in range(suffix_dedup.PERIOD):
            d = int(suffix_dedup.SHIFT[a, b])
            assert {(a + d) % suffix_dedup.PERIOD, (b + d) % suffix_dedup.PERIOD} <= cover


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_suffixes_come_in_order(letters):
    rng = np.random.default_rng(letters)
    for n in (0, 1, 17, 400, 3000):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        data[n // 2 : n // 2 + n // 4] = data[: n // 4]
        data[n // 8 : n // 6] = 0
        starts = np.arange(max(0, n - 16))
        raw = data.tobytes()
        found = [x for own in suffix_dedup.suffix_buckets(data, starts, 100) for x in own.tolist()]
        assert found == sorted(starts.tolist(), key=lambda i: raw[i:])


def test_repeated_windows_need_the_ranks(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[:3000] = np.tile(data[:500], 6)  # long ties at many distances
    data[1700:1750] += 2
    starts = np.arange(3801)
    seen = [bytes(data[a : a + 200]) for a in starts]
    want = [seen.count(w) > 1 for w in seen]
    assert suffix_dedup.repeated_windows(data, starts, 200).tolist() == want
    monkeypatch.setattr(suffix_dedup, "cover_ranks", lambda words, n: np.zeros(n, np.int64))
    assert suffix_dedup.repeated_windows(data, starts, 200).tolist() != want


def test_nothing_is_removed_on_a_hash_alone(spark, monkeypatch):
    rng = random.Random(19)
    texts = [prose(rng, 90) for _ in range(20)]
    texts += texts[:3]
    plain = plain_repeats_of(texts)
    mixed = suffix_dedup._mix
    monkeypatch.setattr(suffix_dedup, "_mix", lambda x: mixed(x) % np.uint64(3))  # nearly everything collides
    data = [t.encode() for t in texts]
    cut = suffix_dedup._cut(200, np.zeros(0, np.int64))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(data)], names=["ua", "ub", "text"])
    settled = {}
    for out in cut([batch]):
        for r in out.to_pylist():
            if r["kind"] == suffix_dedup._SETTLED:
                settled.setdefault(r["ua"], []).append((r["first"], r["last"]))
    for doc, spans in settled.items():
        gone = plain[doc][1]
        assert all(any(a <= first and last + 200 <= b for a, b in gone) for first, last in spans)


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    base = [rich(rng, 120) for _ in range(60)]
    passage = rich(rng, 90)
    texts = base + base[:10] + [b + " " + passage for b in (rich(rng, 60) for _ in range(8))] + ["bad", "spam spam " * 200, None, ""]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == df.columns
        seen.append({r.doc_id: r for r in docs.collect()})
    good, single, clean, mixed = seen
    assert set(good) == set(range(78))
    assert set(single) == set(range(60)) | set(range(70, 78))
    assert set(clean) == set(single) and all(passage not in r.text for r in clean.values()) and all(clean[i].text == base[i] for i in range(60))
    assert all(r.n_chars == len(r.text) for r in clean.values()) and set(mixed) <= set(clean)
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r for r in out.collect()]
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in ids)
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in docs.collect())



def test_stages_take_odd_columns_and_empty_tables(spark):
    import corpus_pipeline

    rng = random.Random(22)
    rows = [(i if i else None, rich(rng, 60) if i % 9 else None, "en", None if i % 2 else "s", 3, True, [1], i, "x") for i in range(30)] + [(5, "word " * 50_000, "en", "s", 1, None, None, 1, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans array<int>, body int, `odd name.x` string")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "").cache()
            assert name == corpus_pipeline.STAGES[-1][0] or now.columns == docs.columns
        assert now.count() > 15 or given is not docs


def plain_shingles(text, n=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def changed(rng, text, n):
    """The text with n of its words replaced."""
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_pipeline_keeps_one_of_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(31)
    base = [rich(rng, rng.choice([25, 60, 150, 400])) for _ in range(60)]
    chain = [rich(rng, 200)]
    for _ in range(6):
        chain.append(changed(rng, chain[-1], 3))  # neighbours are near copies, the ends are not
    texts = odd_texts() + base + chain + base[:5] + [b.upper() for b in base[5:8]] + [rich(rng, n) for n in (1, 2, 4, 5, 6)]
    texts += [changed(rng, b, max(1, round(len(b.split()) * share))) for b in base for share in (0.01, 0.02, 0.03, 0.05)]
    texts += [base[9] + " " + rich(rng, n) for n in (5, 30, 40, 200)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i if i != 40 else None, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    rows += [rows[20], (rows[21][0], base[30], "en", "s", len(base[30]))]
    texts = [r[1] for r in rows]
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(rows)))
    far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                far += bin(plain_fingerprint(texts[i], 3) ^ plain_fingerprint(texts[j], 3)).count("1") > 3
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    assert far > 50  # pairs that a bound of three bits misses
    first = {}
    for r, row in zip(root, rows):
        first.setdefault(r, []).append(row)
    want = {min((r[0] for r in own if r[0] is not None), default=None) for own in first.values()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.near_copies(spark, df, "").collect()
    assert len(kept) == len(first) and {r.doc_id for r in kept} == want
    assert corpus_pipeline.near_copies(spark, df.limit(0), "").count() == 0


def test_crowded_bands_are_spread_without_losing_links(spark):
    rng = random.Random(31)
    texts = []
    for _ in range(2):  # groups whose members lie nearer to and farther from each other, and share bands
        centre = rich(rng, 90)
        texts += [changed(rng, centre, n) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6) for _ in range(4)]
    chain = [rich(rng, 120)]
    for _ in range(25):
        chain.append(changed(rng, chain[-1], 2))
    texts += chain + [None, "", "one", "one", texts[0]]
    sets = [plain_shingles(t) for t in texts]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = want[i], want[j]
                want = [y if r == x else r for r in want]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for crowd, rounds in ((6, 0), (6, 2)):
        found = {r.id: r.root for r in minhash.groups(df, crowd=crowd, rounds=rounds).collect()}
        pairs = {(want[i], found[i]) for i in range(len(texts))}
        assert len(found) == len(texts) and len(pairs) == len(set(want)) == len(set(found.values())), (crowd, rounds)


def test_spread_groups_are_bounded_and_connect_what_is_linked(spark):
    rng = np.random.default_rng(9)
    centre = [rng.choice(10_000, 60, replace=False) for _ in range(3)]
    sets = [np.unique(np.concatenate([rng.choice(c, 60 - k, replace=False), rng.integers(10_000, 20_000, k)])).astype(np.uint64) for c in centre for k in rng.integers(0, 14, 40)]
    rows = spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in enumerate(sets)], "set_hash long, shingles binary")
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    want = list(range(len(sets)))
    for a, b in near:
        x, y = want[a], want[b]
        want = [min(x, y) if r in (x, y) else r for r in want]
    for crowd, rounds in ((16, 0), (16, 2)):
        edges, smaller = minhash.spread(rows.selectExpr("7L AS key", "set_hash"), rows, 0.8, crowd, rounds)
        edges = [(r.a, r.b) for part in edges for r in part.collect()]
        held = {}
        for n, part in enumerate(smaller):
            for r in part.collect():
                held.setdefault((n, r.key), []).append(r.set_hash)
        assert max(map(len, held.values()), default=0) <= 3 * crowd + 8
        edges += [(own[a], own[b]) for own in held.values() for a, b in minhash.walk([sets[x] for x in own], 0.8)]
        found = list(range(len(sets)))
        for a, b in edges:
            x, y = found[a], found[b]
            found = [min(x, y) if r in (x, y) else r for r in found]
        assert found == want and set(edges) | {(b, a) for a, b in edges} <= set(near) | {(b, a) for a, b in near}


def test_walk_links_what_brute_force_links():
    rng = np.random.default_rng(8)
    centre = [rng.choice(10_000, 60, replace=False) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(c, 60 - k, replace=False), rng.integers(10_000, 20_000, k)])).astype(np.uint64) for c in centre for k in rng.integers(0, 12, 15)]
    for similarity in (0.6, 0.8, 0.9):
        label, want = list(range(len(sets))), list(range(len(sets)))
        edges = minhash.walk(sets, similarity)
        assert len(edges) < len(sets)
        near = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= similarity * len(np.union1d(sets[i], sets[j])) - 1e-9]
        for found, pairs in ((label, edges), (want, near)):
            for a, b in pairs:
                x, y = found[a], found[b]
                found[:] = [min(x, y) if r in (x, y) else r for r in found]
        assert label == want


def test_held_out_fold_is_the_crc_of_the_id(spark):
    got = [r.f for r in spark.range(20).select((F.crc32(F.col("id").cast("string")) % 5).alias("f")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in range(20)]
