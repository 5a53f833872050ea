"""Top-k search, mixing, URL filter and token files against plain computations."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing, token_files, topk, url_filter


# Top-k


def plain_top(rows, k):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, v in ok:
        if q % 50 or (q, tuple(v)) in seen:
            continue
        seen.add((q, tuple(v)))
        held = lambda s: max(-(2**63), min(2**63 - 1, s))
        scored = sorted(((-held(sum(a * b for a, b in zip(v, w))), c) for c, w in ok if c != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, id int").repartition(3)


@pytest.mark.parametrize("bound", [topk.BROADCAST_BYTES, 1])
def test_top_k(spark, bound):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).round(2).tolist()) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 460)]  # ties
    rows += [rows[3], rows[50], (None, rows[1][1]), (500, None), (501, [None] * 24), (502, [float("nan")] * 24), (503, [float("inf")] * 24), (550, [1.0, 2.0]), (551, [1.0, -2.0]), (600, [])]
    found = topk.top_k(vectors(spark, [(*r, "x", 1) for r in rows]), F.col("id") % 50 == 0, broadcast_bytes=bound)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 5)


def exact_top(rows, k):
    """As ``plain_top``, for components of any size."""
    number = lambda x: int(x) * 256 if abs(x) > 1e300 else int(np.floor(256 * x))
    whole, out = [(i, [number(x) for x in v]) for i, v in rows], []
    for q, v in whole:
        if q % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), c) for c, w in whole if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


def test_top_k_of_large_components_and_nothing(spark):
    rows = [(0, [1e6, -2e6, 3e9]), (1, [2e6, 1e6, 1e9]), (2, [1e6, 1e6, -4e9]), (3, [1e15, 0.0, 1e15])]
    found = topk.top_k(vectors(spark, [(*r, "x", 1) for r in rows]), F.col("id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 5)
    assert topk.top_k(vectors(spark, []), F.col("id") % 50 == 0).count() == 0


def test_top_k_of_components_beyond_any_integer_type(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) * 10.0 ** (rng.integers(0, 307) if i % 3 else 0)).tolist()) for i in range(160)]
    rows += [(150 + i, [s * 1e307] * 20) for i, s in ((10, 1), (11, -1), (50, 1))] + [(170, [1.7e308, -1.7e308] * 10)]
    found = topk.top_k(vectors(spark, [(*r, "x", 1) for r in rows]), F.col("id") % 50 == 0)
    assert sorted(map(tuple, found.collect())) == exact_top(rows, 5)


@pytest.mark.parametrize("scale", [1.0, 1e200])
def test_pruning_loses_nothing_and_prunes_more_and_more(scale):
    rng = np.random.default_rng(8)
    n = 900 if scale == 1 else 200
    pool, queries = rng.normal(size=(n, 64)), rng.normal(size=(20, 64))
    pool[::3] *= 0.2
    best, ids = topk.Best(queries * scale, np.arange(20), 5), np.arange(100, 100 + n)
    left = []
    for k in range(0, n, 100):
        before = dict(best.survivors)
        best.add(pool[k : k + 100], ids[k : k + 100])
        left.append(sum(best.survivors.values()) - sum(before.values()))
    if scale == 1:
        for i in range(20):
            full = np.floor(pool * 256) @ np.floor(queries[i] * 256)
            order = np.lexsort((ids, -full))[:5]
            assert best.found[i].tolist() == ids[order].tolist() and best.scores[i].tolist() == full[order].tolist()
        total = [best.survivors[x] for x in sorted(best.survivors)]
        assert total == sorted(total, reverse=True) and total[2] < total[0] / 10  # fewer after each block of dimensions
        assert left[-1] < left[0] * 0.8  # and after each block of candidates
    else:
        assert (best.count == 5).all() and (np.abs(best.scores) == 2**63 - 1).any()


# Mixing


def plain_mix(rows, weights=(1, 2, 3), most=3):
    size = lambda t: len((t or "").encode().split())
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    n = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    w = {s: weights[k % 3] for k, s in enumerate(sources)}
    total, goal, open_ = sum(n.values()), dict.fromkeys(sources, 0.0), set(sources)
    left = float(total)
    while open_:  # share what is left, fix whoever is above its cap, share again
        base = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / base >= most * n[s]}
        if not over:
            for s in open_:
                goal[s] = left * w[s] / base
            break
        for s in over:
            goal[s] = float(most * n[s])
            left -= goal[s]
        open_ -= over
    return n, goal


DOCS = "doc_id long, text string, source string, size int, whole string, cut int, n_chars long"


def mixed_rows():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(x) for x in rng.integers(1, 5, int(rng.integers(0, 60)))), f"s{i % 5}" if i % 3 else "s0") for i in range(600)]
    return rows + [(600, None, "s1"), (601, "a b", None), (None, "x y z", None), (603, "", "empty"), (604, "one", "É"), (7, "again and again", "s2")]


def test_mix(spark):
    rows = mixed_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS).repartition(4)
    found = mixing.mix(df).collect()
    n, goal = plain_mix(rows)
    assert len(found) == len(rows)
    taken, largest = dict.fromkeys(n, 0), dict.fromkeys(n, 0)
    for r in found:
        assert r.source_size == n[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in n:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6
    again = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mix(df.repartition(2)).collect()}
    assert again == {(r.doc_id, r.source, r.size): r.taken for r in found}


def test_mix_of_many_sources_without_broadcasts(spark, monkeypatch):
    from sluice.llm import _shared

    monkeypatch.setattr(_shared.is_small, "__defaults__", (3, _shared.BROADCAST_BYTES))
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 40)), "hot" if i % 3 == 0 else f"s{rng.integers(0, 60):02}") for i in range(500)] + [(500, "a b c", None)]
    found = mixing.mix(spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS).repartition(4)).collect()
    n, goal = plain_mix(rows)
    taken = dict.fromkeys(n, 0)
    for r in found:
        assert r.source_size == n[r.source] and abs(r.target - goal[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert len(found) == len(rows) and all(abs(taken[s] - goal[s]) <= 20 + 1e-6 for s in n)


def test_applied_mix_repeats_rows(spark):
    rows = mixed_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS)
    want = {(r.doc_id, r.source, r.size): r.taken // max(1, r.size) for r in mixing.mix(df).collect() if r.taken}
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert sum(want.values()) == out.count()


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0 and mixing.apply_mix(df).count() == 0


def test_words():
    assert mixing.BITS == 60 and int(hashlib.md5(b"7").hexdigest()[:15], 16) < 2**60


# URLs


def test_rules(spark):
    urls = ["http://a.net/x", "http://example.net/en/1?q", "HTTP://WWW.EXAMPLE.NET/de/", "http://x.example.com/de/a#b", "http://example.com/en/", "http://b.org/fr/", "http://net", "nothing", None, "://É.NET/", "http://notexample.com/de/", "ftp://u@h.org:8/fr/x://y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("z"), "rule": F.lit(1)})
    found = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame([], "a long, b int")).collect()}
    assert [found[k].rule for k in range(len(urls))] == ["net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, "net/", None, None]
    assert [found[k].host for k in (1, 2, 7, 8, 9, 11)] == ["example.net", "www.example.net", "", "", "É.net", "u@h.org:8"]
    assert [found[k].path for k in (1, 3, 6)] == ["/en/1", "/de/a", ""]
    assert found[1].verdict == "allow" and found[0].verdict == "block" and found[4].verdict == "allow"


def test_reputation_blocks_bad_hosts_only(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else f'h{i % 9}'}.site{i % 2}.com/p") for i in range(800)]
    outcomes = [(i, 1 if i % 4 == 0 or i % 11 == 0 else 0) for i in range(0, 800, 2)] + [(None, 1), (4, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = url_filter.judge(pages, spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    assert len(found) == 800 and {r.verdict for r in found if r.host.startswith("bad")} == {"block"} and {r.verdict for r in found if r.host.startswith("h")} == {"allow"}


def test_hosts_are_joined_without_broadcasts(spark, monkeypatch):
    from sluice.llm import _shared

    rows = [(i, f"http://{'big' if i % 3 == 0 else f'h{i % 40}'}.site{i % 7}.{'com' if i % 2 else 'org'}/p") for i in range(400)]
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 400, 2)], "page_id long, bad int")
    want = sorted(map(tuple, url_filter.judge(pages, outcomes).collect()))
    monkeypatch.setattr(_shared.is_small, "__defaults__", (2, _shared.BROADCAST_BYTES))
    assert sorted(map(tuple, url_filter.judge(pages, outcomes).collect())) == want


# Token files


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    bits = [" ", "  ", "\n", "the", " of", "é", "<|endoftext|>", "'s", "12", "!", "\x1c", "中", "\u00a0"]
    rows = [(int(i), "".join(rng.choice(bits, rng.integers(0, 50)))) for i in rng.permutation(300)]
    rows += [(5, "twice"), (5, "twice"), (None, "no id"), (900, None), (901, ""), (902, "long text here " * 30_000), (903, "x" * 20_000)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, start int, ids string").repartition(5)
    path, file = str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_ids(df, path, file)
    found = token_files.with_crc32(token_files.read_ids(spark, path)).orderBy("start").collect()
    library, at = Tokenizer.from_file(file), 0
    want = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    groups = {}
    for i, ids in want:
        groups.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in found] == [i for i, _ in want]
    for r in found:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in groups[r.doc_id]
        groups[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert token_files.lookup(spark, path, [900, 77]).count() == 2


@pytest.mark.parametrize("most", [7, 0])
def test_starts_count_over_all_files_of_a_task(spark, tmp_path, most):
    rows = [(i, "word " * (i % 11)) for i in range(60)]
    path = str(tmp_path / "ids")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
    try:
        token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, public_tokenizers.path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    at = 0
    for r in token_files.read_ids(spark, path).orderBy("doc_id").collect():
        assert r.start == at
        at += r.n_tokens


def test_bloom_filters_are_in_the_files_and_lookups_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "ids")
    rows = spark.range(0, 8000, 2, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        token_files.write_ids(rows, path, public_tokenizers.path("byte_bpe_50k.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    jvm, files = spark._jvm, sorted(x for x in tmp_path.joinpath("ids").iterdir() if x.suffix == ".orc")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    blooms = 0
    for file in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        kinds = [s.getKind().toString() for s in reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()]
        blooms += any("BLOOM" in k for k in kinds)
    assert blooms == len(files) > 0
    found = token_files.lookup(spark, path, [4000])
    assert [r.doc_id for r in found.collect()] == [4000]
    plan = found._jdf.queryExecution().executedPlan()
    while not plan.metrics().contains("numFiles"):
        plan = plan.children().head()
    assert plan.metrics().apply("numOutputRows").value() <= 1000  # of 4000: one row group
    missing = token_files.lookup(spark, path, [4001])  # inside the range of ids, so only a Bloom filter can tell
    assert missing.count() == 0


def test_other_definitions_are_encoded_whole():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.Encoder(open(file, encoding="utf-8").read())
    texts = ["", "A few  words, here", " and\nthere "]
    assert not encoder.cuts and token_files.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()).cuts
    ids, n = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [Tokenizer.from_file(file).encode(t, add_special_tokens=False).ids for t in texts]


def test_words_that_go_straight_to_the_model_have_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = token_files.Encoder(open(file, encoding="utf-8").read()), Tokenizer.from_file(file)
    rng = np.random.default_rng(7)
    letters = ["a", "B", "é", "Ç", "ß", "ž", "Ə", "ɏ", "*", ".", "#", "_", ",", "'", "-", "\n", " ", "×", "1", "ñ", "the", "tion"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400)] + ["it's a<|endoftext|>b <|endoftext|>, x", "word,.*** next's", "a\nB,c"]
    texts = [" ".join(t.split(" ")).strip() for t in texts] + texts
    assert encoder.direct
    for some in (texts, [t for t in texts if t and not token_files.re.search(token_files._ODD, t)]):
        ids, n = encoder.encode(pa.array(some))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.with_crc32(token_files.read_ids(spark, path)).count() == 0
