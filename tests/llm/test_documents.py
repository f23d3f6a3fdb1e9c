"""The document operators against brute force, and their edge cases."""

import base64
import collections
import hashlib
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

from rigspark.llm import byte_bpe, decontamination, ngram_join, packing, pretokens, quality_classifier, quality_rules, queries

DATA = "/root/testdata/sf0.001"
VOCABULARY = queries.vocabulary()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = "doc_id long, text string, lang string, n_words int, removed string, n long"
LONG = " ".join(f"word{i}" for i in range(60)) + "."
ROWS = [
    (1, "a b c d e f g", "en", 1, "x", 1), (2, "a b c d e f g", None, None, None, None), (2, "a b c d e f g", "en", 1, "x", 1), (3, None, "en", 1, "x", 1), (4, "", "en", 1, "x", 1), (5, " \n\t ", "en", 1, "x", 1),
    (None, "a b c d e f g", "en", 1, "x", 1), (6, "A B c", "en", 1, "x", 1), (7, "a b C", "en", 1, "x", 1), (8, "é" * 2000, "en", 1, "x", 1), (9, "w " * 400_000, "en", 1, "x", 1), (10, LONG + "\nshort tail here.", "en", 1, "x", 1), (11, "Other words first. " + LONG, "en", 1, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def brute_classes(rows, n=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("options", [{}, {"block": 2}, {"block": 8, "bucket_bytes": 2000, "step_bits": 2}])
def test_ngram_join(table, docs, options):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(table, **options).collect()}
    assert got == brute_classes(zip(docs.doc_id, docs.text, strict=True))


@pytest.mark.parametrize("options", [{"block": 4}, {"block": 16, "bucket_bytes": 3000, "step_bits": 1}])
def test_ngram_join_of_large_groups(spark, options):
    """Clusters that share boilerplate, chains of near copies, and exact copies, in groups far beyond a block."""
    rng = np.random.default_rng(5)
    common = [" ".join(f"c{k}x{j}" for j in range(12)) for k in range(4)]
    texts = []
    for k in range(12):
        own = [f"w{k}x{j}" for j in range(90)]
        for step in range(14):  # a chain: each text differs a little from the one before
            own = list(own)
            own[int(rng.integers(0, 90))] = f"n{k}x{step}"
            texts.append(" ".join([common[k % 4], *own, common[(k + 1) % 4]]))
    texts += [texts[3]] * 20 + [common[0]] * 3
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[j]) for i, j in enumerate(order)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute_classes(rows)


def test_ngram_join_edges(odd, empty):
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(odd).collect()), key=str)
    assert got.count((2, 3, 1)) == 2 and (0, 3, None) in got and (1, 3, 1) in got
    assert {(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6)} <= set(got)
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_bpe_matches_the_library(table, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in queries.token_digests(table).collect()}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    bpe = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    rng = np.random.default_rng(4)
    odd = ["a" * 5000, "ab" * 3000, "\x1c\x1d x  y \n\n  z", "日本語🙂🙂", "\u0085 a", "1234567890" * 50, "", "aaaa", *("".join(rng.choice(list("ab "), rng.integers(1, 300))) for _ in range(200))]
    for text, ids in zip(odd, bpe.encode_all(odd), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_bpe_decode(odd):
    ids = byte_bpe.bpe_encode(odd, VOCABULARY, public_tokenizers.PATTERN)
    got = sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in byte_bpe.bpe_decode(ids, VOCABULARY, public_tokenizers.PATTERN).collect())
    assert got == sorted((r[0] or 0, (r[1] or "").encode()) for r in ROWS)


def test_bpe_edges(odd, empty):
    got = queries.token_digests(odd).collect()
    assert len(got) == len(ROWS) and {r["doc_id"] for r in got if r["n_tokens"] == 0} == {3, 4}
    assert queries.token_digests(empty).count() == 0


def brute_hits(docs, bench, width=10):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    items |= windows[g]
        out[i] = len(w), len(hit), sorted(items)
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000}, {"block_bytes": 3000, "pass_bytes": 6000}])
def test_decontamination(spark, table, docs, options):
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet")
    want = brute_hits(zip(docs.doc_id, docs.text, strict=True), zip(bench.item_id, bench.text, strict=True))
    found = decontamination.find_contamination(table, spark.read.parquet(f"{DATA}/benchmark.parquet"), **options)
    got = {r["doc_id"]: (r["n_words"], r["n"], list(r["items"])) for r in found.select("doc_id", "n_words", decontamination.hit_words().alias("n"), "items").collect()}
    assert got == want
    kept = {r["doc_id"] for r in decontamination.decontaminate(table, spark.read.parquet(f"{DATA}/benchmark.parquet"), **options).collect()}
    assert kept == {i for i, x in want.items() if not x[1]}


def test_decontamination_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, "B c d"), (2, None), (3, ""), (3, "!!"), (None, "zz")], "item_id long, text string")
    found = decontamination.find_contamination(odd, bench)
    rows = found.select("doc_id", decontamination.hit_words().alias("n")).collect()
    assert len(rows) == len(ROWS) and {r["doc_id"] for r in rows if r["n"]} == {1, 2, None}
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.find_contamination(odd, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontamination.decontaminate(odd, bench).columns == odd.columns


def brute_longest(docs, bench, width=10):
    """(words, place) of the longest match that begins with a window, the earliest of equals."""
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOWER))
    items = [w for _, t in bench if (w := words(t))]
    at = collections.defaultdict(list)
    for k, item in enumerate(items):
        for i in range(max(1, len(item) - width + 1)):
            at[tuple(item[i : i + width])].append((k, i))
    out = {}
    for i, t in docs:
        own, best = words(t), None
        for p in range(len(own)):
            for size in range(1, width + 1):
                for k, j in at.get(tuple(own[p : p + size]), []):
                    n = 0
                    while p + n < len(own) and j + n < len(items[k]) and own[p + n] == items[k][j + n]:
                        n += 1
                    if best is None or n > best[0]:
                        best = n, p
        out[i] = best
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000}, {"block_bytes": 2000, "pass_bytes": 6000}])
def test_longest_matches(spark, table, docs, options):
    bench = pd.read_parquet(f"{DATA}/benchmark.parquet")
    want = brute_longest(zip(docs.doc_id, docs.text, strict=True), zip(bench.item_id, bench.text, strict=True))
    texts = {str(i): t for i, t in zip(bench.item_id, bench.text, strict=True)}
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOWER))
    got = {r["doc_id"]: (r["text"], r["longest"]) for r in decontamination.find_contamination(table, spark.read.parquet(f"{DATA}/benchmark.parquet"), **options).join(table, "doc_id").collect()}
    assert {i: m and (m["words"], m["at"]) for i, (_, m) in got.items()} == want and any(want.values())
    for text, m in got.values():
        if m:
            assert words(text)[m["at"] : m["at"] + m["words"]] == words(texts[m["item"]])[m["item_at"] : m["item_at"] + m["words"]]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 10}, {"block_bytes": 10, "pass_bytes": 20}])
def test_repeated_ids_keep_their_own_hits(spark, options):
    bench = spark.createDataFrame([(k, f"item{k} has its own short words {k}") for k in range(6)], "item_id int, text string")
    rows = [(7, "clean words only, as many as in it"), (7, "say item3 has its own short words 3"), (None, "say item2 has its own short words 2"), (None, "clean words only, as many as in it"), (7, "clean words only, as many as in it")]
    found = decontamination.find_contamination(spark.createDataFrame(rows, "doc_id int, text string"), bench, **options)
    got = sorted(((r["doc_id"], r["n"], r["items"]) for r in found.select("doc_id", decontamination.hit_words().alias("n"), "items").collect()), key=str)
    assert got == sorted([(7, 0, []), (7, 7, ["3"]), (None, 7, ["2"]), (None, 0, []), (7, 0, [])], key=str)


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    g = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality_rules(table, docs):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(table).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        r, want = rows[i], brute_counts(t)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    good = [rows[i]["kept"] for i, q in zip(labels.doc_id, labels.quality, strict=True) if q and not rows[i]["base_failed"]]
    bad = [rows[i]["kept"] for i, q in zip(labels.doc_id, labels.quality, strict=True) if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05


def test_quality_rules_edges(odd, empty):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == len(ROWS) and all(r["base_failed"] for r in rows if r["doc_id"] in (1, 3, 4, 5, 9))
    assert quality_rules.quality_rules(empty).count() == 0 and quality_rules.keep_quality(odd).columns == odd.columns


def test_viterbi_is_the_best_path():
    crf = quality_rules.line_model()
    rng = np.random.default_rng(1)
    for _ in range(50):
        scores = rng.normal(0, 2, (5, 2))
        paths = [[(k >> i) & 1 for i in range(5)] for k in range(32)]
        total = lambda p: sum(scores[i, y] for i, y in enumerate(p)) + sum(crf.move[a, b] for a, b in zip(p, p[1:], strict=False))
        assert np.isclose(total(crf.viterbi(scores.tolist())), max(map(total, paths)))


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = quality_classifier.train_quality(docs, labels, per_class=300)
    rows = quality_classifier.score_quality(docs, net).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_quality_classifier_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    net = quality_classifier.train_quality(odd, labels)
    rows = quality_classifier.score_quality(odd, net).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.score_quality(empty, net).count() == 0


def test_long_texts_score_alike_in_pieces():
    net = quality_classifier.ByteConv()
    text = np.frombuffer(("some words and more of them " * 60_000).encode(), np.uint8)
    whole = net.responses(np.concatenate([text, np.zeros(-len(text) % 256, np.uint8)]), np.zeros(1, np.int64)).reshape(-1, 64, 32).max(1)
    assert np.allclose(net._pooled(text), whole, atol=1e-4)


def test_packing_is_lossless(table, docs):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(open(VOCABULARY, "rb").read()), public_tokenizers.PATTERN)
    got = collections.defaultdict(dict)
    for r in packing.pack_tokens(table, VOCABULARY, public_tokenizers.PATTERN, length=256).collect():
        ids = np.frombuffer(r["input_ids"], "<i4")
        assert len(ids) == 256 and (ids[r["n_tokens"] :] == 50256).all() and list(r["position_resets"]) == list(r["cu_seqlens"])[:-1]
        for k, (i, a) in enumerate(zip(r["doc_ids"], r["token_starts"], strict=True)):
            got[i][a] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert (np.concatenate([got[i][a] for a in sorted(got[i])]) == bpe.encode(t)).all()


def test_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(100):
        most = int(rng.integers(3, 40))
        lengths = rng.integers(1, most + 1, rng.integers(0, 60)).tolist()
        rows, rooms = packing.best_fit(lengths, most), []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(most - n)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        assert all(sum(lengths[k] for k in r) <= most for r in rows) and len(rows) == len(rooms)


def test_packing_edges(odd, empty):
    rows = packing.pack_tokens(odd, VOCABULARY, public_tokenizers.PATTERN, length=64).collect()
    assert sum(len(r["doc_ids"]) for r in rows) and all(r["n_tokens"] <= 64 for r in rows)
    assert packing.pack_tokens(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_packed_rows_are_written_and_full(spark, table, docs, tmp_path):
    for splits in (1, 4):
        path = str(tmp_path / f"packed{splits}")
        packing.write_packed(packing.pack_tokens(table.repartition(splits), VOCABULARY, public_tokenizers.PATTERN, length=1024), path)
        rows = spark.read.parquet(path).collect()
        tokens = sum(r["n_tokens"] for r in rows)
        assert tokens / (1024 * len(rows)) > 0.97  # each split leaves at most its last rows open
        for shard in {r["shard"] for r in rows}:
            own = [r for r in rows if r["shard"] == shard]
            matrix, cuts, resets = packing.packed_shard(own)
            assert matrix.shape == (len(own), 1024)
            for line, cut, reset in zip(matrix, cuts, resets, strict=True):
                assert cut[0] == 0 and (np.diff(cut) > 0).all() and (line[cut[-1] :] == 50256).all() and (reset == cut[:-1]).all()
    assert packing.packed_shard([])[0].shape == (0, 0)


def test_packing_keeps_text_ids(spark):
    rows = packing.pack_tokens(spark.createDataFrame([("a", "one two"), (None, "three")], "doc_id string, text string").coalesce(1), VOCABULARY, public_tokenizers.PATTERN, length=8).collect()
    assert sorted((x for r in rows for x in r["doc_ids"]), key=str) == [None, "a"]


def test_merging_by_rounds_is_the_same():
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(open(VOCABULARY, "rb").read()), public_tokenizers.PATTERN)
    rng = np.random.default_rng(8)
    words = [b"a", b"aaaa", b"ab" * 100, *(bytes(rng.choice(list(b"ab er\xc3\xa9"), rng.integers(1, 60)).astype(np.uint8)) for _ in range(500))]
    assert bpe.merge_rounds(words) == bpe.merge_all(words) == [np.array(bpe.merge(w), "<i4").tobytes() for w in words]


def test_scores_match_plain_loops():
    """The network written as loops over filters, steps and chunks."""
    net = quality_classifier.ByteConv(seed=3)

    def plain(text):
        data = text.encode()
        blocks = max(1, -(-len(data) // 256))
        data = data + bytes(blocks * 256 - len(data))
        steps = [np.concatenate([net.e[b] for b in data[i : i + 4]]) for i in range(0, len(data), 4)]
        answers = []
        for i, a in enumerate(steps):
            ahead = steps[i + 1] @ net.x if i + 1 < len(steps) else 0
            answers.append(a @ net.w + ahead + net.b)
        logits = []
        for k in range(max(1, blocks - 1)):
            pooled = np.maximum(np.max(answers[64 * k : 64 * k + 64 * min(2, blocks)], axis=0), 0)
            logits.append(np.maximum(pooled @ net.u + net.c, 0) @ net.v + net.d[0])
        return 1 / (1 + np.exp(-np.mean(logits)))

    rng = np.random.default_rng(4)
    texts = ["", "a", "é" * 300, *("".join(rng.choice(list("abc é\n"), n)) for n in (255, 256, 257, 511, 512, 513, 3000)), None]
    from rigspark.llm.words import text_buffers
    import pyarrow as pa

    got = net.scores(*text_buffers(pa.array(texts, pa.string())))
    assert np.allclose(got, [plain(t or "") for t in texts], atol=1e-5)


def test_all_chunks_of_a_text_are_trained_on():
    text = "x" * 1000
    chunks = quality_classifier.chunks_of(text)
    assert chunks.shape == (3, 512) and bytes(chunks.ravel())[:512] == b"x" * 512 and quality_classifier.chunks_of(None).shape == (1, 512)
    net = quality_classifier.ByteConv().train(np.concatenate([quality_classifier.chunks_of("good words " * 40), quality_classifier.chunks_of("#### $$$$ " * 40)]), np.array([1.0, 0.0]), np.ones(2), epochs=200)
    assert np.array_equal(net.e.shape, (256, 4))


def test_repeated_labelled_ids_are_one(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 3 + [(2, 0)] * 3, "doc_id long, quality int")
    rows = quality_classifier.score_quality(docs, quality_classifier.train_quality(docs, labels)).collect()
    assert len(rows) == 100


def test_array_encoder_is_the_same(docs):
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(open(VOCABULARY, "rb").read()), public_tokenizers.PATTERN)
    fast = pretokens.Encoder(bpe)
    assert pretokens.PATTERN == public_tokenizers.PATTERN
    rng = np.random.default_rng(1)
    odd = ["".join(rng.choice(list("ab's'td're've'll'm  \n\t1٣é日🙂-!. \x1c\x85rl"), rng.integers(0, 40))) for _ in range(5000)]
    odd += ["", "a" * 3000, " " * 500, "\'\'s", "can't'd've", "'ll", " 's", "\n's", "a" * 257 + " b", "\n \n x"]
    for texts in (odd, list(docs.text), odd, [], [""]):
        assert [x.tolist() for x in fast.encode_all(texts)] == [x.tolist() for x in bpe.encode_all(texts)]


def test_full_tables_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(pretokens, "MOST", 1 << 8)
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(open(VOCABULARY, "rb").read()), public_tokenizers.PATTERN)
    fast = pretokens.Encoder(bpe)
    for k in range(0, len(docs), 10):
        texts = list(docs.text[k : k + 10])
        assert [x.tolist() for x in fast.encode_all(texts)] == [x.tolist() for x in bpe.encode_all(texts)]


def brute_rows(rows, n=5):
    """As ``brute_classes``, for rows of which several may have one id."""
    keyed = brute_classes([((k,), t) for k, (_, t) in enumerate(rows)], n)
    up = {("row", k): ("row", keyed[(k,)][1][0]) for k in range(len(rows))}
    group = {}
    edges = [(("row", k), up["row", k]) for k in range(len(rows))] + [(("row", k), ("id", i)) for k, (i, _) in enumerate(rows)]
    for a, b in edges:
        x, y = group.get(a, {a}), group.get(b, {b})
        both = x | y
        for z in both:
            group[z] = both
    return sorted((i, keyed[(k,)][0], min(z[1] for z in group["row", k] if z[0] == "id")) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"block": 2}, {"block": 8, "bucket_bytes": 2000, "step_bits": 2}])
def test_ngram_join_of_repeated_ids_with_different_texts(spark, options):
    a, b = [f"a{k}" for k in range(100)], [f"b{k}" for k in range(100)]
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, " ".join(a[:52] + b[:52])), (3, " ".join(a + ["end"])), (5, " ".join(b + ["end"])), (5, None), (4, ""), (4, "lone words here"), (8, " ".join(a[:52] + b[:52])), (8, "x y z")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_jaccard_join(table, **options).collect())) == brute_rows(rows)
    few = rows[:3]
    got = sorted(map(tuple, ngram_join.ngram_jaccard_join(spark.createDataFrame(few, "doc_id long, text string"), **options).collect()))
    assert [(i, c) for i, _, c in got] == [(7, 7), (7, 7), (9, 9)] and got == brute_rows(few)


def test_copied_items_of_any_length_take_linear_time():
    import time

    words = " ".join(f"w{k}" for k in range(200_000))
    for text in (words, "same " * 100_000):
        block = decontamination.Block.of([("item", text)])
        docs = decontamination.Block.of([("doc", "before it " + text)])
        began = time.perf_counter()
        found = decontamination.search_blocks(docs.hashes, docs.counts, [block], 10)[0]
        assert found.longest[0] >= len(text.split()) and found.ranges[:, -1].tolist()[1] == len(text.split()) + 2
        assert time.perf_counter() - began < 30
        assert decontamination.search_blocks(docs.hashes, docs.counts, [block], 10, longest=False)[0].longest is None
