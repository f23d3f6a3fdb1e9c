"""Cross-tokenizer alignment and hard-negative mining against brute force."""

import collections
import hashlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rigspark.llm import cross_tokenizer, hard_negatives, queries

DATA = "/root/testdata/sf0.001"
FIRST, SECOND = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))

ODD = ["a b", "a b", None, "", " ", "x▁y", "ﬁ Ａ ① ʼn", "tab\tand\nline\r\n", "</s><s> <unk> <|endoftext|> [INST]", "emoji 😀 and ñ, 漢字かな", "\x00\x1c\x85", "don't I'll 'tis", "w" * 3000, "many words " * 20_000, "ends in space  ", "࡮ࡰ \U0001F9FF"]


def brute_alignment(rows):
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    alphabet = cross_tokenizer.byte_alphabet()
    found, pairs = [], collections.Counter()
    for i, t in rows:
        text = " " + (t or "")
        one = a.encode(text, add_special_tokens=False).ids
        two = b.encode(t or "")
        x = [bytes(alphabet[c] for c in a.id_to_token(k)) for k in one]
        y = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in two for p in [b.id_to_piece(k)]]
        if not t or b"".join(x) != text.encode() or b"".join(y) != text.encode():
            found.append((i, [], 0, 0))
            continue
        ends_a, ends_b = ({int(e): k for k, e in enumerate(np.cumsum(list(map(len, p))))} for p in (x, y))
        groups, last = [], (0, 0)
        for end in sorted(ends_a.keys() & ends_b.keys()):
            at = ends_a[end] + 1, ends_b[end] + 1
            groups.append((one[last[0] : at[0]], two[last[1] : at[1]]))
            last = at
        found.append((i, groups, len(x), len(y)))
        pairs.update((g[0][-1], g[1][-1]) for g in groups)
    best = collections.Counter()
    for (_, k), n in pairs.items():
        best[k] = max(best[k], n)
    out = []
    for i, groups, n_a, n_b in found:
        counts = [(pairs[g[0][-1], g[1][-1]], best[g[1][-1]]) for g in groups]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, n_a, n_b, len(groups), len(groups), sum(n == m for n, m in counts), sum(n for n, _ in counts), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def plain(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *map(str, r)))


def test_alignment(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = queries.op11_cross_tokenizer(spark, DATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert plain(got.collect()) == plain(brute_alignment(zip(docs.doc_id.tolist(), docs.text, strict=True)))


@pytest.mark.parametrize("shard_rows", [50, 1 << 20])
def test_alignment_of_odd_texts(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(cross_tokenizer, "STEP", 97)
    rows = [(None if k == 1 else k // 2, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_a int, links int")
    assert plain(cross_tokenizer.align_tokenizers(docs, FIRST, SECOND, shard_rows=shard_rows).collect()) == plain(brute_alignment(rows))
    groups = {r["doc_id"]: r["groups"] for r in cross_tokenizer.token_groups(docs.where("doc_id = 6"), FIRST, SECOND).collect()}
    assert groups[6][0]["a"] and groups[6][0]["b"]
    assert cross_tokenizer.align_tokenizers(docs.limit(0), FIRST, SECOND).count() == 0


def test_wide_keys():
    keys = np.array([(70_000 << 32) + 5, 3 << 32], np.int64)
    for ids in (1 << 16, 1 << 17):
        some = keys[1:] if ids == 1 << 16 else keys
        packed = cross_tokenizer._packed(some, ids)
        back, cuts = cross_tokenizer._unpacked(__import__("pyarrow").array([packed.tobytes(), b""]), packed.itemsize)
        assert back.tolist() == some.tolist() and cuts.tolist() == [0, len(some), len(some)]


def brute_negatives(rows, scale=256, positives=5, negatives=3, of=50):
    valid = []
    for k, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid.append((k, i, label, [int(np.floor(scale * float(x))) for x in v]))
    out = []
    for k, i, label, v in valid:
        if i % of:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for n, j, m, w in valid if n != k), key=lambda s: s[:2])  # noqa: B905  shorter vectors end in zeros
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            hits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(hits)]
    return sorted(out)


def vectors(seed, n, labels=3, width=6, ties=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [0.5, 0.25, 0.1, 0.0, -0.2, 0.3] if ties and i % 3 else rng.normal(0.3, 0.4, width).tolist()
        rows.append((i, int(rng.integers(labels)), v))
    return rows


NEGATIVES = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("case, few, panel", [("plain", 64, 8192), ("ties", 64, 8192), ("wide", 64, 8192), ("ties", 3, 4), ("odd", 3, 6)])
def test_hard_negatives(spark, monkeypatch, case, few, panel):
    monkeypatch.setattr(hard_negatives, "FEW", few)
    monkeypatch.setattr(hard_negatives, "DIGITS", 256 if few == 64 else 16)
    rows = vectors(3, 320, ties=case == "ties")
    if case == "wide":
        rows = [(i - (1 << 40), k, [x * 1e6 for x in v]) for i, k, v in rows]
    if case == "odd":
        rows += [(None, 1, [1.0]), (400, None, [1.0]), (450, 1, None), (500, 1, [1.0, None]), (550, 1, [float("nan")]), (600, 1, [float("inf")]), (650, 2, []), (650, 2, [0.5]), (700, 0, [0.9, 0.9]), (700, 0, [0.9, 0.9]), (7, 1, [0.9] * 9), (0, 1, [0.3] * 6)]
    table = spark.createDataFrame([(*r, 1) for r in rows], NEGATIVES + ", window int").repartition(2)
    from pyspark.sql import functions as F

    got = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 50 == 0, panel=panel)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([], NEGATIVES)
    assert hard_negatives.mine_hard_negatives(table, F.lit(True)).count() == 0
    one = spark.createDataFrame([(50, 1, [1.0])], NEGATIVES)
    assert hard_negatives.mine_hard_negatives(one, F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mine_hard_negatives(spark.createDataFrame([(50, 1, [1e30]), (51, 1, [1e30])], NEGATIVES), F.lit(True))


def test_hard_negatives_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = queries.op13_hard_negatives(spark, DATA)
    want = con.execute(queries.OP13_SQL)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
