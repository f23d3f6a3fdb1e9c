"""Repeated passages and lines against brute force over all windows."""

import re

import pandas as pd

from rigspark.llm import substring_dedup

from .test_documents import DATA, LOWER


def brute_passages(rows, min_words=50, line_words=5):
    runs, first = {}, {}
    for i, text in rows:
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        low = [x[0].translate(LOWER) for x in words]
        found = [(tuple(low[k : k + min_words]), k) for k in range(len(low) - min_words + 1)]
        k = 0
        for line in (text or "").split("\n"):
            n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            if line_words <= n < min_words:
                found.append((tuple(low[k : k + n]), k))
            k += n
        runs[i] = words, found
        for key, k in found:
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = {}
    for i, (words, found) in runs.items():
        gone = set()
        for key, k in found:
            j, at = first[key]
            if (j, at) != (i, k):
                if j < i:
                    at = min(p for x, p in found if x == key)  # within the text, beyond the first one there
                    gone |= set(range(k if at == k else max(k, at + len(key)), k + len(key)))
                else:
                    gone |= set(range(max(k, at + len(key)), k + len(key)))
        spans, words_gone = [], sorted(gone)
        for k in words_gone:
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        if spans:
            out[i] = len(gone), [(words[a].start(), words[b - 1].end()) for a, b in spans]
    return out


def found(table, **options):
    return {r["doc_id"]: (r["n_removed_words"], [(s["start"], s["end"]) for s in r["removed"]]) for r in substring_dedup.repeated_passages(table, **options).collect()}


def test_passages_match_brute_force(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    rows = list(zip(docs.doc_id, docs.text, strict=True))
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute_passages(rows)
    assert found(table) == want and want
    assert found(table, min_words=7, line_words=2) == brute_passages(rows, 7, 2)


def test_passages_inside_sentences_and_common_lines(spark):
    passage = " ".join(f"é{i}" for i in range(51))
    rows = [(1, f"A start {passage} and an end."), (2, f"Other words {passage} close it\nLicensed under some open licence."), (3, "Own text.\nlicensed  under some open licence.\nThe end."), (4, "w " * 5000), (None, passage), (5, None), (6, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(table)
    assert got == brute_passages([r for r in rows if r[0] is not None]) and set(got) == {2, 3, 4}
    assert got[2][0] == 51 and got[3][0] == 5 and got[4] == (4950, [(100, 9999)])
    assert found(table.limit(0)) == {}


def test_repeated_ids_keep_their_own_places(spark):
    line = "One line of six small words"
    rows = [(1, line), (2, f"x y\n{line}"), (2, f"{line}\nclean words here that stay"), (2, f"x y\n{line}")]
    got = sorted((r["doc_id"], [tuple(s) for s in r["removed"]]) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, [(0, 27)]), (2, [(4, 31)])]


def test_drop_repeats_cuts_what_is_found(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    want = brute_passages(list(zip(docs.doc_id, docs.text, strict=True)))
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring_dedup.drop_repeats(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert len(kept) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        left, at = [], 0
        for a, b in want.get(i, (0, []))[1]:
            left.append(t[at:a])
            at = b
        left = "".join([*left, t[at:]])
        assert kept[i] == (left, len(left))


def test_drop_repeats_of_one_id(spark):
    passage = " ".join(f"é{i}" for i in range(51))
    rows = [(1, f"Ahead {passage} end.", 1, "x"), (2, f"clean text {passage}", 1, "x"), (2, "Completely different text under the same id, which must stay as it is", 70, "x"), (None, passage, 1, "x"), (3, None, None, "x"), (4, "", 0, "x")]
    kept = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars int, removed string"))
    assert kept.columns == ["doc_id", "text", "n_chars", "removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()), key=str)
    assert got == sorted([r[:3] if r[0] != 2 or r[1][:5] == "Compl" else (2, "clean text ", 11) for r in rows], key=str)


def test_passages_cut_in_mid_sentence(spark):
    """Passages of 51 to 80 words planted at any place of other sentences go wholly, whatever stands around them."""
    import random

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    planted = [" ".join(word() for _ in range(rng.randrange(51, 80))) for _ in range(20)]
    rows = []
    for i in range(200):
        own = [word() + rng.choice(["", ",", ".", "\n"]) for _ in range(120)]
        own.insert(rng.randrange(120), planted[i % 20])
        rows.append((i, " ".join(own)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {i for i, (n, _) in got.items() if n == len(planted[i % 20].split())} == set(range(20, 200))
