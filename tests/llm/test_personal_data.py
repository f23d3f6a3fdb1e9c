"""Personal data against the plain patterns, and disguises with their places in the source."""

import hashlib
import re

import pandas as pd
import pytest

from rigspark.llm import personal_data as pd_, queries

DATA = "/root/testdata/sf0.001"


def brute_base(text):
    """The plain patterns as they are written, by the library's own search."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


BASE = ["a@b.c@d.e", "x@y z@a.b-c.d. end", "%@a.b", "@a.b", "a@.b", "a@b", "a@b..c", "ab@c.d_e", "é.a@b.cé", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "0001.002.3.4", "12.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 9", "4111  1111", "79927398713000 - 1", "+1 (017) 555-7713 .", "+1", "++12345678 9", "+123456789012345678", "+1.2.3.4.5.6.7.8.9", "1+1-555-555-5555-", "0" * 25, "00000000000000", "a" * 2000, "1" * 2000, "+1" + " " * 2000 + "x", "." * 2000 + "@" * 2000, "", " "]


@pytest.mark.parametrize("text", BASE, ids=range(len(BASE)))
def test_base(text):
    got = [(a, pd_.KINDS.index(k), b) for a, k, b in sorted(pd_.base_spans(text), key=pd_._order)]
    assert got == brute_base(text)


CAUGHT = [
    ("write to [jane (at) mail dot example dot com] now", "email", "jane (at) mail dot example dot com"),
    ("[john.doe [at] example [dot] org], thanks", "email", "john.doe [at] example [dot] org"),
    ("Reach [jane dot doe at example dot com] today.", "email", "jane dot doe at example dot com"),
    ("Reach [jane_at_example_dot_com] today.", "email", "jane_at_example_dot_com"),
    ("Reach [jane-at-example-dot-net] today.", "email", "jane-at-example-dot-net"),
    ("Reach [jane at example (dot) com] today.", "email", "jane at example (dot) com"),
    ("Reach [jane@example dot com]. Then", "email", "jane@example dot com"),
    ("Reach [jane @ example . com] Then", "email", "jane @ example . com"),
    ("[JANE {AT} EXAMPLE {DOT} COM]", "email", "JANE {AT} EXAMPLE {DOT} COM"),
    ("Escribe a [juan arroba correo punto es] hoy", "email", "juan arroba correo punto es"),
    ("[jаne@exаmple.com] is written with а", "email", "jаne@exаmple.com"),
    ("[ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ]", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("[ja​ne@exam­ple.com]", "email", "ja​ne@exam­ple.com"),
    ("host [one nine two dot one six eight dot one dot seven] up", "ip", "one nine two dot one six eight dot one dot seven"),
    ("host [192 dot 168 dot 1 dot 7] up", "ip", "192 dot 168 dot 1 dot 7"),
    ("host [192[.]168[.]1[.]7] up", "ip", "192[.]168[.]1[.]7"),
    ("host [１９２.168.1.7] up", "ip", "１９２.168.1.7"),
    ("card [four one one one one one one one one one one one one one one one].", "card", "four one one one one one one one one one one one one one one one"),
    ("card [four, triple one 1111 1111 double one one one].", "card", "four, triple one 1111 1111 double one one one"),
    ("card [4111 1111 1111 1111] .", "card", "4111 1111 1111 1111"),
    ("card [41ll 1l11 1111 1111] .", "card", "41ll 1l11 1111 1111"),
    ("card [٤١١١ ١١١١ ١١١١ ١١١١] .", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("call [plus one four eight seven five five five seven two zero nine] ok", "phone", "plus one four eight seven five five five seven two zero nine"),
    ("call [+eins zwei drei vier fünf sechs sieben acht neun null] ok", "phone", "+eins zwei drei vier fünf sechs sieben acht neun null"),
    ("call [+1 (487) five five five - 7209] ok", "phone", "+1 (487) five five five - 7209"),
    ("call [＋1 (487) 555‑7209] ok", "phone", "＋1 (487) 555‑7209"),
]


@pytest.mark.parametrize("marked, kind, inner", CAUGHT, ids=range(len(CAUGHT)))
def test_disguises(marked, kind, inner):
    start = marked.index("[" + inner)
    text = marked[:start] + inner + marked[start + len(inner) + 2 :]
    base = pd_.base_spans(text)
    assert (start, kind, start + len(inner)) in pd_.added_spans(text, base)


CLEAN = ["Look at us dot and go", "We met at noon. It was one two three go.", "see example.com at home", "the dot product at hand", "look_at_this_dot_product", "plus un deux trois", "one two three four five six seven eight nine ten eleven", "mail me at home", "fünf sechs sieben", "10² and ½ of 3–4 pages – 2019–2020", "le point est à vous, arrivé at dix", "Plain text with jane@example.com, 1.2.3.4 and 4111 1111 1111 1111", "почта@пример.рф стоит", "​​", "@ @ . com", "1eb9c654e721b4f812088970e66a6345cee33dd6", "I l O 0 l1 IO10"]


@pytest.mark.parametrize("text", CLEAN, ids=range(len(CLEAN)))
def test_clean_texts_gain_nothing(text):
    assert pd_.added_spans(text, pd_.base_spans(text)) == []


def test_long_texts_take_linear_time():
    import time

    for text in ("a" * 500_000, "1" * 500_000, "+1" + " " * 500_000, "." * 500_000 + "@" * 100_000, "at " * 300_000, "dot " * 300_000, "a at b dot " * 100_000, "(at)" * 200_000, "one " * 300_000, " " * 1_000_000 + "[dot]" + " " * 1_000_000, "l0" * 500_000, "a.b@" * 200_000, "_at_" * 200_000, " @" * 200_000, "plus " * 200_000, "one dot " * 150_000):
        began = time.perf_counter()
        pd_.added_spans(text, pd_.base_spans(text))
        assert time.perf_counter() - began < 25, text[:20]


def test_query(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_personal_data(spark, DATA).collect()}
    assert len(got) == len(docs)
    some = 0
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        base = brute_base(text or "")
        joined = ",".join(f"{pd_.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r["spans"].split(","))
        some += len(base)
    assert some > 5


def test_odd_rows(spark):
    rows = [(None, "a@b.cd", 1), (1, None, 1), (2, "", 1), (3, "a@b.cd, x at y dot com", 1), (3, "a@b.cd, x at y dot com", 1), (4, "😀 a@b.cd", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pd_.find_personal_data(docs).collect()), key=str)
    twice = [("email", 0, 6, True), ("email", 8, 22, False)]
    assert got == sorted([(None, [("email", 0, 6, True)]), (1, []), (2, []), (3, twice), (3, twice), (4, [("email", 2, 8, True)])], key=str)
    assert pd_.find_personal_data(docs.limit(0)).count() == 0
    texts = sorted(str(r["text"]) for r in pd_.redacted(docs).collect())
    assert texts == sorted(["******", "None", "", "******, " + "*" * 14, "******, " + "*" * 14, "😀 ******"]) and pd_.redacted(docs).columns == docs.columns
