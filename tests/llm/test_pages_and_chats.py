"""URL filter, HTML extraction and chat formatting."""

import json

import duckdb
import pytest

from rigspark.llm import chat_format, html_extract, queries, url_filter

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, DATA).collect()
    assert sorted(str([r[c] for c in columns]) for r in got) == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/de/1"), (4, "HTTP://A.Example.ORG/es/x?q=/de/#t"), (5, "https://example.org"), (6, "http://x.com/de/9"), (6, "http://x.com/de/9"), (None, "http://x.com/fr/9/"), (7, "http://" + "h/" * 5000), (8, "http://badexample.org/es/1"), (9, "http://example.org/en/12#a?b")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(table).collect()}
    assert got[1][:3] == got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[5][:3] == ("example.org", "", None)
    assert got[6][2:] == ("com/de/", "block") and got[None][2:] == ("com/fr/", "allow") and got[8][2:] == ("org/", "allow") and got[9][2:] == ("example.org/en/1", "block")
    assert url_filter.url_filter(table).count() == len(rows) and url_filter.url_filter(table.limit(0)).count() == 0


def test_impure_template_is_rejected(spark):
    rows = [(i, f"http://s.com/de/{i}") for i in range(200)] + [(1000 + i, f"http://s.com/xx/{i}") for i in range(5)] + [(2000 + i, f"http://t.com/fr/{i}") for i in range(400)]
    got = {r["page_id"]: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0]["template"] == "de/{#}" and got[1003]["rule"] is None and got[1003]["verdict"] == "block" and got[2001]["verdict"] == "allow"


def test_slugs_and_ids_are_wildcards_and_siblings_merge(spark):
    rows = [(i, f"http://s.com/de/some-slug-{i}/part") for i in range(60)] + [(100 + i, f"http://s.com/at/other-long-slug-{i}/part") for i in range(60)] + [(200 + i, f"http://s.com/fr/{i:08x}a{i}") for i in range(80)] + [(300, "http://s.com/at/other-long-slug-7/else")]
    rules = [("block", "s.com", "/de/"), ("block", "s.com", "/at/other-long-slug-1"), ("allow", "s.com", "/fr/")]
    table = url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules=rules)
    got = {r["page_id"]: r for r in table.collect()}
    assert got[3]["template"] == "de/{slug}/part" and got[130]["template"] == "at/{slug}/part" and got[210]["template"] == "fr/{hex}"
    # both branches are blocked where a rule speaks, so they are one pool, which the second one's few labels do not differ from
    assert 0.8 < got[130]["purity"] < got[3]["purity"] and got[130]["rule"] is None and got[130]["verdict"] == "block" and got[210]["verdict"] == "allow"


PAGE = """<html><head><title>No</title><style>p{x}</style></head><body><nav><a href=x>Up</a></nav><div class="cookie-bar">We use cookies on all of our pages here.</div>
<article><h1>The &amp; title</h1><p>First  paragraph of the\n text, with a <a href=x>link</a> in it and some more words to read.</p><script>var a="<p>no</p>";</script><p>Short.</p></article>
<section class=comments><p>I like this article a lot and would read it again.</p></section><footer>&copy; us</footer></body>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "The & title\nFirst paragraph of the text, with a link in it and some more words to read.\nShort."
    unclosed = f"<article><p class=share>Share this page with all of your friends today<p>{html_extract._LONG}<p>{html_extract._MORE}</article>"
    assert html_extract.main_text(unclosed) == f"{html_extract._LONG}\n{html_extract._MORE}"
    assert html_extract.main_text(None) ==html_extract.main_text("") == html_extract.main_text("<p") == ""


def test_html_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (None, "u", PAGE, None), (3, "u", "<article>" + "<p>" + "word " * 200_000 + "</p>", "x"), (4, "u", "<div>" * 3000 + "text", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_main_text(table).collect()
    assert len(got) == len(rows) and max(r["n_chars"] for r in got) == 200_000 * 5 - 1
    assert html_extract.extract_main_text(table.limit(0)).count() == 0


def records(spark, *items):
    return spark.createDataFrame([(k, 0, json.dumps(x) if not isinstance(x, str) else x) for k, x in enumerate(items)], "conv_id long, turn long, record string")


def test_layouts(spark):
    rows = records(
        spark, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 7}, {"prompt": "a", "response": "b"}, {"instruction": "a", "input": "i", "output": "b"}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"unknown": 1}, "no json", {"question": "a", "answer": "b", "prompt2": None}, {"messages": []},
    )
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.canonical_turns(rows).collect()}
    both = [("user", "a"), ("assistant", "b")]
    assert got[0] == got[1] == got[3] == got[6] == both and got[2] == [("user", "a\n\ni"), ("assistant", "b")] and got[4] == got[5] == got[7] == []


@pytest.mark.parametrize("text", ["", "<|end|>\n", "<\\|user|>\n", "</s>[INST] ok [/INST]", "[\\\\/INST]<", "<|assistant|>\nx<|end|>\n", "a\\<|", "é🙂\n"])
def test_round_trip(spark, text):
    rows = records(spark, {"messages": [{"role": "user", "content": text}, {"role": "assistant", "content": text}, {"role": "odd<|x|>\n", "content": "y"}]})
    formatted = chat_format.format_chats(chat_format.canonical_turns(rows))
    back = chat_format.read_back(formatted).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [("user", text), ("assistant", text), ("odd<|x|>\n", "y")] and back["loss_texts"] == [text]


def test_more_fields_than_a_mapping_names(spark):
    rows = records(spark, {"instruction": "a", "input": "i", "output": "b", "text": "whole"}, {"prompt": "p", "messages": [{"role": "user", "content": "a"}]}, {"system": "s", "question": "a", "answer": "b"}, {"unknown": 1}, {"role": "user", "text": "t", "answer": "x"})
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["layout"]) for r in chat_format.canonical_turns(rows).collect()}
    assert got[0][0] == [("user", "a\n\ni"), ("assistant", "b")] and got[1][0] == [("user", "a")] and got[2][0] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert got[3] == ([], None) and got[4] == ([("user", "t")], "role+text")
    assert {r["conv_id"]: r["unread"] for r in chat_format.format_chats(chat_format.canonical_turns(rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0}


def test_clashing_columns_stay(spark):
    rows = records(spark, {"role": "user", "text": "t"}).selectExpr("*", "1 AS v", "2 AS row", "3 AS has", "4 AS turns")
    got = chat_format.canonical_turns(rows)
    assert got.columns == ["conv_id", "turn", "record", "v", "row", "has", "fingerprint", "layout", "turns"]
    assert tuple(got.select("v", "row", "has").first()) == (1, 2, 3)


def test_chat_edges(spark):
    rows = spark.createDataFrame([(1, None, '{"role": null, "text": null}'), (1, 5, '{"role": "user", "text": "b"}'), (1, 5, '{"role": "user", "text": "a"}'), (1, 5, '{"role": "user", "text": "a"}'), (None, 1, '{"role": "user", "text": "n"}'), (2, 1, None)], "conv_id long, turn long, record string")
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat_format.read_back(chat_format.format_chats(chat_format.canonical_turns(rows))).collect()}
    assert got == {1: ["", "a", "a", "b"], None: ["n"], 2: []}
    assert chat_format.format_chats(chat_format.canonical_turns(rows.limit(0))).count() == 0


def brute_article(page: str) -> str:
    """What the test pages' articles say, by a parser of another make: text of <article>, cut at its paragraphs and headings."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, blocks = False, [[]]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside = True
            elif tag in ("p", "h1", "h2", "h3", "ul", "li", "blockquote"):
                self.blocks.append([])
            elif tag == "br":
                self.blocks[-1].append(" ")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            elif tag in ("p", "h1", "h2", "h3", "ul", "li", "blockquote"):
                self.blocks.append([])

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1].append(data)

    reader = Reader()
    reader.blocks = [[]]
    reader.feed(page)
    texts = [" ".join("".join(b).split()) for b in reader.blocks]
    return "\n".join(t for t in texts if t)


def test_pages_match_another_parser(spark):
    import pandas as pd

    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op6_html_extract(spark, DATA).collect()}
    for i, page in zip(pages.page_id, pages.html, strict=True):
        want = brute_article(page)
        assert got[i] == (want, len(want))


LONG, MORE = html_extract._LONG, html_extract._MORE


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><p><a href=x>Home</a></p><p><a href=x>News</a></p><p>{LONG}</p><p>Short.</p><p>{MORE}</p><p><a href=x>Privacy</a></p><p><a href=x>Imprint</a></p>", [LONG, "Short.", MORE]),
        (f"<body>{LONG}<div>{MORE}</div>", [LONG, MORE]),
        (f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><text>drawn</text></svg> <object>plain</object></p><ul><li><a href=x>More ships</a></li><li><a href=x>And yet more of them, in the harbour and at sea</a></li></ul></article>", [LONG, "So x=2 and drawn plain"]),
        (f"<article><p>{LONG}</p><p><a href=x>{MORE}</a></p><p>{LONG}</p></article>", [LONG, MORE, LONG]),
        (f"<article><p>{LONG}</p><div class='newsletter'><p>{MORE}</p></div><p>Fin</p></article><p>{MORE}</p>", [LONG, "Fin"]),
    ],
)
def test_blocks_by_words_and_links(page, want):
    assert html_extract.main_text(page) == "\n".join(want)


def test_word_and_link_features_decide():
    """With the values of the word and link features dealt out anew among the blocks, verdicts change."""
    import numpy as np

    rows = np.array([b.features for page, _ in html_extract.labelled_pages() for b in html_extract.text_blocks(page)])
    tree = html_extract.block_tree()
    before = [tree.score(r) >= 0.5 for r in rows.tolist()]
    rng = np.random.default_rng(2)
    for k in (1, 3, 5):  # own links, links before, links after
        other = rows.copy()
        other[:, k] = rng.permutation(other[:, k])
        assert sum(x != (tree.score(r) >= 0.5) for x, r in zip(before, other.tolist(), strict=True)) > len(rows) / 100


@pytest.mark.parametrize("unit", ["<div>", "<svg>", '<a "', "<!-- ", "<noscript>", "<", "<![CDATA[", "<ul><li>", "</section>"])
def test_hostile_pages_take_linear_time(unit):
    import time

    began = time.process_time()
    html_extract.main_text(unit * (3_000_000 // len(unit)))
    assert time.process_time() - began < 30
