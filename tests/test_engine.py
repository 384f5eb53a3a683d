"""The page engine: parsing, documents, renderings, validation, retrieval, crawl rules, benchmark, files and streams."""

import json
import math
import random
import zipfile
from io import BytesIO

import duckdb
import pytest
from pyspark.sql import functions as F

from pagestrata.functions import plain as P
from pagestrata.functions import text as T
from pagestrata.operators import crawl, document, extract, htmltree, rank, render, validate
from pagestrata.plans import contexts, queries, site
from pagestrata.sources import files
from pagestrata.streaming import state

ARTICLE = """<!doctype html><html lang=" en " class=x><head><title>The  Old Mill &amp; Dam</title><meta name="description" content="All about the mill.">
<link rel="canonical" href="https://docs.example.org/mills/old.html"><link rel="next" href="/p2">
<script type="application/ld+json">{"@type":"Article","name":"Old Mill","2":"two","1":"one","rating":{"@type":"Rating","value":4.0},"tags":["a","b"],"kind":"https://schema.org/Mill"}</script>
<meta property="article:modified_time" content="2024-05-06T10:00:00Z"></head><body>
<header><a href="/">Home page</a></header><nav>Menu of the site goes here</nav>
<main><h1 id="mill">The Old Mill</h1><p>The Old Mill stands by the Grey River since it was built by millers long ago. It works.</p>
<table class="infobox"><tr><th>Height</th><td>12 m</td></tr><tr><th>Height</th><td>13 m</td></tr><tr><th>Owner</th><td>Town</td></tr><tr><th>Material</th><td>Stone</td></tr></table>
<h2 id="wheel">The wheel</h2><p>The wheel turns <code>fast</code> in spring.<br>It is made of oak wood and iron bands.</p><div class="share-box">Share this now</div>
<ul><li>First item<ul><li>Nested item</li></ul></li><li>Second item</li></ul>
<figure><img alt="Wheel seen from the bank"><figcaption>The wheel in 1999</figcaption></figure>
<h2>Numbers</h2><table id="yields"><caption>Yields</caption><tr><th>Year</th><th>Flour | kg</th></tr><tr><td>1900</td><td>5</td></tr><tr><td>1901</td><td>7</td></tr></table>
<pre class="language-sh">
make flour
</pre><blockquote>Grind it well, said the miller to the boy.</blockquote><dl><dt>Opened</dt><dd>1850</dd></dl></main><footer>Copyright of the town council</footer></body></html>"""


@pytest.fixture(scope="module")
def docs(spark):
    thin = "<html><body><p>Short.</p></body></html>"
    app = "<html><body><div id=root></div>" + "<script src=a.js></script>" * 5 + "</body></html>"
    many = "<main><h1>Huge</h1>" + "".join(f"<h2 id=s{i}>Section {i}</h2><p>Paragraph of section {i} with enough words in it.</p>" for i in range(120)) + "</main>"
    rows = [(1, "http://x.org/a", ARTICLE), (2, None, thin), (3, None, app), (4, None, many), (5, None, None), (6, None, "")]
    return render.rendered(document.documents(spark.createDataFrame(rows, "page_id long, url string, html string"))).withColumn("json", render.json_text()).persist()


@pytest.fixture(scope="module")
def one(docs):
    return {r.page_id: r for r in docs.collect()}


# -- parsing


def test_tree_closes_what_is_implied():
    root = htmltree.parse("<ul><li>a<li>b</ul><p>c<div>d</div><p>e</p></p><script>var x='</p>';</script>f")
    tags = [n.tag for n in root.elements()]
    assert tags == ["#document", "ul", "li", "li", "p", "div", "p", "p", "script"]
    assert root.text() == "abcdevar x='</p>';f"
    assert htmltree.parse("<b>x<!-- c -->y</b>").children[0].children == ["x", "y"]
    assert [c for c in htmltree.parse("a&amp;b &am c").children] == ["a&b &am c"]
    assert htmltree.parse("<a ID=x id=y>").children[0].attrs == {"id": "x"}


def test_unclosed_heading_hands_blocks_back():
    c = extract.Content(htmltree.parse("<h1>Title\n<p>One.<h2 id=s>Sub<p>Two."))
    assert [(b.kind, b.text) for b in c.blocks] == [("heading", "Title"), ("para", "One."), ("heading", "Sub"), ("para", "Two.")]


@pytest.mark.parametrize("html", ["<div hidden>x</div>", "<div aria-hidden=true>x</div>", "<div class='page_banner'>x</div>", "<p class='skip-link'>x</p>", "<div role=Navigation>x</div>", "<aside>x</aside>", "<header>x</header>", "<div id='main-ad'>x</div>"])
def test_boilerplate_is_stripped(html):
    assert extract.visible_text(htmltree.parse(html)) == ""


def test_not_boilerplate():
    assert extract.visible_text(htmltree.parse("<div class='adverbial loading'>x</div><section><header>y</header></section>")) == "x y "


def test_table_kinds():
    def kind(html):
        t = htmltree.parse(html).children[0]
        rows = extract.rows_of(t)
        return extract.table_kind(t, rows)

    pair, head, row = "<tr><th>a</th><td>b</td></tr>", "<tr><th>a</th><th>b</th></tr>", "<tr><td>1</td><td>2</td></tr>"
    assert kind(f"<table>{pair}{pair}</table>") == "infobox" and kind(f"<table>{head}{row}{row}</table>") == "data"
    assert kind(f"<table>{head}{row}</table>") == "layout" and kind(f"<table>{row}{row}</table>") == "layout"
    assert kind(f"<table>{head}<tr><td><table>{row}</table></td></tr></table>") == "layout"


# -- documents


def test_document(one):
    d = one[1]
    assert (d.title, d.summary, d.type, d.lang, d.updated, d.series_next) == ("The Old Mill & Dam", "All about the mill.", "article", "en", "2024-05-06", "/p2")
    assert d.url == "https://docs.example.org/mills/old.html"
    kv = [(f.key, f.value) for f in d.facts]
    assert kv[:6] == [("1", "one"), ("2", "two"), ("name", "Old Mill"), ("rating.type", "Rating"), ("rating.value", "4"), ("tags", "a, b")]
    assert kv[6:] == [("kind", "Mill"), ("modified", "2024-05-06"), ("opened", "1850"), ("height", "12 m"), ("height-2", "13 m"), ("owner", "Town"), ("material", "Stone")]
    assert [(c.id, c.anchor) for c in d.chunks] == [("intro", "#mill"), ("wheel", "#wheel"), ("numbers", None)]
    assert "The wheel turns `fast` in spring. It is made" in d.chunks[1].text and "Share this" not in d.md and "Copyright" not in d.md
    assert "- First item\n  - Nested item\n- Second item" in d.chunks[1].text and "figure: Wheel seen from the bank — The wheel in 1999" in d.chunks[1].text
    assert d.chunks[2].text == "table: yields\n\n```sh\nmake flour\n```\n\n> Grind it well, said the miller to the boy."
    assert d.tables[0].cols == ["year", "flour-kg"] and [list(r) for r in d.tables[0].rows] == [["1900", "5"], ["1901", "7"]]
    assert d.chunks[0].tags == ["old-mill", "grey-river"]


def test_failures_and_thin_pages_stay_rows(one):
    assert one[2].ok and one[2].thin and {w.code for w in one[2].warnings} == {"THIN_PAGE", "NO_HEADINGS", "NO_ANCHOR"}
    assert not one[3].ok and one[3].error == "EMPTY_EXTRACTION" and one[3].md is None and one[3].json is None
    assert one[5].ok and one[6].ok and one[5].title == "Untitled"


def test_grouped_contents_and_split(one):
    d = one[4]
    assert d.toc_mode == "grouped" and d.header.endswith("- toc-3: s100 … s119 (20 chunks)") and d.header_units <= 150
    assert {"_header.md", "facts.md", "_toc-1.md", "_toc-3.md", "s0.md"} <= set(d.split) and len(d.split) == 125
    whole = "\n\n".join([d.split["_header.md"][:-1], *(d.split[f"_toc-{i}.md"][:-1] for i in (1, 2, 3)), d.split["facts.md"][:-1], *(d.split[f"s{i}.md"][:-1] for i in range(120))]) + "\n"
    assert whole == d.md


def test_json_mirrors(one):
    j = json.loads(one[1].json)
    assert list(j) == f"{render.FORMAT} title summary type url lang updated series hash toc facts chunks".split()
    assert [c["id"] for c in j["chunks"]] == [t["id"] for t in j["toc"]] and j["series"] == {"prev": None, "next": "/p2"} and one[1].json.endswith("}\n")


def test_json_is_as_json_dumps_writes_it(spark):
    odd = "".join(map(chr, range(33))) + '"\\ \\u000B \\n / \x7f \u2028 é 😀'
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], document.SCHEMA).schema}
    rows = [
        {"title": odd, "summary": "", "type": "a", "url": None, "lang": "x", "updated": None, "series_prev": None, "series_next": odd, "hash": "h", "facts": [{"key": odd, "value": "v"}, {"key": "k", "value": ""}], "tables": [{"id": "t", "cols": ["a", odd], "rows": [["1", odd], []]}, {"id": "", "cols": [], "rows": []}], "chunks": [{"id": "c", "summary": odd, "tags": [], "anchor": None, "text": "a\n\tb"}, {"id": "d", "summary": "s", "tags": ["x", odd], "anchor": "#d", "text": odd}]},
        {"title": "", "summary": "s", "type": "a", "url": "u", "lang": None, "updated": "d", "series_prev": "p", "series_next": None, "hash": "h", "facts": [], "tables": [], "chunks": []},
    ]
    schema = "ok boolean, " + ", ".join(f"{k} {kinds.get(k, 'string')}" for k in rows[0])
    made = spark.createDataFrame([{"ok": True} | r for r in rows], schema).select("title", render.json_text().alias("json"))
    assert "Python" not in made._jdf.queryExecution().toString()
    got = {r.title: r.json for r in made.collect()}
    for x in rows:
        body = {render.FORMAT: render.VERSION, **{k: x[k] for k in "title summary type url lang updated".split()}, "series": {"prev": x["series_prev"], "next": x["series_next"]}, "hash": x["hash"], "toc": [{"id": c["id"], "summary": c["summary"]} for c in x["chunks"]], "facts": {"kv": x["facts"], "tables": x["tables"]}, "chunks": x["chunks"]}
        assert got[x["title"]] == json.dumps(body, ensure_ascii=False, indent=2) + "\n"


def test_oversize_chunks_split_and_packing():
    long = "word " * 1500
    blocks = [extract.Block("heading", "A", 2, "a"), extract.Block("heading", "A1", 3, "a1"), extract.Block("para", long), extract.Block("heading", "A2", 3), extract.Block("para", "x")]
    got, fallback = document.chunks(blocks, {"a": None, "a1": None}, {})
    assert [c["id"] for c in got] == ["a", "a1", "a2"] and not fallback and got[0]["text"] == "" and got[0]["summary"] == "A"
    got, fallback = document.chunks([extract.Block("para", "w " * 700)] * 3 + [extract.Block("para", "tail")], {}, {})
    assert fallback and [c["id"] for c in got] == ["part-1", "part-2", "part-3"] and got[2]["text"].endswith("tail")


def test_parser_runs_once(docs):
    plan = docs.unpersist()._sc._jvm.PythonSQLUtils.explainString(docs._jdf.queryExecution(), "simple")
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name,parses,shuffles", [("two_hop_answers", 1, 0), ("benchmark_conditions", 1, 1), ("validate_findings", 2, 0), ("sibling_json", 1, 0)])
def test_page_queries_parse_once_and_join_nothing(spark, sf_dir, name, parses, shuffles):
    d = queries.QUERIES[name](spark, sf_dir)
    plan = spark._jvm.PythonSQLUtils.explainString(d._jdf.queryExecution(), "simple")
    assert plan.count("MapInArrow") == parses and "Join" not in plan and plan.count("Exchange") == shuffles and plan.count("FileScan") == 1


# -- functions


def test_columns_equal_plain_functions(spark):
    cases = ["Hello World/foo — bar", "!!!", "é Ünï  _x_-", "a" * 70, "word-" * 20, "x " * 60, "A, b; c: " * 30, "One. Two! Three? 4", "", "  lead nbsp﻿ x\u0085y ", "a|b\\c\nd\\n", "in 2024-01-02 or"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    rows = d.select("t", T.slugify("t").alias("s"), T.truncate_at_word("t", 48).alias("w"), T.collapse("t").alias("c"), T.sentences("t").alias("n"), T.units("t").alias("u"), T.iso_date("t").alias("d"), T.valid_id("t").alias("v"), T.unescape_cell(T.escape_cell("t")).alias("e"), T.canonical("t").alias("k"), T.shingles(T.collapse("t"), 2).alias("g")).collect()
    for r in rows:
        assert (r.s, r.w, r.c, r.n, r.u, r.d, r.v, r.e) == (P.slugify(r.t), P.truncate_at_word(r.t, 48), P.collapse(r.t), P.sentences(r.t), P.units(r.t), P.iso_date(r.t), P.valid_id(r.t), r.t)
        assert r.k == validate.canonical(r.t) and set(r.g) == validate.runs(r.c.split(" "), 2)


def test_slug_fold(spark):
    r = random.Random(1)
    rows = [([r.choice(["x", "x-2", "x", "toc", "x-3", "y"]) for _ in range(r.randint(0, 9))],) for _ in range(60)]
    for row in spark.createDataFrame(rows, "a array<string>").select("a", T.dedupe_slugs("a").alias("o")).collect():
        s = P.Slugs()
        assert [s.claim(x) for x in row.a] == row.o


def test_slug_fold_of_many_is_linear(spark):
    import time

    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("b"), (i % 7).cast("string"))).alias("a"))
    began = time.time()
    got = many.select(T.dedupe_slugs("a").alias("o")).first().o
    assert len(set(got)) == 20_000 and got[7] == "b1-2" and time.time() - began < 30


def test_slugs_of_a_large_brand(spark, tmp_path):
    import time

    spark.range(20_000).selectExpr("id as p_partkey", "'x' as p_brand", "cast(id % 3 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    began = time.time()
    got = {r.p_partkey: r.id for r in queries.slug_dedupe(spark, str(tmp_path)).collect()}
    s = P.Slugs()
    assert [got[i] for i in range(20_000)] == [s.claim(f"b{i % 3}") for i in range(20_000)] and time.time() - began < 30


def test_hash_and_units():
    assert P.units("") == 0 and P.units("abcde") == 2 and P.units("é") == 1
    assert P.normalize("é  x\u0085") == "é x\u0085"


def test_saved_percent_at_halves(spark, tmp_path):
    pairs = [(29, 80), (53, 400), (1, 3), (0, 7)]
    rows = spark.createDataFrame(pairs, "sent long, raw long").select(T.saved_percent("sent", "raw").alias("p")).collect()
    assert [r.p for r in rows] == [math.floor((1 - a / b) * 1000 + 0.5) / 10 for a, b in pairs]
    # a page of 80 units of which 29 are text: 63.75 percent, and an empty one
    page = "<html><body><article>" + "w" * 116 + "</article></body></html>"
    spark.createDataFrame([(1, "u", page.ljust(320)), (2, "v", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.token_saving(spark, str(tmp_path)).orderBy("page_id").collect()
    assert list(map(str, map(tuple, got))) == list(map(str, con.sql(queries.ORACLES["token_saving"] + " ORDER BY page_id").fetchall())) and got[0].saved_percent == 63.8


# -- validation


def mutated(md, code):
    return {
        "DIVERGENT_CONTENT": md.replace("It is made of oak", "Buy our wonderful discount cleaner today, dear reader. It is made of oak"),
        "HASH_STALE": md.replace("hash: sha256:", "hash: sha256:0").replace(md.split("hash: sha256:")[1][:16], md.split("hash: sha256:")[1][:15], 1),
        "ANCHOR_BROKEN": md.replace("anchor: #wheel", "anchor: #nowhere"),
        "HEADER_OVER_CAP": md.replace("> All about the mill.", "> " + "All about the mill. " * 40, 1),
        "FACTS_MALFORMED": md.replace("1900|5", "1900|5|6"),
        "NAV_LEAK": md.replace("It is made of oak", "Copyright of the town council It is made of oak") if False else md.replace("table: yields\n", "table: yields\n\nCopyright of the town council\n"),
        "TOC_CHUNK_MISMATCH": md.replace("## chunk wheel", "## chunk wheels"),
        "VERSION_UNSUPPORTED": md.replace(f"<!-- {render.FORMAT} 0.1", f"<!-- {render.FORMAT} 1.0"),
        "STRUCTURE": "plain text",
    }[code]


def test_fresh_documents_pass_and_mutations_are_found(spark, one):
    md = one[1].md
    assert [f for f in validate.findings(ARTICLE, md) if f[0] == "error"] == []
    codes = ["DIVERGENT_CONTENT", "HASH_STALE", "ANCHOR_BROKEN", "HEADER_OVER_CAP", "FACTS_MALFORMED", "NAV_LEAK", "TOC_CHUNK_MISMATCH", "VERSION_UNSUPPORTED", "STRUCTURE"]
    pages = spark.createDataFrame([(i, ARTICLE) for i in range(len(codes) + 1)], "page_id long, html string")
    made = spark.createDataFrame([(i, mutated(md, c)) for i, c in enumerate(codes)] + [(len(codes), md)], "page_id long, md string")
    found = validate.validate(pages, made)
    got = {(r.page_id, r.code) for r in found.collect()}
    assert all((i, c) in got for i, c in enumerate(codes))
    verdict = {r.page_id: r for r in validate.verdicts(found, made).collect()}
    assert not verdict[0].passed and verdict[codes.index("NAV_LEAK")].passed and verdict[len(codes)].passed
    strict = {r.page_id: r.passed for r in validate.verdicts(found, made, strict=True).collect()}
    assert not strict[codes.index("NAV_LEAK")]


def test_cells_round_trip():
    assert validate.split_cells(r"a \| b|c\\|d\ne| x ") == ["a | b", "c\\", "d\ne", "x"]


def test_parse_back(one):
    d = validate.parse_document(one[1].md)
    assert d["errors"] == [] and d["header"] == one[1].header and [c["text"] for c in d["chunks"]] == [c.text for c in one[1].chunks]
    assert [(k, v) for k, v, _ in d["kv"]] == [(f.key, f.value) for f in one[1].facts] and d["tables"][0]["rows"] == [["1900", "5"], ["1901", "7"]]


def test_white_space_and_prefixes():
    import re

    r = random.Random(5)
    for _ in range(3000):
        t = r.choice(["", "figure: ", "## ", "- - ", "> # "]) + "".join(r.choices("ab .,(])[-#> \t\n\x0b\x0c\r\x1c\x85\u00a0\u2009\u3000\ufeffé", k=r.randint(0, 14)))
        assert P.collapse(t) == re.sub(f"[{htmltree.WS}]+", " ", t).strip(htmltree.WS_CHARS)
        assert htmltree.collapse_ends(t) == re.sub(f"^[{htmltree.WS}]+|[{htmltree.WS}]+$", "", t)
        s = t
        for prefix in ("figure: ", "> ", "#+ ", "- "):
            s = re.sub(f"^{prefix}", "", s)
        assert t[validate._PREFIXES.match(t).end() :] == s


# -- retrieval and benchmark


def brute_bm25(texts, question):
    import math
    import re

    toks = {k: [t for t in re.findall(r"[^\W_]+", v.lower()) if len(t) > 1] for k, v in texts.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for k, t in toks.items():
        s = 0.0
        for q in dict.fromkeys(x for x in re.findall(r"[^\W_]+", question.lower()) if len(x) > 1):
            tf, df = t.count(q), sum(q in u for u in toks.values())
            if tf:
                s += math.log((len(toks) + 1) / (df + 0.5)) * 2.4 * tf / (1.4 * (0.75 * len(t) / avg + 0.25) + tf)
        out[k] = s
    return out


def test_bm25_against_brute_force(spark, docs, one):
    asked = [(1, 1, "What is the wheel made of?"), (1, 2, "zebra"), (1, 3, None), (4, 1, "section 77 paragraph")]
    q = spark.createDataFrame(asked, "page_id long, question_id long, question string")
    got = rank.bm25(rank.chunk_rows(docs), q, T.terms(rank.indexed_text())).collect()
    for p, i, text in asked:
        texts = {c.id: " ".join([c.summary, c.summary, " ".join(c.tags), " ".join(c.tags), c.text]) for c in one[p].chunks}
        want = brute_bm25(texts, text or "")
        assert {r.chunk_id: pytest.approx(r.score) for r in got if (r.page_id, r.question_id) == (p, i)} == want
    chosen = {(r.page_id, r.question_id, r["rank"]): r.chunk_id for r in rank.answer_chunks(docs, q).collect()}
    assert chosen[(1, 1, 1)] == "wheel" and chosen[(4, 1, 1)] == "s77" and (1, 2, 2) not in chosen and chosen[(1, 2, 1)] == "intro"
    hops = rank.hop_tokens(render.token_report(docs.select(*[c for c in docs.columns if c not in ("hash", "toc_mode", "header", "header_units", "md", "split", "warnings", "json")])), rank.answer_chunks(docs, q)).collect()
    assert all(r.total == r.hop1 + r.hop2 and r.hop2 > 0 for r in hops) and len(hops) == 4


def test_search_in_several_passes(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    words = "mill river dam wheel oak stone é2 grain flour a x1".split()
    texts = [(i, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(60)] + [(60, "mill dam"), (61, "mill dam"), (62, None)]
    asked = [("q1", "Mill, dam?"), ("q2", "the oak oak wheel"), ("q3", "zebra"), ("q4", None), ("q5", "grain flour stone river"), ("q6", "grain dam"), ("q6", "dam x1")]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(asked, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(queries.ORACLES["bm25_rank"]).fetchall())
    for most_asked, cells in ((1024, 1 << 18), (2, 20)):
        monkeypatch.setattr(rank, "PASS", most_asked)
        monkeypatch.setattr(rank, "CELLS", cells)
        found = queries.bm25_rank(spark, str(tmp_path))
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # terms aren't shuffled
        assert sorted(map(tuple, found.collect())) == want and len(want) == 12
    corpus, q = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    for c, a in ((corpus, q.where("false")), (corpus.where("false"), q)):
        assert rank.search(c, a, T.terms("text"), ask="item_id", question="text").count() == 0


def test_offline_benchmark(spark, docs):
    pages = spark.createDataFrame([(1, ARTICLE)], "page_id long, html string")
    q = contexts.fact_questions(docs.where("page_id = 1"))
    assert [r.question for r in q.orderBy("question_id").collect()][-1] == "What is the owner of The Old Mill & Dam?" and q.count() == 8
    made = contexts.contexts(pages, docs.where("page_id = 1").select("page_id", "md"), q)
    assert made.count() == 8 * 4
    t = contexts.trials(made.join(q, ["page_id", "question_id"]))
    s = {r.condition: r for r in contexts.trial_summary(t).where("all_articles = 1").collect()}
    assert s["two-hop"].trials == 24 and s["two-hop"].accuracy_mean >= s["llmstxt"].accuracy_mean and s["two-hop"].input_tokens_mean < s["raw-html"].input_tokens_mean
    assert contexts.run_counts(t).first().questions == 8
    known = contexts.reachable(q, docs.select("page_id", F.lit(ARTICLE).alias("html"), "md"))
    assert known.where("reachable").count() == 8
    lines = spark.createDataFrame([(0, "# c"), (1, " B "), (2, ""), (3, "A")], "ord int, value string")
    assert [r.title for r in contexts.titles(lines, 2).collect()] == ["B", "A"]
    ext = spark.createDataFrame([("q", "a", "B"), ("q", "a", "Z")], "question string, answer string, title string")
    assert contexts.external_questions(ext, contexts.titles(lines)).count() == 1
    one = spark.createDataFrame([("x" * 12,)], "c string").select(*contexts.truncated(F.col("c"), 10)).first()
    assert one[0] == "x" * 10 + "\n[truncated]" and one[1]
    keyed = t.limit(2).withColumn("key", contexts.request_key(F.lit("offline"), F.lit("s"), F.concat("question", "condition")))
    hit, miss = contexts.cached_trials(keyed, keyed.select("key").where("false"))
    assert hit.count() == 0 and miss.count() == 2


def test_answers_are_graded_run_by_run(spark):
    answers = {1: "The Mill.", 2: None, 3: "no"}
    rows = spark.createDataFrame([("c", "a", "q", "the mill", "x", False), ("c", "b", "q", None, None, False)], "condition string, article string, question string, gold string, context string, truncated boolean")
    got = contexts.trials(rows, answerer=lambda r, q, c: (answers[r], 1, r))
    assert {(x.article, x.run): (x.answer, x.output_tokens, x.correct) for x in got.collect()} == {(a, r): (v, r, {1: True, 2: None, 3: False}[r] if a == "a" else None) for a in "ab" for r, v in answers.items()}
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Cartesian" not in plan and "NestedLoop" not in plan  # a context is sent once for its runs


# -- crawl, counters, files


@pytest.mark.parametrize(
    "robots,path,ok",
    [
        ("User-agent: *\nDisallow: /private", "/private/x", False),
        ("User-agent: *\nDisallow: /private\nAllow: /private/open", "/private/open/1", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdfx", True),
        ("User-agent: *\nDisallow: /\nUser-agent: other\nUser-agent: PagestrataBot # us\nDisallow: /only", "/x", True),
        ("User-agent: *\nDisallow: /\nUser-agent: pagestrata\nDisallow: /only", "/only/x", False),
        ("User-agent: *\nDisallow:", "/x", True),
        ("", "/x", True),
        ("User-agent: *\nDisallow: /a+b(c", "/a+b(c)", False),
    ],
)
def test_robots(spark, robots, path, ok):
    rules = crawl.robots_rules(spark.createDataFrame([("h", robots)], "host string, robots string"))
    assert crawl.allowed(spark.createDataFrame([("h", "http://h.org" + path)], "host string, url string"), rules).first().allowed is ok


def test_robots_of_two_hosts_with_one_path(spark):
    rules = crawl.robots_rules(spark.createDataFrame([("h", "User-agent: *\nDisallow: /x"), ("g", "User-agent: *\nAllow: /x")], "host string, robots string"))
    urls = spark.createDataFrame([("h", "/x/1"), ("g", "/x/1"), ("f", "/x/1")], "host string, url string")
    assert {r.host: r.allowed for r in crawl.allowed(urls, rules).collect()} == {"h": False, "g": True, "f": True}


def test_admission(spark):
    cases = {"http://a.org/x": True, "https://b.c.de": True, "ftp://a.org": False, "http://localhost/x": False, "http://10.0.0.1/": False, "http://x.local/": False, "http://db.internal": False, "nonsense": False}
    rows = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string").select("url", crawl.admitted("url").alias("ok")).collect()
    assert {r.url: r.ok for r in rows} == cases | {None: False}


def test_rate_limit(spark):
    times = [0, 10, 20, 30, 59_999, 60_001, 60_011]
    assert crawl.admit_hits(times, 3)[0] == [True, True, True, False, False, True, True]
    d = spark.createDataFrame([("a", t) for t in times] + [("b", 5)], "key string, ts_ms long")
    got = {(r.key, r.ts_ms): r.admitted for r in crawl.rate_limited(d, 3).collect()}
    assert [got[("a", t)] for t in times] == crawl.admit_hits(times, 3)[0] and got[("b", 5)]


def test_savings_and_prices(spark):
    d = spark.createDataFrame([(10.9,), (-5.0,), (9e9,)], "saved double")
    assert tuple(site.savings(d).first()) == (3, 5_000_010)
    p = site.dollars_saved(spark.createDataFrame([(10_000,)], "saved long"), site.prices(spark)).where("model = 'large'").first()
    assert p.dollars == 50.0


def test_site_index_discovery_and_staleness(spark, docs):
    i = site.site_index(docs)
    assert [(r.url, r.md) for r in i.collect()] == [("https://docs.example.org/mills/old.html", "https://docs.example.org/mills/old.llm.md")]
    pages = spark.createDataFrame([("https://docs.example.org/mills/old.html",), ("http://a/b.htm?x",), ("http://c/d",)], "url string")
    links = spark.createDataFrame([("http://c/d", "/x.llm.md")], "url string, href string")
    assert sorted((r.md, r.found_by) for r in site.discover(pages, i, links).collect()) == [("/x.llm.md", "link"), ("http://a/b.llm.md", "name"), ("https://docs.example.org/mills/old.llm.md", "index")]
    assert site.stale(i.withColumn("hash", F.lit("old")), i).count() == 1 and site.stale(i, i).count() == 0


def test_files_round_trip(spark, tmp_path):
    from pagestrata import cli

    (tmp_path / "in/sub/node_modules").mkdir(parents=True)
    (tmp_path / "in/a.html").write_text(ARTICLE)
    (tmp_path / "in/sub/b.htm").write_text("<main><h1>B</h1>" + "".join(f"<h2 id=s{i}>S {i}</h2><p>Paragraph of section {i} with words.</p>" for i in range(130)) + "</main>")
    (tmp_path / "in/sub/node_modules/c.html").write_text("<p>no</p>")
    (tmp_path / "in/notes.txt").write_text("no")
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert cli.main(["generate", root, "--out", out, "--site-index", "--split", "--json"]) == 0
    assert sorted(r.rel for r in files.html_pages(spark, root).collect()) == ["a.html", "sub/b.htm"]
    assert {p.name for p in (tmp_path / "out").iterdir()} >= {"a.llm.md", "a.llm.json", "a.llm", "sub", ".well-known"}
    whole = {r.rel: r.md for r in files.split_documents_in(spark, out).collect()}
    assert whole["a"] == (tmp_path / "out/a.llm.md").read_text() and whole["sub/b"] == (tmp_path / "out/sub/b.llm.md").read_text()
    assert cli.main(["validate", str(tmp_path / "in/a.html"), str(tmp_path / "out/a.llm.md")]) == 0
    assert cli.main(["validate", str(tmp_path / "in/a.html"), str(tmp_path / "out/a.llm"), "--strict"]) == 1
    assert cli.main(["validate", str(tmp_path / "nothing")]) == 2 and cli.main(["generate", str(tmp_path / "nothing")]) == 1
    assert cli.main(["generate", root, "--quiet"]) == 0 and cli.main(["validate", root, "--json"]) == 0
    (tmp_path / "app.html").write_text("<body>" + "<script src=a.js></script>" * 5 + "</body>")
    assert cli.main(["generate", str(tmp_path / "app.html"), "--quiet"]) == 2
    assert cli.main(["rank", str(tmp_path / "in/a.html"), "What is the wheel made of?"]) == 0


def test_zip(spark):
    data = files.zip_archive({"a.md": "x", "é.md": "y" * 99})
    z = zipfile.ZipFile(BytesIO(data))
    assert z.testzip() is None and z.namelist() == ["a.md", "é.md"] and z.read("é.md") == b"y" * 99


# -- streams


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path))
    return spark.readStream.schema(schema).parquet(str(tmp_path))


def drained(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    times = [0, 10, 20, 30, 60_001]
    hits = stream(spark, tmp_path / "h", [("a", t) for t in times], "key string, ts_ms long")
    got = {r.ts_ms: r.admitted for r in drained(spark, state.rate_limited_stream(hits, 3), "append", "limited")}
    assert [got[t] for t in times] == [True, True, True, False, True]
    saved = stream(spark, tmp_path / "s", [(5.5,), (-1.0,)], "saved double")
    assert [tuple(r) for r in drained(spark, state.running_savings(saved), "complete", "saved")] == [(2, 5)]
    answers = stream(spark, tmp_path / "a", [("k", 1), ("k", 2), ("l", 3)], "key string, v int")
    assert sorted(r.key for r in drained(spark, state.first_answers(answers), "append", "first")) == ["k", "l"]
    now = stream(spark, tmp_path / "c", [("u", "h2"), ("v", "h")], "url string, hash string")
    built = spark.createDataFrame([("u", "h1"), ("v", "h")], "url string, hash string")
    assert [r.url for r in drained(spark, state.stale_stream(now, built), "append", "stale")] == ["u"]
    counters = {}
    batch = spark.createDataFrame([(7.0,)], "saved double")
    for i in (0, 0, 1):
        state.upsert_counters(counters, batch, i)
    assert counters == {"conversions": 2, "tokens_saved": 14, "last": 1}


# -- registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sf_dir, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    key = lambda r: tuple(map(cell, r))
    assert sorted(map(key, got.select(*sorted(got.columns)).collect())) == sorted(map(key, want.project(", ".join(sorted(want.columns))).fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_run(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import os

    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() == 50


# -- front


def test_api(spark):
    from pagestrata import api

    got = api.convert(spark, ARTICLE, counter=api.token_counter(lambda t: len(t.split())))
    assert got["ok"] and got["report"]["basis"] == "given counter" and got["report"]["sibling"] == len(got["md"].split())
    assert api.convert(spark, ARTICLE, format_name="other")["md"].startswith("<!-- other 0.1 -->")
    assert api.check(spark, ARTICLE, got["md"])["errors"] == 0 and api.check(spark, ARTICLE, "x")["errors"] > 0
    hop = api.two_hop(spark, ARTICLE, "How does the wheel turn?")
    assert hop["header"] == got["header"] and list(hop["chunks"])[0] == "wheel" and hop["chunks"]["wheel"] in got["md"]
    assert api.link_tag('a"b.llm.md') == '<link href="a&quot;b.llm.md" rel="alternate" type="text/llm+markdown">'
    assert spark.range(1).select(api.saved_percent(F.lit(200), F.lit(50))).first()[0] == 75.0
