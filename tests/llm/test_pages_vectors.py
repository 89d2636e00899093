"""Page, archive and vector operators against literal results and brute force."""

import numpy as np
from vinculo.llm import warc
from vinculo.llm.host_paths import best_container, extract_pages, read_page, text_of, voted_path
from vinculo.llm.mtree import TreeRules, build_tree, search_tree, top_k

PAGE = "page_id long, url string, html string, host string, path string, score double"


def page(body, host="a.example", k=0):
    return (k, f"https://{host}/{k}", body, "x", "y", 0.0)


def article(text, k=0):
    return f'<html><body><nav><a href="/">Home</a></nav><div class="post post-{k}">{text}</div><div class="box">{"filler text " * 3}</div><footer>&copy; x</footer></body></html>'


def test_furniture_goes_and_blocks_are_joined():
    source = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class="nav menu"><a href=x>Home</a></div>
    <div class="post-content"><header><h1>Title</h1><span>by X</span></header><p>First &amp;   para&nbsp;one.<p>Second <i>pa</i>ra.<div class="ad-box">Buy</div>
    <p class="notice">cookies</p><ul><li>one<li>two</ul><form><p>form</p></form><script>var a="<p>no</p>";</script></div>
    <section class="comments"><article class="comment"><p>A very long comment that is longer than the whole text of the article itself, by far.</p></article></section></body>"""
    assert text_of(read_page(source), None) == "Title First & para one. Second para. one two"


def test_nested_articles_stay_whole(spark):
    long = "A sentence of the story. " * 80
    parts = {
        "<h1>T</h1><div><p>%s</p></div>": "T %s", "<section class=intro>In short.</section><section class=story><p>%s</p></section>": "In short. %s",
        "<div><div><h2>T</h2></div><div><div class=text-body>%s</div></div></div><p>End.</p>": "T %s End.",
        "<figure><img src=x><figcaption>A caption.</figcaption></figure><p>%s<p>So <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds.": "A caption. %s So a=1 holds.",
    }
    rows, want = [], {}
    for inner, text in parts.items():
        for outer in ("<article>%s</article>", "<div id=page><main>%s</main><div class=box>Offer.</div></div>", "<div class=wrap>%s</div>"):
            source = f"<html><body><nav>menu</nav>{outer % (inner % long)}<footer>f</footer></body></html>"
            assert text_of(read_page(source), None) == text % long.strip()
            k = len(rows)
            rows.append((k, f"https://h{k}.example/", source, "h", "p", 0.0))
            want[k] = text % long.strip()
    assert {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, PAGE)).collect()} == want
    many = "<article>" + "<section><div><p>Some short part.</p></div></section>" * 30 + "</article>"
    assert text_of(read_page(f"<body>{many}<div class=box>{'filler text ' * 9}</div></body>"), None) == " ".join(["Some short part."] * 30)


def test_unclosed_and_bare_pages():
    assert text_of(read_page("plain <b>text"), None) == "plain text"
    assert text_of(read_page(""), None) == ""
    assert text_of(read_page("<nav>menu<article><p>hello there</article>"), None) == "hello there"
    assert text_of(read_page("<div>" * 3000 + "deep" + "</div>" * 10), None) == "deep"
    assert best_container(read_page("no container")) == -1


def test_a_host_agrees_on_a_path(spark):
    long = "A sentence of the article, long enough to be found. " * 4
    rows = [page(article(f"<p>{long}{k}</p>", k), k=k) for k in range(6)]
    # On its own this page would choose the box, its host's pages choose the post.
    odd = '<html><body><div class="post post-9"><p>Short note.</p></div><div class="box"><p>' + "Offers and more offers today. " * 9 + "</p></div></body></html>"
    rows += [page(odd, k=9), page(odd, host="b.example", k=10), (11, None, None, None, None, None), (12, "nonsense", "", None, None, None), rows[0], (None, "https://a.example/", article("<p>x</p>"), None, None, None)]
    found = sorted(extract_pages(spark.createDataFrame(rows, PAGE)).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert texts[9] == "Short note." and texts[10].startswith("Offers") and texts[11] == texts[12] == "" and texts[None] == "x"
    assert texts[3] == (long + "3").strip() and all(r.n_chars == len(r.text) for r in found)
    assert extract_pages(spark.createDataFrame([], PAGE)).collect() == []


def read_warc(data):
    """Plain reading of WARC bytes: (fields, block) of each record."""
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        assert data[n : n + 4] == b"\r\n\r\n"
        out.append((fields, data[:n]))
        data = data[n + 4 :]
    return out


def test_derivatives_are_linked_and_read_back(spark):
    html = '<html lang="en"><head><title>T &amp; T</title><style>x{}</style></head><body><p>One<br>two &eacute;</p><a href="/x?a=1&amp;b=2">l</a></body></html>'
    pages = spark.createDataFrame([(1, "https://a.example/", html, "h", "p", 0.0), (2, None, None, None, None, None), (3, "https://b.example/", "<p>" + "long " * 50_000, "h", "p", 0.0)], PAGE)
    responses = warc.responses_of_pages(pages)
    sources = {r.record_id: r for r in responses.collect()}
    assert len(sources) == 3
    rows = warc.record_bytes(warc.derivatives(responses)).collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 6
    for r in rows:
        ((fields, block),) = read_warc(bytes(r.warc))
        source = sources[fields["WARC-Refers-To"]]
        payload = bytes(source.block).partition(b"\r\n\r\n")[2]
        assert warc.digest(block) == fields["WARC-Block-Digest"] == r.block_digest
        assert warc.digest(payload) == r.payload_digest == source.headers["WARC-Payload-Digest"] == r.headers["Source-Payload-Digest"]
        assert source.headers["WARC-Block-Digest"] == warc.digest(bytes(source.block))
        assert fields.get("WARC-Target-URI", "") == (source.target_uri or "")
    texts = {(r.record_type, r.target_uri): r.block for r in rows}
    assert texts["conversion", "https://a.example/"] == "One\ntwo é\nl" and texts["conversion", ""] == ""
    assert "title: T & T\r\n" in texts["metadata", "https://a.example/"] and "outlink: /x?a=1&b=2\r\n" in texts["metadata", "https://a.example/"]
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "u", "d", {"WARC-Type": "response"}, bytearray(b"no http \xff"))], "record_id string, target_uri string, date string, headers map<string,string>, block binary")
    made = warc.derivatives(odd).collect()
    assert len(made) == 4 and all(r.refers_to for r in made) and {r.block for r in made if r.record_type == "conversion"} == {"", "no http �"}
    assert warc.derivatives(odd.limit(0)).collect() == []


def test_repeated_header_fields_are_all_kept():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nVia: x\r\nset-cookie: b=2; Path=/\r\nVia: y\r\nContent-Type: text/html\r\n\r\n<p>One"
    for record in warc.derive("<r>", "u", "d", {}, block):
        headers = dict(record["headers"])
        assert headers["Source-HTTP-set-cookie"] == "a=1, b=2; Path=/" and headers["Source-HTTP-via"] == "x, y" and headers["Source-HTTP-content-type"] == "text/html"


def test_a_head_without_its_end_tag_ends_where_the_page_starts():
    head = '<!DOCTYPE html><html><head lang=en><meta charset=utf-8><title>T</title><link rel=x href=y><!-- c --><style>p{}</style><script>var a="<p>";</script>'
    for start in ("", "</head>", "</head><body>", "<body class=x>", "</HEAD ><header>h</header>"):
        assert warc.plain_text(f"{head}\n{start}<p>One<p>two</html>").split("\n")[-2:] == ["One", "two"]
        assert warc.plain_text(f"{head}\n{start}<p>One").removeprefix("h\n") == "One"
    assert warc.plain_text(head + "bare text") == "bare text"
    assert warc.plain_text("<head><title>T<body><p>One") == warc.plain_text("<head><script>x</head><p>One") == "One"
    assert warc.plain_text("<header>h</header><p>One") == "h\nOne"
    assert warc.plain_text("<head>" + "<title>x" * 2000) == ""


def plain_top(vectors, k):
    x = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in vectors.items()}
    out = {}
    for q in x:
        if q % 20 == 0:
            scores = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = {i: [float(np.float32(v)) for v in rng.normal(size=8)] for i in range(300)}
    vectors |= {i: vectors[3] for i in range(300, 420)}
    vectors |= {i: [10 * v for v in vectors[5]] for i in range(420, 424)}
    rows = [(i, v, 1, 1, 0, 0) for i, v in vectors.items()]
    rows += [(1000, None, 1, 1, 0, 0), (1020, [1.0] * 7 + [None], 1, 1, 0, 0), (1040, [float("nan")] * 8, 1, 1, 0, 0), (1060, [float("inf")] * 8, 1, 1, 0, 0), (None, [1.0] * 8, 1, 1, 0, 0), (1080, [], 1, 1, 0, 0), rows[0], rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard int, node int, query_id int")
    want = plain_top(vectors, 20)
    for rules in (TreeRules(), TreeRules(page=4, shard=50, block=7, sample=30, per_route=40)):
        found = {}
        for r in sorted(top_k(frame, rules=rules).collect(), key=lambda r: (r.query_id, r.rank)):
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert found == want
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(few).collect())) == [(0, 1, 20, 64 * 32 + 128 * 32), (20, 1, 0, 64 * 32 + 128 * 32)]
    assert top_k(frame.limit(0)).collect() == []


def test_bounds_spare_distances():
    """On clustered vectors the tree computes a small part of all scores, and misses none."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6)) * 1000
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6)) * 20)
    norm = (x * x).sum(1)
    lifted = np.concatenate([x, np.sqrt(norm.max() - norm)[:, None]], axis=1)
    nodes = build_tree(lifted, 64)
    for node in nodes:
        node["route"] = lifted[node["route"]].tobytes()
        node["ids"], node["vectors"] = (None, None) if node["rows"] is None else (node["rows"], x[node["rows"]])
    q, visits = x[:50], []
    owner, score, ids = search_tree(nodes, q, np.arange(50), np.full(50, -np.inf), float(norm.max()), 10, visits)
    for k in range(50):
        s = x @ q[k]
        s[k] = -np.inf
        assert ids[owner == k].tolist() == np.lexsort((np.arange(4000), -s))[:10].tolist()
    assert sum(visits) < 0.5 * 50 * 4000


def test_headings_attributes_and_neighbours_of_the_article():
    long = "A sentence of the article that is long enough to be a paragraph of its own, as articles have."
    cases = {
        f'<body><article><section title="hidden treasures"><p>{long}</p></section><p>x <a title="hidden gem">gem</a></p></article>': f"{long} x gem",
        f'<article><div data-role="navigation"><p>{long}</p></div></article>': long,
        f'<article><div class="post-header"><h1>Title</h1><p>by me</p></div><p>{long}</p></article>': f"Title {long}",
        f'<body><h1>Title</h1><div class=content><p>{long}</p></div>': f"Title {long}",
        f'<body><h1>Site</h1><article><h1>Title</h1><p>{long}</p></article>': f"Title {long}",
        f"<body><div class=intro><p>{long}</p></div><div class=story><p>{long * 9}</p></div><div class=nav><p>{long}</p></div><div>short</div>": f"{long} {long * 9}",
        f'<article><h2 class="header">Part</h2><p>{long}</p><p class="share">to share</p><p class="ad">buy</p></article>': f"Part {long} to share",
        f'<article><div style="Display: none"><p>{long}</p></div><p>shown</p></article>': "shown",
        f'<body><div class="a>b"><p>{long}</p></div>': long,
    }
    for source, text in cases.items():
        page = read_page(source)
        assert text_of(page, None) == text, source
        assert text_of(page, voted_path(page, best_container(page))) == text, source


def test_deep_nesting_takes_linear_work():
    import time
    import tracemalloc

    for junk in ("", "</table>", "<article>", "<header>"):
        source = "<body>" + ("<div class=box>" + junk) * 40_000 + "deep text"
        tracemalloc.start()
        begin = time.monotonic()
        page = read_page(source)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert time.monotonic() - begin < 30 and peak < 400 * len(source), junk
        assert page.blocks == [] if junk == "<header>" else "deep text" in text_of(page, None)


def test_vectors_meet_their_own_dimension(spark):
    rng = np.random.default_rng(6)
    dims = {i: (3, 5, 8)[i % 3] for i in range(240)}
    vectors = {i: [float(np.float32(v)) for v in rng.normal(size=d)] for i, d in dims.items()}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    found = {}
    for r in sorted(top_k(frame).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {}
    for d in (3, 5, 8):
        want |= plain_top({i: v for i, v in vectors.items() if dims[i] == d}, 20)
    assert found == want


def test_charsets_that_cannot_be_read_end_no_run():
    for charset in ("idna", "undefined", "no-such-charset", "base64"):
        text = warc.decode_payload({"content-type": f"text/html; charset={charset}"}, b"<p>a..b \xff text")
        assert text == "<p>a..b � text"
