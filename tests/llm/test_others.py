"""Operators on vectors, pages, conversations and archives; queries against their SQL."""

import gzip
import hashlib
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vdomain.llm import chat, flatgraph, hamming, html, queries, vectors, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    want = Counter(map(repr, rel.project(", ".join(df.columns)).fetchall()))
    assert Counter(repr(tuple(r)) for r in df.collect()) == want


# --- vectors ------------------------------------------------------------------------------------------


def vector_rows(n=260, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    for k in range(0, n, 3):  # near copies, some just around the threshold
        x[k] = x[(k * 7) % n] + rng.standard_normal(16) * rng.choice([0.01, 0.2, 0.4, 0.45])
    rows = [(int(3 * k + 5), [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    rows += [(2000 + k, rows[0][1]) for k in range(40)]  # exact copies
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [float("inf")] + [1.0] * 15), (3005, [None] + [1.0] * 15), (3006, [1.0] * 8), (3007, [2.0] * 8), (3008, [c * 1e30 for c in rows[1][1]]), (None, rows[2][1]), rows[4]]
    return rows


def brute_vectors(rows):
    good = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(np.array(rows[k][1]) / np.abs(rows[k][1]).max()) / np.abs(rows[k][1]).max() for k in good}
    near = {k: [j for j in good if len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.9 and j != k] for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        group, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in group:
                    group.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((i, len(near.get(k, [])), low))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicate_vectors(spark, monkeypatch, small):
    if small:  # many shards, several blocks of members and queries to each
        monkeypatch.setattr(vectors, "SHARD", 40)
        monkeypatch.setattr(vectors, "MEMBERS", 30)
        monkeypatch.setattr(vectors, "QUERIES", 50)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("own")).withColumn("n", F.lit(1)).repartition(3)
    got = [(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()]
    want = brute_vectors(rows)
    assert len(got) == len(want)
    agree = sum((Counter(got) & Counter(want)).values())
    assert agree >= 0.97 * len(want) if small else agree == len(want)
    by = {g[0]: g for g in got}
    for i in (*range(2000, 2040), *range(3000, 3008)):
        assert by[i] == next(w for w in want if w[0] == i)


def test_vectors_of_one_direction(spark):
    """Hundreds of vectors that differ in length, or in their last digits, find each other."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(24)
    rows = [(k, [float(c) for c in np.float32(base * (1 + k))]) for k in range(300)] + [(1000 + k, [float(c) for c in base + 1e-6 * rng.standard_normal(24)]) for k in range(300)] + [(2000 + k, [float(c) for c in rng.standard_normal(24)]) for k in range(200)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(brute_vectors(rows))


def test_audit_tells_what_is_missing(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((40, 16)), 5, 0) + 0.02 * rng.standard_normal((200, 16))
    nodes = spark.createDataFrame([(k, v.tobytes(), 1) for k, v in enumerate(x)], "key long, vec binary, n long")
    found = spark.createDataFrame([(k, 4, int(np.bitwise_xor.reduce(vectors._marks(np.array([j for j in range(k // 5 * 5, k // 5 * 5 + 5) if j != k]))).view(np.int64)), k) for k in range(200)], "key long, links long, mark long, other long")
    assert vectors.audit(nodes, found, 0.9)[0] == 1.0
    assert vectors.audit(nodes, found.where("key >= 100"), 0.9)[0] < 0.9
    assert vectors.audit(nodes, found.withColumn("mark", F.col("mark") + 1), 0.9)[0] == 0.0
    assert vectors.audit(nodes.where("key % 5 = 0"), found.where("false"), 0.9) == (None, 0)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = vectors.near_duplicates(spark.createDataFrame([(4, [1.0, 2.0])], "vec_id long, embedding array<float>")).first()
    assert tuple(one) == (4, 0, 4, True)


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.standard_normal((600, 32)), np.repeat(rng.standard_normal((10, 32)), 30, 0) + 0.2 * rng.standard_normal((300, 32))))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    adj, leader = flatgraph.build(x)
    assert (leader < 0).all()
    assert ((adj >= -1) & (adj < len(x))).all()
    _, _, found = flatgraph.search(x, adj, flatgraph.medoids(x), x, 24, 0.9)
    true = {tuple(p) for p in np.argwhere(x @ x.T >= 0.9)}
    assert len({tuple(p) for p in found} & true) >= 0.97 * len(true) and {tuple(p) for p in found} <= {tuple(p) for p in np.argwhere(x @ x.T >= 0.899)}


# --- Hamming ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "most"), [(0, 30_000), (3, 30_000), (400, 30_000), (400, 40)])
def test_hamming_top_k(spark, monkeypatch, n, most):
    if most == 40:  # wide segments, whose larger rings give way to those of four segments
        monkeypatch.setattr(hamming, "segments_of", lambda _: [(0, 22), (22, 21), (43, 21)])
    monkeypatch.setattr(hamming, "MOST_MASKS", 30_000 if most > 40 else 15_000)
    rng = np.random.default_rng(n)
    codes = rng.integers(-(2**63), 2**63 - 1, n).tolist()
    rows = [(k, codes[k // 3 if k % 10 == 0 else k] ^ (7 if k % 6 == 0 else 0)) for k in range(n)] + [(9000, None)]
    rows += [(9001 + k, codes[0]) for k in range(15)] if n else []
    df = spark.createDataFrame(rows, "id long, code long")
    got = Counter(map(tuple, hamming.top_k(df, df.where("id % 50 = 0"), 10).collect()))
    want = Counter()
    for q, c in rows:
        if q % 50 == 0 and c is not None:
            near = sorted((((c ^ d) & (2**64 - 1)).bit_count(), i) for i, d in rows if d is not None)[:10]
            want.update((q, k + 1, i, d) for k, (d, i) in enumerate(near))
    assert got == want


def test_hamming_keys_stay_off_the_driver(spark, monkeypatch):
    """Few queries ask for millions of keys: neither these nor the masks in the plan may pass the driver."""
    plans, table = [], hamming.Scratch.table

    def spied(self, df, *replaces):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, *replaces)

    monkeypatch.setattr(hamming.Scratch, "table", spied)
    rows = [(k, int(c)) for k, c in enumerate(np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 300))]
    df = spark.createDataFrame(rows, "id long, code long")
    assert hamming.top_k(df, df.where("id % 50 = 0"), 10).count() == 60
    assert any("SortMergeJoin [seg" in p for p in plans)
    assert not any("BroadcastHashJoin [seg" in p or "[1,2,4,8,16" in p for p in plans)


def test_sign_code(spark):
    rows = [([1.0, -1.0, 0.0, None, 2.0],), (None,), ([],)]
    assert [r[0] for r in spark.createDataFrame(rows, "embedding array<double>").select(hamming.sign_code()).collect()] == [17, None, 0]


# --- pages --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def weights():
    return html.train()


def test_best_span_is_the_best():
    rng = random.Random(0)
    for _ in range(200):
        s = [rng.randint(-5, 4) for _ in range(rng.randint(0, 12))]
        lo, hi = html.best_span(s)
        assert sum(s[lo:hi]) == max([0, *(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))])


def test_made_pages_held_out(weights):
    """Pages of other random layouts than those trained on: nearly all of the main text, nearly nothing else."""
    rng = random.Random(4242)
    good = 0
    for _ in range(150):
        page = html.labelled_page(rng)
        want, rest = Counter(), Counter()
        for r in html.parse(page).runs:
            if r.text is not None:
                (want if r.label else rest).update(r.text.split())
        got = Counter(html.main_text(page, weights).split())
        good += sum((got & want).values()) >= 0.95 * sum(want.values()) and sum(got.values()) <= 1.1 * sum(want.values()) + 3
    assert good >= 0.9 * 150


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy now &amp; here</div>
<article><h1>Tea &amp; cake</h1><p><b>First  line<br>second<p>Third &lt;p&gt; &#233;<div class='advert-box'>Buy</div><form><button>Send</button></form><p>Last.</p></article>
<div id="comments"><p>I like this very much indeed and so on</p></div><footer>&copy; me</footer></body>"""


def test_main_text(weights):
    assert html.main_text(PAGE, weights) == "Tea & cake\n\nFirst line second\n\nThird <p> é\n\nLast."


TEA = "<p>" + "A paragraph that says quite a few things about tea and cake. " * 5 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='post more'>{TEA}</div>", f"<article class='tags news'>{TEA}</article>", f"<div class='links-article'>{TEA}</div>", f"<body class='has-sidebar no-search'><nav><a href=/>x y</a></nav>{TEA}<footer>c</footer></body>",
        f"<div id='comments-enabled'>{TEA}<div class='comments'><p>I like it so much</p></div></div>", f"<nav><a href=/>x</a></nav><form id=aspnet><table><tr><td>{TEA}</td></tr></table></form>", f"<div><div><div>{TEA}</div></div></div><div class=sidebar><div class=content>more tea</div></div>",
        f"<main class='privacy-policy'>{TEA}</main><div class='cookie-banner'><p>We use cookies</p></div>", f"<article><div class='{'x ' * 200}'>{TEA}</div></article>",
    ],
)
def test_wrappers_that_name_other_parts(weights, page):
    assert html.main_text(page, weights) == " ".join(TEA[3:-4].split())


def test_words_without_spaces(weights):
    text = "文章的内容没有空格所以一段只是一个词" * 40
    page = f"<body><div><a href=/>首页</a> <a href=/b>关于我们</a></div><div>{text}<br>{text}</div><div class=footer>版权所有</div></body>"
    assert html.main_text(page, weights) == f"{text} {text}"


@pytest.mark.parametrize("part", ["<a ", "<div class=c>", '<a "', "<b><p><h1>x</h1>", "<!--", "<script ", "<a '\">", "<li><p>", "</x>", "<p><a href='", "<b><i>" * 20 + "</u>", "&amp", "<!x"])
def test_pages_are_read_in_linear_time(weights, part):
    n = 200_000
    start = time.process_time()
    html.main_text(part * (n // len(part)), weights)
    assert time.process_time() - start < 5


@pytest.mark.parametrize("page", ["", "<", "<!--", "<script>x", "<nav>a b c</nav>", "<p", "</p></p>", "<a href='x>y", "&", "\x00<b>"])
def test_broken_pages(weights, page):
    assert isinstance(html.main_text(page, weights), str)


def test_extract(spark, weights):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (4, "w", "plain words only"), (5, "l", "<article><p>" + "word " * 50_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("x", F.lit(1))
    out = {r.page_id: r for r in html.extract(df, weights=weights).collect()}
    assert len(out) == 5 and html.extract(df, weights=weights).count() == 6
    assert (out[2].text, out[2].n_chars, out[3].text) == ("", 0, "") and out[4].text == "plain words only" and out[5].n_chars == 249_999 and out[1].x == 1
    assert html.extract(df.where("false"), weights=weights).count() == 0


def test_article_pages_of_the_table(spark):
    """Every page of the table has its article marked: the text is the article's blocks."""
    import html as entities
    import re

    for r in queries.QUERIES["op4_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- chat ---------------------------------------------------------------------------------------------

HARD = st.lists(st.sampled_from(["<", "[", "\\", "|", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "a", "\n", "<|end|>", "<|image|>", "<|text|>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(HARD, HARD)
def test_turns_read_back(role, text):
    segment = chat.format_turn(role, [{"type": "text", "text": text}])[0]
    assert chat.read_turn(segment) == (role, text)
    body = segment[len(chat.START) : -len(chat.END)]
    assert body.count("<|") == 1
    assert not any(c in chat.escape(text) for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<|"))


def test_parts_are_flattened_in_order():
    parts = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|end|> "}, {"type": "image", "uri": "i.png", "width": 57, "height": 28}, None, {"type": "audio", "uri": "a.wav", "seconds": 2.5}, {"type": "document", "uri": "d.pdf", "pages": 2}, {"type": "text", "text": None}]
    segment, lo, hi, attached, tokens = chat.format_turn("assistant", parts)
    assert segment[lo:hi] == "see <\\|end|> <|image|><|audio|><|document|>"
    assert [(a["position"], a["type"], a["uri"], a["tokens"]) for a in attached] == [(0, "image", "i.png", 3), (1, "audio", "a.wav", 63), (2, "document", "d.pdf", 1200)] and tokens == 1266
    segment, _, _, attached, tokens = chat.format_turn("user", [{"type": "video", "uri": "v.mp4"}, {"type": "poll", "text": "a<|b"}, {"type": "segment"}])
    assert segment == "<|start|>user<|text|><|other|>a<\\|b<|other|><|end|>\n" and tokens == 2 and attached[0] == {"position": 0, "type": "other", "uri": "v.mp4", "tokens": 1}
    assert chat.read_turn(segment) == ("user", "a<|b")
    assert chat.format_turn(None, None)[:3] == ("<|start|><|text|><|end|>\n", 0, 0)


def test_chat_query(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a<|x"), (2, None, None, None), (2, 0, "assistant", None), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (3, 0, "user", "t"), (3, 0, "user", "t"), (4, 0, "assistant", "w " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("own")).repartition(3)
    out = {r.conv_id: r for r in chat.query(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(out) == {1, 2, 3, 4, None, -1}
    assert (out[1].n_turns, out[1].turns_sha256, out[1].loss_chars, out[1].loss_sha256) == (2, sha("user\na<|x\nassistant\nb\n"), 1, sha("b"))
    assert out[2].turns_sha256 == sha("\n\nassistant\n\n") and out[2].loss_sha256 == sha("") and out[None].loss_sha256 == sha("m")
    assert out[3].n_turns == 2 and out[4].loss_chars == 80_000
    assert out[-1].turns_sha256 == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n") and out[-1].loss_chars == 21
    assert chat.digests(chat.format_turns(df.where("false").select("conv_id", "turn", "role", chat.text_parts().alias("parts")))).count() == 0


# --- archives -----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    records = [{"record_id": f"<urn:{k}>", "type": "response", "url": f"http://x/{k}", "date": "2024-01-01T00:00:00Z", "status": 200, "headers": {"etag": f'"{k}"', "content-type": "text/html"}, "body": b"\r\n\r\nbody" * k} for k in range(5)]
    data = warc.serialize(records)
    assert list(warc.parse(data)) == records
    assert list(warc.parse(data[:-30])) == [*records[:4], warc.DAMAGED] and list(warc.parse(b"")) == [] and list(warc.parse(b"junk")) == [warc.DAMAGED]
    plain = b"".join(gzip.decompress(warc.serialize([r])) for r in records)
    assert list(warc.parse(plain)) == records and list(warc.parse(gzip.compress(plain))) == records
    assert list(warc.parse(plain.replace(b"Content-Length", b"Content-Xength", 1)))[1:] == [*records[1:]]
    # a damaged member, and junk between records: the others are read
    at = [len(warc.serialize(records[:k])) for k in range(6)]
    broken = data[: at[2] + 20] + b"\xff\xfe\xfd" * 5 + data[at[2] + 35 :]
    assert [r for r in warc.parse(broken) if r["type"] != "damaged"] == records[:2] + records[3:]
    big = [records[0] | {"body": b"x" * 5_000_000}, records[1]]
    assert list(warc.parse(warc.serialize(big))) == big
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("url").collect()
    assert [(r.url, r.status, r.headers["etag"], bytes(r.body)) for r in got] == [(x["url"], 200, x["headers"]["etag"], x["body"]) for x in records]


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#top", "https://example.com/a?a=1&b=2", "https://example.com/a/", "http://example.com", "not a url", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.canonical_url()).collect()]
    assert got == ["example.com/a?a=1&b=2", "example.com/a?a=1&b=2", "example.com/a", "example.com", "", None, ""]


def brute_revisits(rows):
    out = []
    for i, url, ts, kind, status, h in rows:
        if kind != "revisit" or status != 304:
            continue
        was = [r for r in rows if r[3] == "response" and r[4] == 200 and r[1] == url and url is not None and ts is not None and r[2] is not None and r[2] < ts]
        if not was:
            out.append((i, "missing", None, None))
            continue
        w = max(was, key=lambda r: (r[2], r[0]))
        strip = lambda t: t.removeprefix("W/") if t else t
        a, b = (strip(h.get("etag")), strip(w[5].get("etag")))
        same = a == b if a and b else (h["last-modified"] == w[5]["last-modified"] if h.get("last-modified") and w[5].get("last-modified") else None)
        state = "unvalidated" if same is None else "resolved" if same else "changed"
        new = {k: v for k, v in h.items() if k not in warc.KEPT}
        out.append((i, state, w[0], w[5] | new if same else None))
    return out


@pytest.mark.parametrize("stretch", [10, 86_400])
def test_revisits(spark, stretch):
    rng = random.Random(stretch)
    rows = []
    for k in range(300):
        url = None if k % 50 == 49 else f"http://h/{rng.choice('aaaaab')}"
        ts = None if k % 60 == 59 else rng.randint(0, 120)
        h = {"etag": rng.choice(["x", "W/x", "y"])} if k % 3 else {"last-modified": rng.choice("pq")} if k % 4 else {}
        h |= {"content-length": str(k), "date": str(k)}
        rows.append((k, url, ts, *(("response", 200) if k % 2 else ("revisit", 304)), h))
    rows += [(900, "http://h/a", 5, "revisit", 200, {}), (901, "http://h/a", 1, "response", 404, {})]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, type string, status int, headers map<string,string>").withColumn("at", F.lit("own")).repartition(4)
    show = lambda h: None if h is None else tuple(sorted(h.items()))
    got = Counter((r.record_id, r.outcome, r.response_id, show(r.headers)) for r in warc.resolve(df, stretch).collect())
    assert got == Counter((i, s, w, show(h)) for i, s, w, h in brute_revisits(rows))
    assert warc.resolve(df.where("false")).count() == 0
