"""Pages, audio, inner products, chats, shards and the pipeline."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colmeta.llm import audio, html_text, inner_products, sharding, tool_calls
from colmeta.llm.queries import QUERIES


def _page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


LONG = "A sentence that is long enough to be the text of an article, as articles have. " * 3


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<nav><a href='x'>Menu</a></nav><article><h1>Head</h1><p>One <b>two</b>\n three.<p>Short.</article><footer>f</footer>", ["Head", "One two three.", "Short."]),
        ("<article><p>A &amp; B &lt;i&gt; &eacute;&#8217;&nbsp;x</p><div class='ad'>Buy</div><p>C</p><aside>s</aside><script>var a='</p>';</script><p>D</p></article>", ["A & B <i> é’ x", "C", "D"]),
        ("<main><p>X</p><section id='comments'><article class='comment'><p>nice</p></article></section><form><p>mail</p><input></form></main>", ["X"]),
        (f"<div class='cookie-notice'>We use cookies</div><div id='header'><a href='/'>Home</a></div><div><p>{LONG}</p><p>End.</p></div><div class='sidebar'>{LONG}</div>", [LONG.strip(), "End."]),
        ("<article><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table><pre>x\n  y</pre></article>", ["one", "two", "a b", "x y"]),
        ("<article><p>a<br>b<!-- <p>no</p> --></p><p title=\"x>y\">c</p><p hidden>d</p><p class='advert'>e <b>f</b> g</p><ul><li>h<li class='ad'>i<li>j</ul></article>", ["a b", "c", "h", "j"]),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>t</p></article>", ["Title", "t"]),
        (f"<div class='page with-sidebar'><div class='content'><div class='post-header'><h1>H</h1></div><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div></div>", ["H", LONG.strip()]),
        (f"<div class='widget'><p>{LONG}</p></div><nav>n</nav>", [LONG.strip()]),
        ("<p>tiny</p>", ["tiny"]),
        ("<p>A short main text of a page.</p>", ["A short main text of a page."]),
        ("<article><section id='search-trees'><h2 id='comments-on-theory'>H</h2><p class='legal'>B</p></section><p>Let <math><mi>x</mi><annotation>x</annotation></math> be</p></article>", ["H", "B", "Let x be"]),
        ("<div><p>Let <math>x</math> be</p></div>", ["Let x be"]),
        ("", []),
    ],
)
def test_main_text(body, want):
    assert html_text.main_blocks(_page(body)) == want


def test_pages_that_name_no_article():
    text = LONG.strip()
    for body, want in (
        (f"<div><p>{LONG}</p></div><div><div><p>Short end.</p></div></div>", [text, "Short end."]),
        (f"<div><blockquote>{LONG}</blockquote><ul><li>one</li><li>two</li></ul></div>", [text, "one", "two"]),
        (f"<div><h1>Head</h1><div><div><p>{LONG}</p></div></div></div>", ["Head", text]),
        (f"<div><h1>Head</h1><p>By X.</p><p>May 1</p><p>Hm.</p><p>{LONG}</p></div>", ["Head", "By X.", "May 1", "Hm.", text]),
        (f"<div><p>{LONG}</p><nav><p>a</p><p>b</p><p>c</p></nav><p>Between.</p><p>{LONG}</p></div>", [text, "Between.", text]),
        ("<nav><p>Menu</p></nav><div><h1>News</h1><p>A short note.</p></div><footer>f</footer>", ["News", "A short note."]),
        (f"<div class='widget'><p>{LONG}</p></div><p>Hello there you</p>", [text, "Hello there you"]),
    ):
        assert html_text.main_blocks(_page(body)) == want


def test_windows_overrule_the_name_of_a_teaser():
    text = LONG.strip()
    card = "<article><h2>Card</h2><p>Tease.</p></article>"
    assert html_text.main_blocks(_page(f"<div><h1>Head</h1><p>{LONG}</p><p>End.</p></div>{card}")) == ["Head", text, "End.", "Card", "Tease."]
    assert html_text.main_blocks(_page(f"<article><p>{LONG}</p></article><div><p>{LONG}</p></div>")) == [text]


def test_article_parts_that_sound_like_asides():
    slugs = ("discussion", "results-and-discussion", "related-work", "search-algorithms", "legal-framework", "a-brief-history-of-social-media", "comments")
    for slug in slugs:
        assert html_text.main_blocks(_page(f"<article><p>A</p><h2 id='{slug}'>H</h2><p id='{slug}'>B</p></article>")) == ["A", "H", "B"]
        assert html_text.main_blocks(_page(f"<div><p>{LONG}</p><h2 id='{slug}'>H</h2><p>B</p></div>")) == [LONG.strip(), "H", "B"]
    for slug in slugs[:-1]:
        assert html_text.main_blocks(_page(f"<article><p>A</p><section id='{slug}'><h2>H</h2><p>B</p></section></article>")) == ["A", "H", "B"]
    body = "<article><p>A</p><div class='notice'><p>N</p></div><div class='share'><p><a href='x'>Tweet</a></p></div><div class='related-posts'><p>R</p></div><div class='ad'>Buy</div></article>"
    assert html_text.main_blocks(_page(body)) == ["A", "N"]


def test_cut_pages():
    assert html_text.main_text("<article><p>a</p><p>b &am") == "a\n\nb &am"
    assert html_text.main_text("<article><p>a</p><p>b <a href='x") == "a\n\nb"
    assert html_text.main_text(None) == ""
    assert html_text.main_text("<" * 3000) is not None


@pytest.mark.parametrize("unit", ["<a ", "<a x=\"", "<a 'x\">", "<div>", "<li>", "<ul><li>", "</section><div>", "<!", "<!-- ", "<script>", "&", "<p x='", "</", "<b>x"])
def test_hostile_pages_take_linear_time(unit):
    import time

    began = time.process_time()
    html_text.main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 20


@pytest.mark.parametrize("many", [10, 1000, 3000, 300_000])
def test_quoted_values_of_any_length_stay_in_their_tag(many):
    for page in ('<p title="%s">c</p>' % ("a>" * many), "<p title = '%s'>c</p>" % ("a>" * many), '<p data=don\'t title="%s">c</p>' % ("a'>" * many)):
        assert html_text.main_text(page) == "c"


@pytest.mark.parametrize("unit", ['<a b="', "<a b='", '<a b=">', '<a b="\' c=\'"', '<a "b>', "<a b= \t", '<a b="c" '])
def test_quotes_without_an_end_take_linear_time(unit):
    import time

    began = time.process_time()
    html_text.main_text(unit * (1_000_000 // len(unit)) + "'")
    assert time.process_time() - began < 20


def test_windows_alone_find_unnamed_articles(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(bare) == html_text.main_text(r.html)


def test_pages(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op1_line_block_text"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html_text.extracted(odd).collect()) == [("", 0)] * 3
    assert html_text.extracted(odd.where("false")).count() == 0


def test_audio(spark, odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect()]
    media = audio.audio(odd_docs)
    want = []
    for t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload) + 44))
    got = audio.digests(media).collect()
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in got) == sorted(want)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
    for r in media.collect():
        t = audio.read_tensors(r.tensors)
        assert t.schema.field("log_mel").type.shape == [audio.TENSOR, audio.BANDS]
        assert t.column(0)[0].as_py() == 0
        assert t.column(1)[-1].as_py() == (len(r.media) - 44) * 1000 // audio.RATE
        for s in r.segments:
            assert 0 <= s.start_ms < s.end_ms <= t.column(1)[-1].as_py()
    assert audio.digests(audio.audio(no_docs)).count() == 0


def test_audio_parts():
    rng = np.random.default_rng(0)
    a, b = (bytes(rng.integers(0, 256, 576 * n, dtype=np.uint8)) for n in (1, 5))
    alone, together = audio.log_mel([b])[0], audio.log_mel([a, b, a])[0]
    assert np.allclose(alone, together[5:34])
    x = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    y = audio._resampled(x)
    assert len(y) == 6000
    assert np.argmax(np.abs(np.fft.rfft(y))) == 440
    e = np.array([0, 0, 5, 1, 1, 0, 0, 5, 5, 0.0])
    on = audio.loud(e, np.array([0, 10]))
    assert on.tolist() == [False, False, True, True, True, False, False, True, True, False]


def _plain_features(payload):
    """Energy and bands of a payload's frames, sample by sample."""
    x = [(b - 128.0) / 128.0 for b in payload]
    n, taps, up, down = len(x), audio.TAPS, audio.UP, audio.DOWN
    total = taps * up
    t = np.arange(total) - (total - 1) / 2
    h = np.sinc(t / down) * np.hanning(total + 2)[1:-1]
    h = h / h.sum() * up
    # zeros between the samples, the low-pass, every fourth value
    y = [sum(h[k] * x[(m * down - k) // up] for k in range(total) if (m * down - k) % up == 0 and 0 <= (m * down - k) // up < n) for m in range(n * up // down)]
    bands, energy = [], []
    for f in range(0, len(y) - 2 * audio.HOP + 1, audio.HOP):
        frame = np.array(y[f : f + 2 * audio.HOP]) * np.hanning(2 * audio.HOP)
        k = np.arange(audio.HOP + 1)[:, None] * np.arange(2 * audio.HOP)
        power = np.abs((frame * np.exp(-2j * np.pi * k / (2 * audio.HOP))).sum(axis=1)) ** 2
        bands.append([np.log(sum(p * w for p, w in zip(power, audio.MEL[:, b], strict=True)) + 1e-6) for b in range(audio.BANDS)])
        energy.append(10 * np.log10(power.sum() + 1e-6))
    return np.array(bands), np.array(energy)


def _plain_loud(energy):
    on, out = False, []
    high, low = energy.mean() + audio.ON * energy.std() + audio.LEVEL, energy.mean() - audio.OFF * energy.std() - audio.LEVEL
    for e in energy:
        on = e > high or (on and e >= low)
        out.append(on)
    return out


def test_audio_against_plain_loops():
    rng = np.random.default_rng(8)
    payloads = [audio.padded(t) for t in (b"", b"some words of a text " * 40, bytes(rng.integers(0, 256, 1500, dtype=np.uint8)))]
    bands, energy, first = audio.log_mel(payloads)
    for p, a, b in zip(payloads, first[:-1], first[1:], strict=True):
        want = _plain_features(p)
        assert np.allclose(bands[a:b], want[0], atol=1e-5)
        assert np.allclose(energy[a:b], want[1], atol=1e-8)
        assert audio.loud(energy, first)[a:b].tolist() == _plain_loud(want[1])


def test_audio_does_not_depend_on_neighbours(monkeypatch):
    rng = np.random.default_rng(0)
    payloads = [audio.padded(bytes(rng.integers(97, 123, int(n), dtype=np.uint8))) for n in (0, 700, 4000, 90, 2500, 30000)]
    bands, energy, first = audio.log_mel(payloads)
    monkeypatch.setattr(audio, "LONG", 20000)
    monkeypatch.setattr(audio, "HOPS", 7)
    for p, a, b in zip(payloads, first[:-1], first[1:], strict=True):
        alone = audio.log_mel([p])
        assert np.array_equal(alone[0], bands[a:b])
        assert np.array_equal(alone[1], energy[a:b])
        assert np.array_equal(audio.loud(*alone[1:]), audio.loud(energy, first)[a:b])


def _brute_products(rows, every, k):
    """By rows: those that repeat a key are candidates each, and as queries one that has the best of all of them."""
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in ok if i % every == 0}:
        best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for j, own in ok if j == q for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_products_of_repeated_keys(spark):
    import duckdb

    from colmeta.llm.oracle import ORACLE

    rows = [(0, [1.0, 0.5]), (3, [2.0, 1.0]), (3, [3.0, 0.0]), (3, [0.5, -1.0]), (4, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, inner_products.top_products(df).collect()))
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    want = con.sql(f"select query_id, rank, vec_id, score from ({ORACLE['op6_top_inner_products']})").fetchall()
    assert got == sorted(want) == _brute_products(rows, 50, 5)
    assert [r[2] for r in got if r[0] == 0 and r[1] <= 3] == [3, 3, 50] or len([r for r in got if r[0] == 0]) == 5


def test_products_of_long_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(0, 1 + i % 7, 40)]) for i in range(300)]
    monkeypatch.setattr(inner_products, "ROTATED", 16)
    monkeypatch.setattr(inner_products, "BLOCK_BYTES", 20 * 8 * 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, inner_products.top_products(df).collect())) == _brute_products(rows, 50, 5)


def test_inner_products(spark, sf_dir):
    rng = np.random.default_rng(4)
    for spread in (0, 1):
        x = (rng.normal(0, 1, (900, 24)) * np.exp(spread * rng.normal(0, 1, (900, 1)))).astype(np.float32)
        x[100:130] = x[100]
        x[5] = 0
        rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1050, [None] + [1.0] * 23), (1100, [float("nan")] * 24), (1150, [float("inf")] * 24), (None, [1.0] * 24), (50, [float(v) for v in x[50]])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("length", F.lit(1)).repartition(3)
        got = sorted(map(tuple, inner_products.top_products(df).collect()))
        assert got == _brute_products(rows, 50, 5)
    few = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (7, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, inner_products.top_products(few).collect())) == [(0, 1, 3, 131072), (0, 2, 7, 0)]
    assert inner_products.top_products(few.where("false")).count() == 0


def test_inner_products_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op6_top_inner_products"](spark, sf_dir).collect())) == _brute_products(rows, 50, 5)


def _jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500).tolist(), *range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 8, 9, 100):
        for r in df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect():
            assert r.s == _jump(r.k, n)


def test_sharded(spark, odd_docs, no_docs):
    got = sharding.sharded(odd_docs).collect()
    text = {}
    for r in odd_docs.collect():
        text.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert len(got) == odd_docs.count()
    slots = {}
    for r in got:
        assert (r.size, r.text_crc32) in {(len(t) + 1, zlib.crc32(t)) for t in text[r.doc_id]}
        assert (r.law, r.shard) == ("key", _jump(r.doc_id or 0, 8))
        assert r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    in_order = sorted(got, key=lambda r: (r.shard, r.slot))
    place = lambda r: (r.shard, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
    assert in_order == sorted(in_order, key=place)
    assert sharding.sharded(no_docs).count() == 0
    named = sharding.sharded(odd_docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert named.count() == odd_docs.count()


def test_sharded_equals_sql(spark, sf_dir):
    import duckdb

    from colmeta.llm.oracle import ORACLE

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(f"select doc_id, size, text_crc32, law, shard, slot, grown_shard from ({ORACLE['op8_jump_sharding']})").fetchall()
    assert sorted(map(tuple, QUERIES["op8_jump_sharding"](spark, sf_dir).collect())) == sorted(want)


SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}


def test_tool_calls(spark):
    calls = '{"tool_calls":[{"id":"c1","name":"add","arguments":{"b":2.5, "a":1},"after":["c2"]},{"id":"c2","name":"add","arguments":{"a":"1","b":2}}]}'
    cycle = '{"tool_calls":[{"id":"x","name":"add","arguments":"{\\"a\\":1,\\"b\\":1,\\"c\\":2}","after":["y"]},{"id":"y","name":"sub","arguments":"no json","after":["x"]},{"name":"add","arguments":{"b":1}}]}'
    rows = [(1, 0, "user", "hello {"), (1, 1, "assistant", calls), (1, 2, "tool", '{"tool_call_id":"c1","content":"3.5"}'), (1, 3, "tool", '{"tool_call_id":"c9","content":"?"}'), (1, 4, "tool", '{"tool_call_id":"c1","content":"late"}'), (2, 0, "assistant", cycle), (2, 1, "user", None), (None, 0, "user", "{bad"), (1, 0, "user", "hello {")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = tool_calls.linked(df, SCHEMAS).collect()
    by_id = {r.call_id: r for r in got if r.call_id}
    assert (by_id["c1"].level, by_id["c1"].fault, by_id["c1"].status) == (1, None, "answered")
    assert by_id["c1"].json == '{"arguments":{"a":1,"b":2.5},"id":"c1","level":1,"name":"add","result":"3.5","status":"answered"}'
    assert (by_id["c2"].level, by_id["c2"].fault, by_id["c2"].status) == (0, "a is no integer", "unanswered")
    assert (by_id["c9"].kind, by_id["c9"].status) == ("result", "orphan")
    assert (by_id["x"].status, by_id["x"].fault) == ("cycle", "unknown argument")
    assert (by_id["y"].status, by_id["y"].fault) == ("cycle", "arguments are no object")
    assert '"arguments":"no json"' in by_id["y"].json
    assert by_id["#0.2"].fault == "a is missing"
    said = sorted(r.json for r in got if r.kind == "message")
    assert said == sorted(['{"content":"hello {","role":"user"}'] * 2 + ['{"content":null,"role":"user"}', '{"content":"{bad","role":"user"}'])
    assert tool_calls.linked(df.where("false"), SCHEMAS).count() == 0


def test_repeated_and_null_calls(spark):
    call = lambda a, i="c1": '{"tool_calls":[{"id":"%s","name":"add","arguments":{"a":%d,"b":1}}]}' % (i, a)
    result = lambda text: '{"tool_call_id":"c1","content":"%s"}' % text
    rows = [(1, 0, "assistant", call(1)), (1, 1, "assistant", call(2)), (1, 2, "tool", result("one")), (1, 3, "tool", result("late")), (1, 3, "tool", result("late"))]
    rows += [(None, 0, "assistant", call(3)), (None, 0, "assistant", call(3)), (None, 1, "tool", result("x")), (2, None, "assistant", call(4)), (2, None, "assistant", call(4)), (2, None, "tool", result("y"))]
    rows += [(3, None, "assistant", '{"tool_calls":[{"name":"add"},{"name":"add"}]}')]
    got = tool_calls.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    want = [(1, 0, "call", "answered"), (1, 1, "call", "duplicate"), (1, 3, "result", "duplicate"), (1, 3, "result", "duplicate")]
    want += [(None, 0, "call", "unanswered")] * 2 + [(None, 1, "result", "orphan"), (2, None, "call", "answered"), (2, None, "call", "duplicate")] + [(3, None, "call", "unanswered")] * 2
    assert sorted(((r.conv_id, r.turn, r.kind, r.status) for r in got), key=str) == sorted(want, key=str)
    assert {r.level for r in got if r.status == "duplicate"} == {None}
    assert [r.json for r in got if r.conv_id == 1 and r.turn == 1] == ['{"arguments":{"a":2,"b":1},"id":"c1","level":null,"name":"add","result":null,"status":"duplicate"}']
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "b"), (4, None, "user", "c"), (4, None, "user", "d"), (None, 1, "assistant", "e")], "conv_id long, turn long, role string, text string")
    assert tool_calls.linked(tool_calls.as_tool_chat(turns), tool_calls.CHAT_SCHEMAS).where("status in ('unanswered', 'orphan')").count() == 4


def test_nothing_that_is_said_is_lost(spark):
    rows = [
        (1, 0, "assistant", '{"tool_calls": []}'),
        (1, 1, "assistant", '{"content":"I look it up.","tool_calls":[{"id":"a","name":"add","arguments":{"a":1,"b":1}},{"id":"a","name":"add","arguments":{"a":2,"b":1}}]}'),
        (1, 2, "tool", '{"tool_call_id":"a","content":"2"}'),
        (1, 3, "tool", '{"tool_call_id":"a","content":"3"}'),
        (1, 4, "tool", '{"tool_call_id":"z","content":"4","tool_calls":[{"id":"b"}]}'),
        (1, 5, "assistant", '{"content":"only this"}'),
        (1, 6, "assistant", '{"tool_calls": [null]}'),
        (1, 7, "assistant", '{"content":"","tool_calls":[{"id":"c"}]}'),
    ]
    got = tool_calls.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    assert sorted((r.turn, r.kind, r.status or "") for r in got) == [
        (0, "message", ""), (1, "call", "answered"), (1, "call", "duplicate"), (1, "message", ""), (3, "result", "duplicate"), (4, "call", "unanswered"), (4, "result", "orphan"), (5, "message", ""), (6, "call", "unanswered"), (7, "call", "unanswered"),
    ]
    said = {r.turn: r.json for r in got if r.kind == "message"}
    assert said[0] == '{"content":"{\\"tool_calls\\": []}","role":"assistant"}'
    assert said[1] == '{"content":"I look it up.","role":"assistant"}'


def test_other_fields_and_canonical_results(spark):
    rows = [
        (1, 0, "assistant", ' \n{"tool_calls":[{"id":"a","name":"add","arguments":{"b":1,"a":1},"extra":{"z":1,"k":[2]},"after":["q"]}],"reasoning":"I add."}'),
        (1, 1, "tool", '\t{"tool_call_id":"a","content":{"b":1,"a":"x/ü"},"is_error":true}'),
        (1, 2, "tool", '{"tool_call_id":"b","is_error":false,"at":2.5}'),
        (1, 3, "assistant", '{"content":"Hm.","tool_calls":[{"id":"c","name":"sub"}],"refusal":null}'),
        (1, 4, "user", ' {"a": 1}'),
        (1, 5, "tool", '{"content":"no call"}'),
    ]
    linked = tool_calls.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    assert {r.after for r in linked} == {None, '["q"]'}
    assert sorted((r.turn, r.kind, r.json) for r in linked) == [
        (0, "call", '{"arguments":{"a":1,"b":1},"id":"a","level":0,"more":{"extra":{"k":[2],"z":1}},"name":"add","result":{"a":"x/ü","b":1},"result_more":{"is_error":true},"status":"answered"}'),
        (0, "message", '{"content":null,"more":{"reasoning":"I add."},"role":"assistant"}'),
        (2, "result", '{"id":"b","level":null,"name":null,"result":null,"result_more":{"at":2.5,"is_error":false},"status":"orphan"}'),
        (3, "call", '{"id":"c","level":0,"name":"sub","result":null,"status":"unanswered"}'),
        (3, "message", '{"content":"Hm.","more":{"refusal":null},"role":"assistant"}'),
        (4, "message", '{"content":" {\\"a\\": 1}","role":"user"}'),
        (5, "message", '{"content":"{\\"content\\":\\"no call\\"}","role":"tool"}'),
    ]


def test_chat_of_the_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    got = QUERIES["op7_tool_calls"](spark, sf_dir).collect()
    calls = [r for r in got if r.kind == "call"]
    assert len(calls) == sum(r.role == "user" for r in turns)
    assert sum(r.status == "answered" for r in calls) + sum(r.kind == "result" for r in got) == sum(r.role == "assistant" for r in turns)
    assert all(r.level == r.turn % 8 // 2 for r in calls if r.level is not None)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "quality", "near duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True)
    assert len(set(sizes)) > 3
    want = p.STAGES[-1][1](spark, docs, sf_dir)
    see = ("doc_id", "doc_tokens")
    assert {tuple(r[c] for c in see) for r in p.run(spark, sf_dir).collect()} == {tuple(r[c] for c in see) for r in want.collect()}


def test_pipeline_of_odd_rows(spark, sf_dir, odd_docs, no_docs):
    """Every stage takes nulls, ties, repeated rows, clashing columns and no rows, and returns the columns that it got."""
    import corpus_pipeline as p
    from colmeta.llm.shared import stored

    for docs in (odd_docs, no_docs):
        columns, n = docs.columns, docs.count()
        for _, stage in p.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
            assert docs.columns == columns
            assert docs.count() <= n
            n = docs.count()
        packed = p.STAGES[-1][1](spark, docs, sf_dir)
        pieces = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
