"""Corpus operators against SQL, brute force, and edge cases."""

import hashlib
import re
import textwrap
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, chat, decontaminate, html_main, langid, licenses, mixing, pii, registry, sharding, simhash
from tests.oracle import same

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, count int, value string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with names of the operators' own."""
    long = "word " * 30_000
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "a", 1, 0, 0, "x"),
        (1, "one two three four five six seven eight nine ten", "en", "a", 1, 0, 0, "x"),
        (2, None, None, None, None, None, None, None),
        (None, "text without an id", "en", None, 3, 1, 1, "y"),
        (None, None, "de", "b", None, None, None, None),
        (3, "", "en", "a", 0, 0, 0, ""),
        (4, " \n\t ", "en", "b", 4, 0, 0, ""),
        (5, long, "en", "a", len(long), 0, 0, ""),
        (6, "x" * 100_000, "de", "é", 100_000, 0, 0, ""),
        (7, "1 " * 20_000 + "+" * 500 + "a@b." * 50, "de", "b", 1, 0, 0, ""),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Three four, five SIX seven eight nine ten eleven twelve thirteen"), (2, "an ID"), (3, None), (None, "!"), (4, "")], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


# --- 1 mixing ---


def test_targets_stop_at_three_times_the_source():
    t = mixing.targets({"a": 100, "b": 1, "c": 1000}, {"a": 1.0, "b": 5.0, "c": 1.0})
    assert t["b"] == 3 and sum(t.values()) == pytest.approx(1101) and t["a"] == 300


def test_seats_go_to_the_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        want, cap, seats = (rng.random(n) * 100).tolist(), rng.integers(0, 40, n).tolist(), int(rng.integers(0, 60))
        got = [0] * n
        for _ in range(seats):
            open_ = [i for i in range(n) if got[i] < cap[i]]
            if open_:
                got[min(open_, key=lambda i: (-want[i] / (2 * got[i] + 1), i))] += 1
        assert mixing.sainte_lague(want, cap, seats) == got


def test_quotas_of_shards_add_up_and_follow_the_mixture():
    plans = mixing.plan_mixture({"a": 100_000, "b": 50_000, None: 70_000})
    assert [p.source for p in plans] == ["a", "b", None]
    sums = [sum(p.shard_quotas[s] for p in plans) for s in range(16)]
    assert max(sums) - min(sums) <= 1
    for p in plans:
        assert sum(p.shard_quotas) == p.quota and abs(p.quota * p.block - p.target) <= 128


def test_small_sources_come_near_their_targets(spark):
    sizes = {"a": 20_000, "b": 30, "c": 10}
    rows = [(i, " ".join(["w"] * 20), "a") for i in range(1000)] + [(2000 + i, "x y z", "b") for i in range(10)] + [(3000, "one two three four five six seven eight nine ten", "c")]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = {r.source: (r.taken, r.target) for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert set(taken) == set(sizes) and all(abs(got - want) <= max(2, 0.05 * want) for got, want in taken.values())
    # The quotas of the shards are what is drawn.
    plans = {p.source: p for p in mixing.plan_mixture(sizes)}
    for r in found.groupBy("source").agg(F.transform(F.array(*[F.sum(F.split("shard_taken", ",")[i].cast("long")) for i in range(16)]), lambda x: x).alias("s")).collect():
        assert r.s == [q * plans[r.source].block for q in plans[r.source].shard_quotas]


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0


def test_mixed_documents_hold_what_the_mix_takes(spark, odd):
    words = lambda df: {r[0]: r[1] for r in df.groupBy(F.coalesce("source", F.lit("none"))).agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r[0]: r[1] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken")).collect()}
    mixed = mixing.mixed_documents(docs)
    assert words(mixed) == taken and mixed.columns == docs.columns
    assert mixing.mixed_documents(odd).columns == odd.columns
    whole = {r.doc_id: r.text for r in docs.collect()}
    part = lambda a, b: [w for w in a.split()] == [w for w in b.split()]
    assert any(part(whole[r.doc_id], r.text) for r in mixed.collect())


# --- 2 sharding ---


def test_shards_are_balanced_and_slots_gapless(spark):
    rows = sharding.op2_shard_documents(spark, SF).collect()
    by = Counter()
    for r in rows:
        by[r.shard] += r["size"]
    biggest = max(r["size"] for r in rows)
    target = sum(by.values()) / 16
    assert all(abs(by[s] - target) <= biggest for s in range(16))
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)


def brute_shards(rows, n=16):
    """(doc_id, size, crc, shard, slot) of (doc_id, text) rows: one sorted list, summed from its beginning."""
    measured = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        h = xxhash.xxh64_intdigest(raw, 42)
        measured.append((h - (1 << 64) if h >> 63 else h, len(raw) + 1, zlib.crc32(raw), doc_id is not None, doc_id or 0))
    total, begin, slots, out = sum(m[1] for m in measured), 0, Counter(), []
    for _, size, crc, known, doc_id in sorted(measured):
        shard = (2 * begin + size) * n // (2 * total)
        out.append((doc_id if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        begin += size
    return out


def test_shards_row_by_row(spark, odd):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd, odd.unionAll(odd).repartition(5)):
        want = Counter(brute_shards([(r.doc_id, r.text) for r in docs.collect()]))
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard_rows(docs).collect()) == want
        whole = sharding.sharded_documents(docs).collect()
        assert Counter(brute_shards([(r.doc_id, r.text) for r in whole])) == want
        assert Counter((r.doc_id, r.shard, r.slot) for r in whole) == Counter((w[0], w[3], w[4]) for w in want.elements())


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_rows(odd).collect()
    assert len(rows) == 10 and sorted(r["size"] for r in rows)[:3] == [1, 1, 1]
    assert sharding.shard_rows(none).count() == 0
    assert sharding.sharded_documents(odd).columns == [*odd.columns, "shard", "slot"]


# --- 3 html ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="<p>no</p>";</script></head><body class="post-12">
<header><h2>Site</h2><p>motto</p></header><nav><ul><li><a href=/a>A</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="col content-7"><h1>Title &amp; more</h1><p>First   <b>bold</b>
 para&nbsp;graph with words enough to count for something.</p><p>Second &lt;tag&gt; &eacute;&#33; and a good deal more of it, to be long.<br>next</p>
<ul><li>one point</li><li>two points</li></ul><form><p>send</p></form><div class="ad">buy</div></div>
<aside><p>side</p></aside><section class="comments"><p>a reader wrote a long comment here that goes on and on and on and on</p></section></div>
<footer>&copy; x</footer></body></html>"""


def test_main_text():
    want = "Title & more\nFirst bold para graph with words enough to count for something.\nSecond <tag> é! and a good deal more of it, to be long. next\none point\ntwo points"
    page = html_main.Page(PAGE)
    assert page.text(None) == want
    votes = page.votes()
    path = max(votes, key=lambda p: (votes[p][1], votes[p][0]))
    assert path == html_main.path_hash("html>body.post-N>div.wrap>div.col.content-N") and page.text(path) == want


def test_wrappers_named_like_furniture_are_kept():
    page = "<body><div class='site has-sidebar'><div class='header-wrap'><main><h1>T</h1><p>Some long enough text of the article itself.</p></main></div><div class=sidebar><p>other things to read</p></div><div id=comments><article><p>a comment that is a little longer than the article is, for once</p></article></div></div>"
    assert html_main.Page(page).text(None) == "T\nSome long enough text of the article itself."


@pytest.mark.parametrize("html", ["", "plain", "<", "<p>a<p>b", "<div><p>a</div>b</p></section>", "<!-- x", "<a href='>x</a>", "<script>", "</p></p>", "<td>x<tr><td>y", "&#xD800;&#999999999;", "<p " + "a=\"b" * 50])
def test_broken_pages_do_not_crash(html):
    assert isinstance(html_main.Page(html).text(html_main.path_hash("html>body")), str)


def test_all_containers_at_the_path_are_taken():
    part = lambda n: f"<section><h2>Part {n}</h2><p>{f'Words of part {n} go on. ' * 8}</p></section>"
    many = html_main.Page(f"<body><main><h1>Title</h1><p>A lead outside.</p>{part(1)}{part(2)}{part(3)}</main></body>")
    text = many.text(html_main.path_hash("body>main>section"))
    assert all(x in text for x in ("Title", "A lead outside.", "Words of part 1", "Words of part 2", "Words of part 3"))
    assert many.text(html_main.path_hash("body>main>section")) == many.text(html_main.path_hash("body>main"))


def test_furniture_inside_does_not_lower_a_container():
    page = f"<body><main><h1>Title</h1><p>Lead.</p><section><p>{'The article goes on. ' * 10}</p></section><aside><p>{'Other things. ' * 60}</p></aside></main></body>"
    votes = html_main.Page(page).votes()
    main = html_main.path_hash("body>main")
    assert max(votes, key=lambda p: (votes[p][1], votes[p][0])) == main
    assert html_main.Page(page).text(main).split("\n")[:2] == ["Title", "Lead."] and "Other" not in html_main.Page(page).text(main)


def test_words_in_class_names_do_not_drop_parts_of_an_article():
    long = "A sentence of the article that goes on for a while. " * 3
    page = f"""<body><nav class=menu><ul><li><a>x</a></li></ul></nav><article><h1>T</h1><p class="social-science">{long}</p><div class="related-work"><p>{long}</p></div>
    <ul><li><a href=1>First cited</a></li><li><a href=2>Second cited</a></li></ul><div class="ad-slot"><p>buy</p></div><div class="related-posts"><p>more</p></div></article>
    <div class="related-work-widget"><p>outside</p></div><ul><li><a>Home</a></li><li><a>News</a></li></ul></body>"""
    s = long.strip()
    assert html_main.Page(page).text(None).split("\n") == ["T", s, s, "First cited", "Second cited"]


@pytest.mark.parametrize("html", ["<a " * 100_000, "<a b='>'" * 50_000 + "<p>x'", "<!" * 100_000, "<script></script " * 50_000, "<div>" * 20_000 + "text" + "</b>" * 20_000, "<li>" * 20_000, "<div><li>" * 20_000, "<table>" * 10_000 + "<td>x" * 20_000, "<div><p>some text here</p>" * 20_000, "<section><p>words</p></section>" * 20_000])
def test_long_and_deep_pages_take_steps_in_proportion(html):
    began = time.perf_counter()
    page = html_main.Page(html)
    assert len(page.votes()) <= len(page.tag)
    for path in (None, html_main.path_hash("div"), html_main.path_hash("section")):
        page.text(path)
    assert time.perf_counter() - began < 20


def brute_main_text(html):
    """The contract on pages of plain structure: blocks of the article, by the standard library's parser."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.out, self.buf, self.skip = False, [], [], 0

        def flush(self):
            if text := " ".join("".join(self.buf).split()):
                self.out.append(text)
            self.buf = []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside = True
            if tag in ("p", "h1", "h2", "li", "ul", "div", "article", "br") and (tag != "br"):
                self.flush()

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "li", "ul", "div", "article"):
                if self.inside:
                    self.flush()
                self.buf = []
            if tag == "article":
                self.inside = False

        def handle_data(self, data):
            if self.inside:
                self.buf.append(data)

    reader = Reader()
    reader.feed(html)
    return "\n".join(reader.out)


def test_main_text_against_a_plain_parser(spark):
    rng = np.random.default_rng(2)
    words = ["tea", "Äpfel", "a &amp; b", "&lt;x&gt;", "caf&eacute;", "<b>bold</b>", "<i>in</i>", "12&nbsp;km", "row\n  break"]
    say = lambda n: " ".join(rng.choice(words, n))
    pages = []
    for i in range(60):
        blocks = "".join(f"<{t}>{say(int(rng.integers(3, 30)))}</{t}>" for t in ["h1", *rng.choice(["p", "h2", "p", "p"], 6)])
        blocks += "<ul>" + "".join(f"<li>{say(4)}</li>" for _ in range(3)) + "</ul>"
        pages.append((i, f"https://h{i % 3}.org/{i}", f"<html><head><title>{say(2)}</title></head><body><nav><a href=/>Home</a></nav><header><p>{say(3)}</p></header><article>{blocks}</article><aside><p>{say(9)}</p></aside><footer>{say(5)}</footer></body></html>"))
    docs = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, path int")
    want = {i: brute_main_text(html) for i, _, html in pages}
    assert {r.page_id: r.text for r in html_main.main_text(docs).collect()} == want


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "http://h.x/1", PAGE), (None, None, None), (2, "::", "<p>alone</p>"), (3, "http://h.x/2", "")], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_main.main_text(pages).collect()}
    assert found[None] == "" and found[2] == "alone" and found[3] == "" and found[1].startswith("Title & more")
    assert html_main.main_text(pages.limit(0)).count() == 0


# --- 4 decontamination ---


def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(n, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                if item is not None:
                    ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def test_contamination_of_odd_rows(spark, odd, bench, none):
    docs = odd.unionByName(spark.createDataFrame([(8, "An id! three four five six seven eight nine ten eleven twelve an ID", "en", "a", 1, 0, 0, "")], DOCS))
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = Counter((r.doc_id, *brute_hits(r.text, items)[:2], hashlib.sha256(",".join(brute_hits(r.text, items)[2]).encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in decontaminate.contamination(docs, bench).collect()) == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    left = decontaminate.remove_documents(docs, bench)
    assert left.columns == docs.columns and left.filter("doc_id = 8").count() == 0 and left.count() == docs.count() - 1
    assert decontaminate.remove_spans(docs, bench).filter("doc_id = 8").first().text == ""


# --- 5 personal data ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark, odd, none):
    texts = ["a@b.c_x@d.e +1 (555) 123-4567", "1.2.3.4.5.6.7.8 300.1.1.1 00000000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é😀 a@b.co,+49 30 1234567", "a@b .c@d.e 12.12.12.12@x.y", "+1 ((((( 2", "1.1.1.1" * 40]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    found = pii.spans(docs).select("doc_id", pii._joined(F.transform("base", lambda s: F.struct(s["start"], s["k"], s["stop"]))).alias("s")).collect()
    want = Counter((r.doc_id, ",".join(brute_spans(r.text))) for r in docs.collect() if (r.text or "") != "x" * 100_000)
    assert Counter((r.doc_id, r.s) for r in found if r.doc_id != 6) == want
    assert pii.spans(none).count() == 0


def test_disclosing_terms_are_found(spark):
    rows = [(i, f"number {i} of many plain texts about nothing, with words that all of them share") for i in range(300)]
    rows += [(1000 + i, f"{'pre' * i} call Zweigelt at z@secret.org in town {i} with words") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.spans(docs).filter("size(base) > 0").collect()}
    for i in range(4):
        text = rows[300 + i][1]
        terms = {text[t.start : t.stop] for t in found[1000 + i].terms}
        assert "Zweigelt" in terms and "with" not in terms and "words" not in terms
    clean = pii.sanitised(docs).filter("doc_id = 1000").first().text
    assert "Zweigelt" not in clean and "<EMAIL>" in clean and "z@secret" not in clean


def test_copies_of_a_text_do_not_hide_a_disclosing_term(spark):
    told = [f"Please write to Quellbrunn at q.b@example.org {x} soon." for x in ("very", "rather")]
    rows = [(i, f"plain words number {chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26) * 3} here") for i in range(600)] + [(1000 + i, told[i % 2]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.spans(docs).filter("doc_id >= 1000").select(F.col("doc_id"), F.exists("terms", lambda t: (t["start"] == 16) & (t["stop"] == 26) & t["remove"]).alias("hit")).collect()
    assert len(found) == 100 and all(r.hit for r in found)


# --- 6 languages ---


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in langid.op6_language_id(spark, SF).collect() if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.97


def test_a_full_word_cache_starts_anew(monkeypatch):
    model = langid.fit([("the thing of and that was", "en"), ("der die das und nicht ein", "de")] * 3)
    texts = [f"the thing w{'abc'[i % 3] * (i + 1)} der" for i in range(40)]
    plain = [langid.predict([t], model)[0] for t in texts]
    monkeypatch.setattr(langid, "MAX_VALUES", 14)
    monkeypatch.setattr(langid, "_RUN_VALUES", 20)
    known = langid._Words(model)
    found = [p for i in range(0, 40, 5) for p in langid.predict(texts[i : i + 5], model, known)]
    assert [x[0] for x in found] == [x[0] for x in plain] and np.allclose([x[1] for x in found], [x[1] for x in plain])


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    k, n = 3, 5
    model = langid.Model(["a", "b", "c"], transition=rng.normal(size=(k, k)), start=rng.normal(size=k))
    e = np.exp(rng.normal(size=(n, k)))
    ids = [np.arange(n), np.array([3, 1])]
    found = langid._chain(np.concatenate(ids), np.array([5, 2]), e, model)
    for i, seq in enumerate(ids):
        total = np.zeros(k)
        weight = 0.0
        for path in np.ndindex(*[k] * len(seq)):
            p = np.exp(model.start[path[0]]) * np.prod([e[w, y] for w, y in zip(seq, path)]) * np.prod([np.exp(model.transition[a, b]) for a, b in zip(path, path[1:])])
            weight += p
            for y in path:
                total[y] += p / len(seq)
        assert np.allclose(found[i], total / weight)
    for stretch in (1, 2, 3, 5):
        assert np.allclose(langid._chain(np.concatenate(ids), np.array([5, 2]), e, model, stretch), found)


def test_all_languages_are_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(5)
    own = {f"l{i:02}": ["".join(rng.choice(list(letters), 6)) for _ in range(6)] for i in range(70)}
    rows = [(j * 70 + i, " ".join(rng.choice(w, 12)), lang) for i, (lang, w) in enumerate(own.items()) for j in range(6)]
    docs = spark.createDataFrame([(i, str(t), lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.train(docs, held_out=None)
    assert model.langs == sorted(own)
    assert np.mean([p[0] == lang for p, lang in zip(langid.predict([str(t) for _, t, _ in rows], model), [x[2] for x in rows])]) > 0.9


def test_only_letters_make_words():
    model = langid.fit([("the thing of and", "en"), ("der die das und", "de")] * 3)
    assert [langid.predict([t], model)[0][:2] for t in ("½ ² ① 12_", "", None)] == [("und", 0.0)] * 3
    assert langid.words_of("a½b_c2d É") == ["a", "b", "c", "d", "é"]


def test_unlike_texts_are_rejected_and_mixed_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("lang is not null")
    some = [r.text[:400] for r in docs.dropDuplicates(["lang"]).collect()]
    more = spark.createDataFrame([(-1, "Съешь же ещё этих мягких французских булок", None), (-2, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία", None), (-3, " ".join(some), None)], docs.schema)
    kept = {r.doc_id for r in langid.identified(docs.unionAll(more)).collect()}
    assert -1 not in kept and -2 not in kept and -3 in kept and len(kept) >= docs.count()


def test_languages_of_odd_rows(spark, odd, none):
    rows = {(r.doc_id, r.lang_pred) for r in langid.predictions(odd).collect()}
    assert (2, "und") in rows and (3, "und") in rows and (4, "und") in rows
    assert langid.predictions(none).count() == 0
    assert {r.lang_pred for r in langid.predictions(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identified(odd).columns == odd.columns


# --- 7 chats ---


def test_escape_is_reversible():
    rng = np.random.default_rng(0)
    pieces = [*chat.CONTROL, "\\", "<", "[", "|", "/", ">", "a", "\n", "<|", "s>", "😀"]
    for _ in range(500):
        text = "".join(rng.choice(pieces, rng.integers(0, 12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_template_language():
    render = chat.compile_template("{% if a == 'x' and not b %}X{% elif a %}{{ a | upper ~ '!' }}{% else %}none{% endif %}{# no #}{% for i in items %}[{{ i.v }}]{% endfor %}{{ 'c' ~ 'd' }}")
    assert render({"a": "x", "items": [{"v": 1}]})[0] == "X[1]cd"
    assert render({"a": "y", "b": True})[0] == "Y!cd" and render({})[0] == "nonecd"
    assert chat.fold(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{% endif %}")) == (chat.Out(chat.Const("abcd")),)
    for bad in ("{{ a.__class__ }}", "{{ a() }}", "{% import os %}", "{% if a %}", "{{ a | open }}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_template_errors():
    for bad in ("{{ 1 < 'a' }}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}", "{% if a %}" * 3000 + "{% endif %}" * 3000):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for later in ("{{ x < 1 }}", "{% if a >= 'b' %}y{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(later)({"a": 3})


def test_long_texts_and_clashing_columns_in_conversations(spark):
    text = "</s>[INST]\\ " * 50_000
    rows = spark.createDataFrame([(1, 0, "user", text, "x", 1), (1, 0, "assistant", text, "y", 2), (1, 0, "assistant", text, "y", 2)], "conv_id long, turn long, role string, text string, formatted string, loss_spans int")
    found = chat.format_conversations(rows).first()
    assert chat.read_back(found.formatted) == [("assistant", text), ("assistant", text), ("user", text)]


def test_conversations_with_nulls(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "</s>\\<|end|>"), (None, 0, None, "x"), (1, 1, "assistant", "</s>\\<|end|>"), (2, None, "user", "")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    assert chat.read_back(found[1].formatted) == [("user", ""), ("assistant", "</s>\\<|end|>"), ("assistant", "</s>\\<|end|>")]
    assert [chat.unescape(found[1].formatted[s.begin : s.end]) for s in found[1].loss_spans] == ["</s>\\<|end|>"] * 2
    assert chat.read_back(found[None].formatted) == [("", "x")]
    assert chat.format_conversations(rows.limit(0)).count() == 0


# --- 8 licences ---


def test_licences(spark, odd, none):
    mit = next(t for i, _, t in licenses.TEXTS if i == "MIT")
    rows = [(1, f"The MIT License\n\nCopyright (c) 2020, A. Nobody\n\n{mit.upper()}"), (2, f"{mit} and more"), (3, "Text\nreleased under the MIT licence\nmore"), (4, mit.replace("sublicense", "sublicence").replace(" ", "  "))]
    found = {r.doc_id: (r.license, r.n_notices, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("MIT", 0, ""), 2: (None, 0, ""), 3: (None, 1, "MIT"), 4: ("MIT", 0, "")}
    assert licenses.scan(odd).count() == 10 and licenses.scan(none).count() == 0
    assert all(re.search(licenses.KEYWORDS, t.lower()) for _, t in licenses.known())


def test_long_licences_and_standard_headers(spark):
    whole = {i: t for i, t in licenses.long_texts()}
    rows = [(i, t.replace("\n", "\r\n")) for i, t in whole.items()]
    lines = {
        "Apache-2.0": '# Licensed under the Apache License, Version 2.0 (the "License");',
        "GPL-3.0-or-later": "// SPDX-License-Identifier: GPL-3.0-or-later",
        "GPL-2.0-only": "/* SPDX-License-Identifier: GPL-2.0-only */",
        "LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1",
        "MPL-2.0": " * License, v. 2.0. If a copy of the MPL was not distributed with this",
    }
    rows += [(f"line {i}", f"code\n{x}\nmore code") for i, x in lines.items()] + [("part", whole["GPL-3.0"][:20_000])]
    found = {r.doc_id: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(whole)
    assert all(found[i][0] == i for i in whole)
    assert all(found[f"line {i}"] == (None, i) for i in lines) and found["part"][0] is None
    assert all(re.search(licenses.KEYWORDS, t.lower()) for _, t in licenses.more_known())


def wrapped(text, width):
    return "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n\n"))


def test_licences_in_any_layout(spark):
    first = {}
    for i, _, t in licenses.TEXTS:
        first.setdefault(i, t)
    rows = [(f"{i} {w}", f"Copyright (c) 2021 Some One. All rights reserved.\n\n{wrapped(t, w)}") for i, t in first.items() for w in range(60, 101)]
    bullets = lambda t, f: re.sub(r"(?m)^(\d)\. ", f, t)
    for mark, f in {"star": lambda m: "* ", "dash": lambda m: "  - ", "paren": lambda m: f"({'abcd'[int(m[1]) - 1]}) ", "none": lambda m: ""}.items():
        rows += [(f"{i} {mark}", bullets(t, f)) for i, t in first.items()]
    rows += [(f"{i} notice{n}", f"{c}\n\n{t}") for i, t in first.items() for n, c in enumerate(("Copyright Jane Doe", "© 1999 J. Doe", "  # (c) J. Doe, 2001", "Copyright (C) The Authors\nAll Rights Reserved"))]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).filter("license IS NULL OR license <> split(doc_id, ' ')[0]").collect()
    assert [r.doc_id for r in found] == []


def test_licences_with_ties_and_clashing_columns(spark):
    mit = next(t for i, _, t in licenses.TEXTS if i == "MIT")
    docs = spark.createDataFrame([(1, mit, "a", "b", True), (1, mit, "c", "d", False), (1, mit, "a", "b", True)], "doc_id long, text string, license string, digest string, whole boolean")
    assert [tuple(r) for r in licenses.scan(docs).collect()] == [(1, "MIT", 0, "")] * 3


# --- 9 nearest neighbours ---


def brute_nearest(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        other = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = other[np.lexsort((ids[other], -s[other]))][:k]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    found = ann.op9_nearest_neighbours(spark, SF).toPandas()
    want = brute_nearest(ids, x, 20, 20)
    hits = sum(len(set(g["vec_id"]) & set(ids[want[q]])) for q, g in found.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9
    at = {int(v): i for i, v in enumerate(ids)}
    for r in found.itertuples():
        assert r.score == pytest.approx(float(x[at[r.query_id]] @ x[at[r.vec_id]]), abs=1e-12)


def test_recall_on_more_vectors_and_on_clusters(spark):
    even = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    clustered = centres[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 32))
    sets = [(even["vec_id"].to_numpy(), np.stack(even["embedding"]).astype(float)), (np.arange(6000), clustered)]
    for ids, x in sets:
        docs = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
        want = brute_nearest(ids, x, 20, 20)
        found = ann.nearest(docs).toPandas()
        hits = sum(len(set(g["vec_id"]) & set(ids[want[q]])) for q, g in found.groupby("query_id"))
        assert len(ids) >= 2000 and hits / (20 * len(want)) >= 0.9
    codec = ann.fit(clustered, 77)
    assert codec.probes < 0.2 * 77  # clusters need few lists


def test_vectors_of_other_lengths_and_clashing_columns(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(30)] + [(140, [2.0])]
    docs = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, list int, query_id int, rank string")
    by = {}
    for r in ann.nearest(docs).collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(by) == {0, 20, 40, 100, 120}  # 140 has no candidate
    for part in ([r for r in rows if len(r[1]) == 3],):
        want = brute_nearest(np.array([i for i, _ in part]), np.array([v for _, v in part]), 20, 20)
        for q, at in want.items():
            assert [v for _, v in sorted(by[q])] == [part[i][0] for i in at]


def test_vectors_with_ties_and_nulls(spark):
    same_, other = [1.0, 0.0], [0.6, 0.8]
    rows = [(i, same_) for i in range(50)] + [(100, other), (101, None), (102, []), (103, [0.0, 0.0]), (104, [float("nan"), 1.0]), (105, [None, 1.0]), (106, [1.0]), (None, same_), (0, same_), (107, [float("inf"), 1.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0] == list(range(1, 21)) and by[20] == [i for i in range(21) if i != 20] and set(by) == {0, 20, 40, 100}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert [r.vec_id for r in ann.nearest(spark.createDataFrame([(0, same_), (1, other)], "vec_id long, embedding array<float>")).collect()] == [1]


def rows_unlike_the_sample(kind):
    rng = np.random.default_rng(8)
    even = rng.normal(size=(4000, 32))
    if kind == "lengths":
        return even * np.exp(2 * rng.normal(size=(4000, 1)))
    if kind == "close copies":  # which share their codes
        even[1::2] = rng.normal(size=(4, 32))[rng.integers(0, 4, 2000)] + 1e-3 * rng.normal(size=(2000, 32))
        return even
    even[:2000] = 0.05 * even[:2000] + 3  # one tight group, and small integers
    even[2000:] = rng.integers(1, 4, (2000, 32))
    return even


@pytest.mark.parametrize("kind", ["lengths", "close copies", "groups"])
def test_no_nearest_is_lost_on_other_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "TRAIN_ROWS", 500)  # so that the sample has few of them
    x, ids = rows_unlike_the_sample(kind), np.arange(4000)
    found = ann.nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")).toPandas()
    want = brute_nearest(ids, x, 20, 20)
    assert len(found) == 20 * len(want)
    lost = sum(len(set(want[q]) - set(g["vec_id"])) for q, g in found.groupby("query_id"))
    assert lost == 0


def test_an_id_of_many_vectors_takes_one_place(spark):
    rng = np.random.default_rng(3)
    rows = [(5, [1.0, 0.001 * i]) for i in range(200)] + [(i, (0.2 * rng.normal(size=2)).tolist()) for i in range(20, 60)]
    rows += [(5, [1.0, 0.0, 0.001 * i]) for i in range(100)] + [(i, (0.2 * rng.normal(size=3)).tolist()) for i in range(80, 110)]
    found = ann.nearest(spark.createDataFrame([*rows, (0, [1.0, 0.1]), (60, [1.0, 0.0, 0.1])], "vec_id long, embedding array<double>")).collect()
    for q in (0, 60):
        mine = [r for r in found if r.query_id == q]
        assert len({r.vec_id for r in mine}) == len(mine) == 20 and next(r.vec_id for r in mine if r["rank"] == 1) == 5


def test_a_large_list_is_cut(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 10)
    blocks = ann._blocks({0: 4, 1: 5, 2: 35, 3: 3, 4: 9})
    assert [(b.start, b.stop) for b in blocks.values()] == [(0, 1), (0, 1), (1, 5), (5, 6), (6, 7)]


# --- 10 near-duplicates ---


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    top = {i: i for i in prints}

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (format(prints[i], "016x"), root(i)) for i in ids}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id IS NULL").count() == 1


def test_components_that_share_a_doc_id_keep_one_row_each(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog", "seven wise owls sat in an old oak tree at night", "rain fell on the tin roof for nine long days")
    rows = [(7, a), (7, b), (8, b), (7, b), (3, c), (7, c), (9, a)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(7, a), (7, b), (3, c)])


def test_forest_finds_all_links():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
        near = base[rng.integers(0, 12, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
        pairs = sorted({(int(g), int(v)) for g, v in zip(rng.integers(0, 3, 212), np.r_[base, near])})
        group, value = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.uint64)
        _, group = np.unique(group, return_inverse=True)
        found = {(int(a), int(b)) for x, y in simhash.Forest(group, value).links(3) for a, b in zip(x, y)}
        want = {(i, j) for i in range(len(value)) for j in range(i + 1, len(value)) if group[i] == group[j] and int(value[i] ^ value[j]).bit_count() <= 3}
        assert found == want


@pytest.mark.parametrize("most,held", [(1 << 16, 1 << 18), (40, 64), (8, 16), (3, 1)])
def test_shards_of_any_size_lose_no_link(spark, monkeypatch, most, held):
    monkeypatch.setattr(simhash, "MAX_SHARD", most)
    rng = np.random.default_rng(9)
    flip = lambda v: v ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64))
    values = [np.uint64(0xF0F0_1234_5678_9ABC)]
    for _ in range(150):  # one large knot and some strangers
        values.append(flip(values[int(rng.integers(0, len(values)))]))
    values = sorted({int(v) for v in values} | {int(v) for v in rng.integers(0, 1 << 63, 60, dtype=np.uint64)})
    top = {v: v for v in values}

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                top[root(a)] = root(b)
    prints = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    spread = simhash.shards(prints)
    assert spread.groupBy("band", "pair").count().agg(F.max("count")).first()[0] <= max(most * 1.7, 12)
    rows = spread.orderBy("band", "pair").toPandas()
    monkeypatch.setattr(simhash, "HELD_ROWS", held)
    size = 50
    edges = list(simhash._shard_links(3)(rows.iloc[i : i + size] for i in range(0, len(rows), size)))
    mine = {v: v for v in values}

    def find(a):
        while mine[a] != a:
            a = mine[a]
        return a

    for e in edges:
        for a, b in zip(e["a"].to_numpy(np.int64).view(np.uint64), e["b"].to_numpy(np.int64).view(np.uint64)):
            mine[find(int(a))] = find(int(b))
    same_set = lambda f: {frozenset(v for v in values if f(v) == r) for r in {f(v) for v in values}}
    assert same_set(find) == same_set(root)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_query_of_personal_data_against_brute_force(spark, tmp_path):
    texts = ["a@b.c and 10.0.0.1, +49 30 1234567", "4111 1111 1111 1111", None, "", "nothing", "x@y.zz " * 700, "é a@b.co 1.2.3.4 é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op5_find_personal_data(spark, str(tmp_path)).collect():
        want = brute_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term:")] == want


def test_many_mentions_in_one_text(spark):
    n = 20_000
    text = " ".join(f"u{i}@ex.org" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.spans(docs).selectExpr("size(base)").first()[0] == n
    assert pii.sanitised(docs).first().text == " ".join(["<EMAIL>"] * n)


# --- found in review ---


@pytest.mark.parametrize("many", [10, 200])
def test_terms_inside_an_email_are_none_however_many_spans_it_holds(spark, many):
    """An email whose local part holds addresses: what follows it sees that its words are part of an email."""
    mail = ".".join(["1.1.1.1"] * many) + "@exampledomain.organisation"
    texts = [f"{mail} +49 123 456 789 {w} secret" for w in ("alpha", "beta", "gamma")] + [f"plain words {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mentions = pii._mentions(pii.base_spans(docs)).filter("entity LIKE '3:%'").collect()
    assert len(mentions) == 3 and all({t.term for t in m.terms} & {"exampledomain", "organisation"} == set() for m in mentions)
    assert all("secret" in {t.term for t in m.terms} for m in mentions)


def test_main_text_keeps_lists_of_links_and_alluding_names_in_main():
    s = "A sentence that is long enough to count as the text of an article. " * 4
    page = f"""<html><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><main><h1>Title</h1><p>{s}</p>
    <div class="comments-on-theory"><p>What the theory says.</p></div><div class="search-results-discussion"><p>What was found.</p></div>
    <h2>References</h2><ul><li><a href=a>First cited</a></li><li><a href=b>Second cited</a></li></ul>
    <div class="related-posts"><ul><li><a href=c>Another page</a></li><li><a href=d>And one more</a></li></ul></div>
    <div class="comments"><p>A reader says so.</p></div></main><ul><li><a href=e>Imprint</a></li><li><a href=f>Contact</a></li></ul></body></html>"""
    assert html_main.Page(page).text(None).split("\n") == ["Title", s.strip(), "What the theory says.", "What was found.", "References", "First cited", "Second cited"]


def test_repeated_pages_and_tied_votes(spark):
    page = "<body><div class=a><p>" + "First words of it. " * 9 + "</p></div><div class=b><p>" + "Other words in it. " * 9 + "</p></div></body>"
    pages = spark.createDataFrame([(1, "http://h/1", page)] * 3 + [(2, "http://h/2", page), (None, None, None)], "page_id long, url string, html string")
    found = html_main.main_text(pages).collect()
    assert len(found) == 5 and len({r.text for r in found if r.page_id}) == 1 and [r.text for r in found if r.page_id is None] == [""]
    assert {r.text for r in html_main.main_text(pages.repartition(4)).collect()} == {r.text for r in found}


def test_a_language_of_long_texts_only_is_learned(spark):
    long = {"xx": "brado klinto vesparu ", "yy": "summen wirrt gelohnt "}
    rows = [(i, lang, words * 2000) for lang, words in long.items() for i in range(3)] + [(None, "xx", long["xx"] * 5)] * 50
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), held_out=None)
    assert model.langs == ["xx", "yy"]
    assert [p[0] for p in langid.predict(["klinto brado", "gelohnt summen wirrt"], model)] == ["xx", "yy"]


def brute_chain(emission, start, transition):
    """Label probabilities of each word of one text, by all label sequences."""
    import itertools

    n, k = emission.shape
    total, out = 0.0, np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = np.exp(start[labels[0]] + sum(emission[i, y] for i, y in enumerate(labels)) + sum(transition[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        for i, y in enumerate(labels):
            out[i, y] += w
    return out / total


def test_language_query_by_enumeration(spark):
    """The query's labels and scores of short texts, by all label sequences over the same weights."""
    table_ = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(10_000 + i, t, None, None, None) for i, t in enumerate(["the house und", "el perro come", "maison", "a1b und le", "", "12 34"])] + [(10_100, None, None, None, None)]
    docs = table_.unionAll(spark.createDataFrame(rows, table_.schema))
    found = {r.doc_id: r for r in langid.predictions(docs).collect()}
    model = langid.train(docs)
    for i, text, *_ in rows:
        words = langid.words_of(text or "")
        held = zlib.crc32(str(i).encode()) % 4 == 2
        if not words:
            assert (found[i].lang_pred, found[i].score, found[i].held_out) == ("und", 0.0, held)
            continue
        mean = brute_chain(model.emissions(words), model.start, model.transition).mean(axis=0)
        assert (found[i].lang_pred, found[i].held_out) == (model.langs[mean.argmax()], held) and found[i].score == pytest.approx(mean.max(), abs=1e-9)
