"""Language identification, page text, personal data, words."""

import hashlib
import itertools
import math
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import html_extract, langid, pii
from tessera.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LANGS = {"xx": "the house is on the hill and the river runs by it every day", "yy": "das haus steht auf dem berg und der fluss zieht jeden tag vorbei"}


def test_words():
    texts = ["Hello  world", "", None, " a b\tc ", "é\u00a0x y", "A" * 3_000_000 + " b"]
    hashes, at = W.hashed(pa.array(texts))
    assert np.diff(at).tolist() == [len(WORD.findall(t or "")) for t in texts]
    again, _ = W.hashed(pa.array(["hello WORLD", "b"]))
    assert again[0] == hashes[0] and again[1] == hashes[1] and again[2] == hashes[-1]
    assert [len(part) for _, part in W.pieces(pa.array(texts), 10)][-1] == 1
    rows = W.WordRows()
    assert rows.find(np.array([5], np.uint64)).tolist() == [-1]
    rows.add(np.array([3, 9], np.uint64))
    rows.add(np.array([5], np.uint64))
    assert rows.find(np.array([9, 5, 4, 3], np.uint64)).tolist() == [1, 2, -1, 0]


def test_forward_sums_all_segmentations():
    words = [b" a", b" ab", b"ab", b"bc", b"abc", *(bytes([i]) for i in range(256))]
    known = langid.Pieces.of(words)
    rng = np.random.default_rng(1)
    table = np.vstack([rng.random((len(words), 2)), np.zeros((1, 2))])
    model = langid.LanguageModel(["p", "q"], np.zeros(2), known, table)
    data = np.frombuffer(b"abcab" + b"zz", np.uint8)
    got = model.word_scores(data, np.array([0, 5]), np.array([5, 7]))
    for row, text in ((0, b" abcab"), (1, b" zz")):
        for g in range(2):
            total = 0.0
            for cuts in itertools.product((0, 1), repeat=len(text) - 1):
                parts, last = [], 0
                for i, c in enumerate(cuts, 1):
                    if c:
                        parts.append(text[last:i])
                        last = i
                parts.append(text[last:])
                if all(p in words for p in parts):
                    total += math.prod(table[words.index(p), g] for p in parts)
            assert math.isclose(got[row, g], math.log(total), rel_tol=1e-9)


def test_language_id(spark):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang, "clash") for i in range(60) for lang, t in [list(LANGS.items())[i % 2]]]
    rows += [(100, None, "xx", "a"), (101, "", "xx", "a"), (102, "12 34 !!", "yy", "a"), (None, LANGS["yy"], None, "a"), (5, rows[5][1], "yy", "a"), (103, (LANGS["xx"] + " ") * 3000, None, "a"), (104, "x" * 100_000, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == rows[i][2] and by[i]["score"] > 0.9 for i in range(60))
    assert [by[i]["lang_pred"] for i in (100, 101, 102, None, 103)] == ["und", "und", "und", "yy", "xx"]
    assert by[100]["score"] == 0 and not by[None]["held_out"] and all(0 <= r["score"] <= 1 for r in got)
    import zlib

    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(60))
    kept = langid.accepted(docs, langid.fit_open(docs))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    with pytest.raises(ValueError):
        langid.accepted(docs.withColumnRenamed("score", "__lang_pred"), langid.fit_open(docs))
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs.select("doc_id", "text", docs["lang"].substr(1, 0).alias("none"), *[]).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_words_with_digits(spark):
    zh, ja = "我们在2024年去了北京并看到了很多人", "私たちは2024年に東京へ行きましたそして"
    docs = spark.createDataFrame([(i, (zh, ja)[i % 2] + "。" * (i // 2), "zj"[i % 2]) for i in range(24)] + [(100 + i, f"見て3{i}", "j") for i in range(20)], "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert all(r["lang_pred"] == "zj"[r["doc_id"] % 2] for r in got if r["doc_id"] < 24)
    # the letters beside digits count, and digits themselves do not
    more = docs.union(spark.createDataFrame([(500, zh + "2024年" * 3, None), (501, "2024", None), (502, "看3", None)], docs.schema))
    by = {r["doc_id"]: r for r in langid.identify(more).collect()}
    assert by[500]["lang_pred"] == "z" and by[500]["score"] > 0.9 and by[501]["lang_pred"] == "und" and by[502]["lang_pred"] != "und"


def small_model(seed):
    words = [b" a", b" ab", b"ab", b"bc", b"abc", b"cab", b"aa", *(bytes([i]) for i in range(256))]
    table = np.vstack([np.random.default_rng(seed).random((len(words), 2)) * 0.01, np.zeros((1, 2))])
    return words, langid.LanguageModel(["p", "q"], np.zeros(2), langid.Pieces.of(words), table)


def test_long_words_sum_all_segmentations():
    words, model = small_model(2)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice(list(b"abc"), n)) for n in (33, 34, 40, 61, 62, 63, 200, 1000, 9001)]
    end = np.cumsum([len(t) for t in texts])
    got = model.word_scores(np.frombuffer(b"".join(texts), np.uint8), end - [len(t) for t in texts], end)
    for row, text in enumerate(texts):
        text = b" " + text
        for g in range(2):
            alpha, lost = [1.0], 0.0
            for j in range(1, len(text) + 1):
                alpha.append(sum(alpha[j - len(w)] * model.table[i, g] for i, w in enumerate(words) if len(w) <= j and text[j - len(w) : j] == w))
                if j % 20 == 0:
                    alpha, lost = [0.0] * (j - 7) + [x / alpha[j] for x in alpha[-8:]], lost + math.log(alpha[j])
            assert math.isclose(got[row, g], math.log(alpha[-1]) + lost, rel_tol=1e-9), len(text)


def test_expected_counts():
    words, model = small_model(4)
    text = b" abcabaa"
    cuts = [c for c in itertools.product((0, 1), repeat=len(text) - 1)]
    want = np.zeros_like(model.table)
    for g in range(2):
        total, counts = 0.0, np.zeros(len(want))
        for c in cuts:
            parts = [x for x in re.split(rb"\0", b"".join(bytes([text[i]]) + (b"\0" if i < len(c) and c[i] else b"") for i in range(len(text))))]
            if all(p in words for p in parts):
                ids = [words.index(p) for p in parts]
                chance = math.prod(model.table[ids, g])
                total += chance
                np.add.at(counts, ids, chance)
        want[:, g] = 3 * counts / total
    data = np.frombuffer(text[1:], np.uint8)
    ((rows, size, found),) = langid.lattices(model.known, data, np.array([0]), np.array([len(data)]), np.array([1]))
    assert np.allclose(langid.expected(size, found, model.table, np.full((1, 2), 3.0)), want)


def test_stretches_end_between_characters():
    text = ("x" * 31 + "京都へ行く" * 20 + " é" * 40).encode()
    word, low, high = langid.stretches(np.frombuffer(text, np.uint8), np.array([0, 3]), np.array([len(text), 9]))
    parts = [text[a:b] for a, b in zip(low, high, strict=True)]
    assert b"".join(parts[:-1]) == text and parts[-1] == text[3:9] and word.tolist() == [0] * (len(parts) - 1) + [1]
    assert max(map(len, parts)) <= 35 and all(p.decode() for p in parts)


def test_ties_go_to_the_smaller_name(spark):
    docs = spark.createDataFrame([(i, "same words here", "ba"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    counts = docs.where(~langid.held_out(docs["doc_id"])).groupBy("lang").count().collect()
    got = {r["lang_pred"] for r in langid.identify(docs).collect()}
    most = max(r["count"] for r in counts)
    assert got == {min(r["lang"] for r in counts if r["count"] == most)}


def test_sample_of_distinct_texts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    xx, yy = LANGS["xx"], LANGS["yy"]
    one = [(f"{xx} {w}", "xx") for w in "abc"] + [(f"{yy} {w}", "yy") for w in "abc"]
    models = [langid.fit(spark.createDataFrame(rows, "text string, lang string"), path, sample_rows=n) for rows, n in ((one, 500), (one * 400, 3), (one * 400, 1))]
    assert np.allclose(models[0].table, models[1].table)
    assert all(np.ptp(models[2].table[:-1], axis=0) > 0.001) and all(np.allclose(m.shares, math.log(0.5)) for m in models)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><script>if (a < b) { "</p>" }</script>
<div class="cookie-notice">We use cookies, a lot of them, on every page that you visit here.</div><!-- <p>no</p> -->
<div id=content><h2>Real &amp; true</h2><div><p>First  paragraph &lt;here&gt;,<br>with a   break.<p>Second <b>bold <i>text</b></i> &copy 2024 goes on and on, for quite some words.</p>
<ul><li>one<li>two</ul><table><tr><td>x<td>y</table></div></div>
<aside>Side bar with text</aside><form><p>Search me</p></form><section class="comments"><p>I disagree with all of it, at length.</p></section><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Real & true\nFirst paragraph <here>, with a break.\nSecond bold text © 2024 goes on and on, for quite some words.\none\ntwo\nx\ny"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<html><body><script>x</script></body>") == ""
    assert html_extract.main_text("plain words") == "plain words"
    assert html_extract.main_text("<form><p>all in a form</p></form>") == "all in a form"
    assert html_extract.main_text("<article><p>cut in the mid") == "cut in the mid"
    assert html_extract.main_text('<article><p title="a > b">ok</p><p class="x>bad</p></article>').startswith("ok")
    assert html_extract.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert html_extract.main_text("<p>" + "long " * 100_000 + "</p>") == ("long " * 100_000).strip()
    assert html_extract.main_text("<body><article><h1>A</h1><p>b</p></article><div class='sidebar'><p>" + "noise " * 500 + "</p></div></body>") == "A\nb"


def test_names_do_not_drop_the_article():
    p = "".join(f"<p>{'words of the article ' * 9}{i}</p>" for i in range(3))
    text = html_extract.main_text(f"<article>{p}</article>")
    side = "<div class='sidebar'><p>side words</p></div><div id='related-posts'><p>other things</p></div>"
    for page in (f"<div class='content-sidebar-wrap'><article>{p}</article>{side}</div>", f"<div class='page has-sidebar'><div>{p}</div>{side}</div>", f"<div id='post' class='no-sidebar comment-enabled'>{p}</div>{side}", f"<div class='widget'><div>{p}</div></div>{side}", f"<div class='widget'><article>{p}</article></div><article><p>teaser</p></article>", f"<main><div><div class='widget'><article>{p}</article></div></div>{side}</main>", f"<article>{p}</article><div class='comments'><article><p>I disagree.</p></article></div>"):
        assert html_extract.main_text(f"<body>{page}</body>") == text, page
    assert len(html_extract.main_text("<div class='ad'>a b</div><div class='promo'>c d</div>")) > 0
    inside = "<p>one <math><mi>x</mi><annotation>tex</annotation></math> two <label>lab</label> <button>but</button> <object>obj</object> <noscript>still</noscript></p>"
    assert html_extract.main_text(f"<body><noscript>Enable it</noscript><article>{inside}</article></body>") == "one x two lab but obj still"


def test_article_in_several_blocks():
    def long(word, n):
        return "".join(f"<p>{(word + str(i) + ' ') * 100}</p>" for i in range(n))

    menu = "<div><a href=x>Home page</a> <a href=y>All the news</a></div>"
    for n in (3, 4, 6):
        for tag in ("div", "section"):
            got = html_extract.main_text(f"<body>{menu}<h1>Title</h1><{tag}>{long('a', n)}</{tag}><p>short one</p><table><tr><td>cell</table><{tag}><h2>Next</h2>{long('b', n)}</{tag}><div>Corp 2024</div></body>")
            lines = [line.split()[0] for line in got.split("\n")]
            assert lines == ["Title", *(f"a{i}" for i in range(n)), "short", "cell", "Next", *(f"b{i}" for i in range(n))], lines
        three = html_extract.main_text(f"<body>{menu}" + "".join(f"<div>{long(w, n)}</div>" for w in "abc") + "</body>")
        assert all(f"{w}{i} " in three for w in "abc" for i in range(n))
    wrapped = html_extract.main_text(f"<body>{menu}<div><div>{long('a', 3)}</div><div>{long('b', 3)}</div></div><div>Corp 2024</div></body>")
    assert "a0" in wrapped and "b2" in wrapped and "Corp" not in wrapped and "Home" not in wrapped


def test_names_weigh_and_density_decides():
    words = "some words of the main text that go on for a while " * 4
    assert html_extract.main_text(f"<div id='related-work'><h2>Related work</h2><p>{words}</p></div>") == f"Related work\n{words.strip()}"
    body = "".join(f"<p>{words}{i}</p>" for i in range(4))
    want = "\n".join(f"{words}{i}" for i in range(4))
    menu = "<div>" + "".join(f"<a href=/{i}>Menu entry {i}</a> " for i in range(9)) + "</div>"
    # neither article nor telling names
    assert html_extract.main_text(f"<body>{menu}<div class=x>{body}</div><div>Corp 2024</div></body>") == want
    # a name tells of the comments, density of the rest
    assert html_extract.main_text(f"<body>{menu}<div class=x>{body}<div class='comments'><p>{words}</p><p>{words}</p></div></div></body>") == want
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    plain = [re.sub(r"(</?)article>", r"\1div>", p).replace(' class="ad"', "") for p in pages]
    same = sum(html_extract.main_text(p) == html_extract.main_text(q) for p, q in zip(pages, plain, strict=True))
    assert same > 0.95 * len(pages)


@pytest.mark.parametrize("page", ["<b>" * 30_000 + "<h1>x</h1>" * 30_000, "<i><article>" + "<b>" * 30_000 + "x</i>" * 30_000, "<b>" * 30_000 + "x</u>" * 30_000, "<td>" * 30_000 + "<p>x" * 30_000, "<div class=ad><p>x" * 30_000])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    assert "x" in html_extract.main_text(page)
    assert time.process_time() - start < 8


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"], len(r["text"])) for r in got) == [(0, 0, 0)] + [(1, len(html_extract.main_text(PAGE)), len(html_extract.main_text(PAGE)))] * 2
    assert html_extract.extract(pages.limit(0)).collect() == []
    raw = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html

    texts = {r["page_id"]: r["text"] for r in html_extract.extract(raw).collect()}
    for r in raw.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
        assert texts[r["page_id"]] == "\n".join(b for b in blocks if b)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")) or name == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    texts = ["a@b.c", "x a.b+c@d-e.f.g@h.i y@z q@@r.s t@u.v", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 999.1.1.1.5.5.5", "4111 1111-1111 1111 and 4111111111111112", "+1 (988) 555-2485 +12345 + 1234567890 +1234567890123456", "é 😀 mail@host.org, 10.0.0.1.", "", "@", "a" * 5000 + "@", "1" * 5000, "+1+1 (2) 345 678 901-"]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("ab12.@+- ()%_é\n"), 60)) for _ in range(3000)]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for t in texts:
        assert pii.base_spans(t) == brute(t), t


def test_disclosing_terms(spark):
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} the common end here" for i in range(300)]
    rows = [(i, filler[i].replace("word", "w"), "s") for i in range(300)]
    rows += [(1000 + i, f"{'lorem ipsum dolor amet'.split()[i]} zanzibar boss@corp.example {'alpha beta gamma delta'.split()[i]} the common end", "s") for i in range(4)]
    rows += [(2000, "copy of rareword me@x.org", "s")] * 5 + [(None, None, "s"), (3000, "", "s"), (3001, "zanzibar alone", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_spans(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in range(4):
        text = rows[300 + i][1]
        at = text.index("zanzibar")
        assert f"term:{at}:{at + 8}" in by[1000 + i]["spans"].split(",") and by[1000 + i]["spans"].count("term") == 1
    assert "term" not in by[2000]["spans"] and by[3001]["spans"] == "" and by[None]["spans"] == ""
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        assert r["base_sha256"] == hashlib.sha256(pii.written(brute(text)).encode()).hexdigest()
    assert "term" not in "".join(r["spans"] for r in pii.find_spans(docs, alpha=2.0).collect())
    # texts with spans under one id, a null id, and repeated rows
    more = [(1, "lorem write to a@b.example now", "s"), (1, "call +1 988 555 2485 ok", "t"), (1, "nothing here", "s"), (None, "call +1 988 555 2485 ok", "s")]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    clean = pii.sanitise(both)
    assert clean.columns == docs.columns
    clean = sorted((str(r["doc_id"]), r["text"] or "", r["spans"]) for r in clean.collect())
    spans = {(r["doc_id"], r["base_sha256"]): r["spans"] for r in pii.find_spans(both).collect()}
    sha = lambda t: hashlib.sha256(pii.written(brute(t or "")).encode()).hexdigest()
    assert clean == sorted((str(i), pii.redact(t or "", spans[i, sha(t)]), s) for i, t, s in rows + more)
    assert ("1000", "lorem [TERM] [EMAIL] alpha the common end", "s") in clean and clean.count(("1", "call [PHONE] ok", "t")) == 1
    with pytest.raises(ValueError):
        pii.sanitise(docs.withColumnRenamed("spans", "__pii_spans"))
    assert pii.redact("abcdef", "email:1:3,ip:2:4") == "a[EMAIL]ef"
    assert pii.find_spans(docs.limit(0)).collect() == []
    by_all = pii.SMALL
    try:
        pii.SMALL = 0
        assert sorted(r["spans"] for r in pii.find_spans(docs).collect()) == sorted(r["spans"] for r in got)
    finally:
        pii.SMALL = by_all


def test_disclosing_terms_of_whole_texts(spark):
    rest = "here is much else to read before the next sentence comes with its own words at last".split()
    rows = [(i, " ".join(rest[i % 5 :]) + f" u{i}") for i in range(300)]
    rows += [(1000 + i, f"x{i} chief@corp.example " + " ".join(rest[i:]) + (" Nr 7781 and agent_7" if i % 2 else " agent_7 then 7781 nr")) for i in range(4)]
    rows += [(2000 + i, "same text ab12 twin@corp.example") for i in range(4)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[300:304]:
        terms = {text[int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in got[i].split(",")) if k == "term"}
        assert terms >= {"nr", "7781", "agent_7"} and f"x{i - 1000}" not in terms and not terms & set(rest)
    assert all("term" not in got[i] for i, _ in rows if i >= 2000)


def test_rare_entities_have_disclosing_terms(spark):
    rest = "here is much else to read before the next sentence comes with its own words at last".split()
    rows = [(i, " ".join(rest[i % 5 :]) + f" u{i}") for i in range(300)]
    once = "order 55013 once more\nseen by z1 from me@x.org for 55013\nand 55013 done"
    lines = "\n".join(["again zz9 by line@x.org"] * 4)
    rows += [(1000, once), (1001, once), (1002, "pair77 here two@x.org"), (1003, "the next has pair77 and two@x.org at last"), (1004, lines)]
    rows += [(1005 + i, "single q4 of copy@x.org") for i in range(5)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {i: [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].split(",")) if k == "term"] for i, text in rows[300:]}
    assert terms[1000] == terms[1001] == ["55013"] * 3
    assert terms[1002] == terms[1003] == ["pair77"]
    assert not any(terms[i] for i in range(1004, 1010))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model"])
def test_vocabulary(name):
    found = langid.vocabulary(public_tokenizers.path(name))
    assert len(set(found)) == len(found) > 30_000 and found[-1] == b"\xff"


def brute_terms(texts, alpha, level):
    """text -> its term spans, by counting over all distinct texts."""
    from collections import Counter

    texts = {t for t in texts if t}
    spans = {t: brute(t) for t in texts}

    def words(t, own):
        return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", t) if not any(a < m.end() and m.start() < b for a, _, b in own)]

    count = {}
    for t in texts:
        lines = "\n".join(dict.fromkeys(t.split("\n")))
        count[t] = Counter(w for _, _, w in words(lines, brute(lines)))
    holds = {t: {t[a:b].lower() for a, _, b in spans[t]} for t in texts}
    kinds = {w for c in count.values() for w in c}
    times = {w: sum(c[w] for c in count.values()) for w in kinds}
    n_term = {w: sum(w in c for c in count.values()) for w in kinds}
    total, running, told = len(texts), sum(times.values()), {}
    for e in {e for h in holds.values() for e in h}:
        own = [t for t in texts if e in holds[t]]
        share = sum(count[t].total() for t in own) / running
        for w in {w for t in own for w in count[t]}:
            n_both = sum(w in count[t] for t in own)
            information = math.log(total / len(own))
            if information <= 0 or math.log(n_both * total / (len(own) * n_term[w])) < alpha * information:
                continue
            q = sum(count[t][w] for t in own) / times[w]
            apart = q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0)
            if q > share and times[w] * apart >= math.log(len(kinds) / level):
                told.setdefault(e, set()).add(w)
    return {t: {(a, b) for a, b, w in words(t, spans[t]) if any(w in told.get(e, ()) for e in holds[t])} for t in texts}


@pytest.mark.parametrize("alpha,level", [(0.8, 0.05), (0.5, 1.0), (0.95, 0.001)])
def test_terms_by_brute_force(spark, alpha, level):
    rng = np.random.default_rng(11)
    common, rare = [f"word{i}" for i in range(40)], [f"clue{i}" for i in range(12)]
    texts = []
    for i in range(220):
        words = list(rng.choice(common, rng.integers(5, 40)))
        if i % 4 == 0:
            who = int(rng.integers(0, 12))
            words.insert(int(rng.integers(0, len(words))), f"user{who}@mail.example")
            if rng.random() < 0.8:
                words += [rare[who]] * int(rng.integers(1, 4))
        elif rng.random() < 0.05:
            words.append(str(rng.choice(rare)))
        texts.append(("\n" if i % 3 else " ").join(words))
    texts += texts[:20] * 3 + ["", None]
    want = brute_terms(texts, alpha, level)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs, alpha, level).collect()}
    found = 0
    for i, t in enumerate(texts):
        terms = {(int(a), int(b)) for k, a, b in (x.split(":") for x in got[i].split(",") if x) if k == "term"}
        assert terms == (want[t] if t else set()), (i, t)
        found += len(terms)
    assert found > 10
