"""Decontamination, sharding, reputation, vectors, token codes, mixing, Jaccard join, pipeline."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import components, decontamination, embedding_dedup, jaccard_join, mixing, sharding, token_codes, url_reputation
from tessera.llm.scratch import fresh_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(60)] + [(7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 5), (5, None), (None, None)], "a long, b long")
    for one_task in (0, 10_000):
        assert {r["node"]: r["root"] for r in components.connected(df, one_task).collect()} == want
    old = components.STORE_FROM
    try:
        components.STORE_FROM = 0
        assert {r["node"]: r["root"] for r in components.connected(df, 0).collect()} == want
    finally:
        components.STORE_FROM = old
    assert components.connected(df.limit(0), 0).collect() == []


def test_masks_see_every_overlap():
    window = decontamination.WINDOW
    for k in range(decontamination.MISSES + 1):
        for misses in itertools.combinations(range(window), k):
            assert any(not any(s + o in misses for o in m) for m in decontamination.MASKS for s in range(window - m[-1]))


def brute_overlaps(docs, items):
    import re

    def tokens(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    out = {}
    for d, text in docs:
        x = tokens(text)
        for i, item in items:
            y = tokens(item)
            for diagonal in range(-len(y) + 1, len(x)):
                same = [j for j in range(len(y)) if 0 <= j + diagonal < len(x) and x[j + diagonal] == y[j]]
                best = max((sum(1 for j in same if s <= j < s + 12) for s in same), default=0)
                if len(y) >= 6 and best >= min(10, len(y)):
                    out[d, i] = max(out.get((d, i), 0), best)
    return out


def test_decontamination(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((5, 6, 9, 10, 14, 30, 30))))) for i in range(16)] + [(98, None), (99, "")]
    docs = []
    for d in range(90):
        words = [rng.choice(vocab) for _ in range(rng.choice((0, 11, 60, 2500 if d % 13 == 0 else 200)))]
        if d % 2:
            passage = rng.choice(items[:16])[1].split()
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.choice((0, len(words), 1020 if len(words) > 1100 else 3))
            words[at:at] = passage
        docs.append((d, " ,".join(w.upper() if d % 3 else w for w in words)))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (None, items[3][1] * 2)]
    frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOC.replace("n_chars", "item_id"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_overlaps(docs, items)
    assert len(want) > 8
    small = decontamination.SMALL
    for bound in (small, 0):
        try:
            decontamination.SMALL = bound
            got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontamination.overlaps(frame, bench).collect()}
        finally:
            decontamination.SMALL = small
        assert got == want
    kept = decontamination.decontaminated(frame, bench)
    assert kept.columns == frame.columns
    more = frame.unionByName(spark.createDataFrame([(None, "all clean", "en", "s", 1), (3, "clean as well", "en", "s", 1)], frame.schema))
    assert decontamination.decontaminated(more, bench).count() == kept.count() + 2
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in docs if d not in {x for x, _ in want})
    assert decontamination.overlaps(frame, bench.limit(0)).collect() == [] and decontamination.overlaps(frame.limit(0), bench).collect() == []


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i * 3, "é" * rng.randrange(50) if i % 7 else None, "x", "y", 1) for i in range(400)] + [(33, "same", "x", "y", 1)] * 90 + [(None, "n", "x", "y", 1)] * 3 + [(5000, "long " * 2000, "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOC.replace("source", "slot")).repartition(5)
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total, end = sum(r["size"] for r in got), 0
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x))
    for shard in range(8):
        own = [r for r in order if r["shard"] == shard]
        assert [r["slot"] for r in own] == list(range(len(own)))
        end += sum(r["size"] for r in own)
        assert abs(end - total * (shard + 1) / 8) <= 10001 / 2 + 1 or shard == 7
    assert sharding.shard_documents(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, docs["n_chars"])


def test_urls(spark):
    urls = ["http://A.Example.COM/de/x", "https://example.net/en/1?q=/x", "https://sub.example.net/fr/", "http://x.org/fr/a#b", "ftp://x.org:21", "x://y://z/p", "no scheme", None, "", "http://", "http://net", "http://evilnet/x", "http://a.co.uk/en/?x", "http://h/p\nq#z"]
    pages = spark.createDataFrame([(i, u, 3) for i, u in enumerate(urls)] + [(3, urls[3], 3), (None, urls[0], 3)], "page_id long, url string, bound int")
    bad = [(100 + i, "http://bad.com/a") for i in range(60)] + [(200 + i, "http://good.com/a") for i in range(60)]
    more = spark.createDataFrame([(*x, 0) for x in bad], pages.schema)
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(None, 0, 1), (100, 1, 1), (7777, 0, None)], "doc_id long, quality int, toxic int")
    got = url_reputation.judge(pages.unionByName(more), url_reputation.label_outcomes(labels)).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(urls) + 2 + 120
    want = [("a.example.com", "/de/x", "example.com/de/", "block"), ("example.net", "/en/1", "example.net/en/", "allow"), ("sub.example.net", "/fr/", "net/", "block"), ("x.org", "/fr/a", "org/fr/", "allow"), ("x.org:21", "", None, None), ("y:", "//z/p", None, None), ("", "", None, None), ("", "", None, None), ("", "", None, None), ("", "", None, None), ("net", "", None, None), ("evilnet", "/x", None, None), ("a.co.uk", "/en/", None, None), ("h", "/p\nq", None, None)]
    for i, (host, path, rule, verdict) in enumerate(want):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule)
        assert by[i]["verdict"] == verdict if verdict else by[i]["verdict"] in ("allow", "block")
    assert by[100]["verdict"] == "block" and by[200]["verdict"] == "allow" and by[100]["mean"] > 0.9 > 0.1 > by[200]["mean"]
    assert url_reputation.judge(pages.limit(0), url_reputation.label_outcomes(labels)).collect() == []
    assert {r["verdict"] for r in url_reputation.judge(more, url_reputation.label_outcomes(labels.limit(0))).collect()} == {"allow"}
    row = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("com",)], "h string").select(url_reputation.domain_of(__import__("pyspark").sql.functions.col("h")).alias("d")).collect()
    assert [r["d"] for r in row] == ["b.co.uk", "b.com", "com"]


def brute_reputations(hosts, z=1.645):
    """host -> (mean, bound) of (host, n, k), by sums over all levels."""

    def weight(groups):
        groups = [g for g in groups if g[0] > 0]
        n, g = sum(x[0] for x in groups), len(groups)
        if n <= g:
            return 10.0
        s = sum((k - n_ * m) ** 2 / (n_ * m * (1 - m)) for n_, k, m in groups)
        rho = max(0.001, min(0.9, (s - g) / (n - g)))
        return (1 - rho) / rho

    total = (sum(k for _, _, k in hosts) + 0.5) / (sum(n for _, n, _ in hosts) + 1)
    keys = [lambda h: h.rsplit(".", 1)[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h]
    above = {h: total for h, _, _ in hosts}
    for key in keys:
        groups = {}
        for h, n, k in hosts:
            g = groups.setdefault(key(h), [0, 0, above[h]])
            g[0] += n
            g[1] += k
        w = weight(groups.values())
        post = {g: (k + w * m, n - k + w * (1 - m)) for g, (n, k, m) in groups.items()}
        above = {h: post[key(h)][0] / sum(post[key(h)]) for h, _, _ in hosts}
    out = {}
    for h, _, _ in hosts:
        a, b = post[h]
        out[h] = (a / (a + b), a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)
    return out


def test_reputations_of_all_levels(spark):
    rng = random.Random(6)
    hosts, pages, labels, page = [], [], [], 0
    for suffix, domain, sub in itertools.product(("com", "net", "org"), "abcd", ("", "x.", "y.")):
        host, bad = f"{sub}{domain}.{suffix}", min(0.95, 0.1 + 0.25 * (suffix == "net") + 0.5 * (domain == "d") + 0.1 * (sub == "x."))
        n = rng.choice((0, 1, 5, 40))
        k = sum(rng.random() < bad for _ in range(n))
        hosts.append((host, n, k))
        for i in range(n + 1):  # one page without a label
            pages.append((page, host))
            if i < n:
                labels.append((page, int(i < k)))
            page += 1
    want = brute_reputations(hosts)
    got = url_reputation.reputations(spark.createDataFrame(pages, "page_id long, host string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert {(r["host"], r["n"], r["k"]) for r in got} == set(hosts)
    for r in got:
        assert abs(r["mean"] - want[r["host"]][0]) < 1e-9 and abs(r["bound"] - want[r["host"]][1]) < 1e-9
    assert any(b > 0.5 for _, b in want.values()) and any(b < 0.2 for _, b in want.values())
    small = url_reputation.SMALL
    try:
        url_reputation.SMALL = 0  # hosts joined by a shuffle
        urls = spark.createDataFrame([(i, f"http://{h}/") for i, h in pages], "page_id long, url string")
        judged = url_reputation.judge(urls, spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()
    finally:
        url_reputation.SMALL = small
    assert len(judged) == len(pages) and all((r["verdict"] == "block") == (want[r["host"]][1] > 0.5) for r in judged)


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    x = np.vstack([base, base[:10] + rng.normal(scale=0.1, size=(10, 8)), base[:5] * 3, np.tile(base[0], (20, 1)), base[1] + rng.normal(scale=0.15, size=(60, 8)), 1e200 * base[2:3]])
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None] + [0.0] * 6, 1), (904, [], 1), (905, [float("inf")] + [1.0] * 7, 1), (906, [1.0, 2.0], 1), (None, base[3].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int")
    ok = [(i, np.array(v + [0.0] * (8 - len(v)))) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.abs(v).max() for _, v in ok])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9) & ~np.eye(len(ok), dtype=bool)
    reach = links | np.eye(len(ok), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = Counter()
    for k, (i, _) in enumerate(ok):
        least = min(ok[j][0] for j in np.flatnonzero(reach[k]) if ok[j][0] is not None)
        want[i, int(links[k].sum()), least, i == least] += 1
    for i in (900, 901, 902, 903, 904, 905):
        want[i, 0, i, True] += 1
    for tile, growth, small in ((4096, 64, 500_000), (16, 64, 500_000), (16, 1, 500_000), (16, 4, 0)):
        monkeypatch.setattr(embedding_dedup, "BLOCK_GROWTH", growth)
        monkeypatch.setattr(embedding_dedup, "SMALL", small)
        got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(frame, tile=tile).collect())
        assert got == want
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []
    assert {r["n_links"] for r in embedding_dedup.near_duplicates(frame.where("vec_id between 900 and 902")).collect()} == {0}
    y = embedding_dedup._unit(rng.normal(size=(200, 64)))
    basis = np.linalg.eigh(y.T @ y)[1][:, ::-1]
    i, j = embedding_dedup.close_pairs(y, y, basis, 0.3, same=True)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(np.triu(y @ y.T >= 0.3, 1)))}


def test_codes():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 70000, 5000).tolist(), [7] * 1025):
        made = token_codes.Codes(token_codes.encode(np.array(ids, np.uint32)))
        assert made.all().tolist() == ids if len(ids) else len(made) == 0
        assert [made[i] for i in range(0, len(ids), 7)] == ids[::7]
    with pytest.raises(ValueError):
        token_codes.Codes(b"nope" + b"\0" * 8)
    with pytest.raises(ValueError):
        token_codes.by_words(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_file(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Hello, world! it's 2024", None, "", "a\u00a0b\u2003c İstanbul Σας e\u0301 <|endoftext|> x<|startoftext|>y", " \t\n ", "日本語 テキスト 😀😀", "word " * 30000, "x" * 5000]
    rows = [(i * 2, t, "en", "s", 1) for i, t in enumerate(texts)] + [(4, "tie b", "en", "s", 1), (4, "tie a", "en", "s", 1), (None, "none", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOC.replace("source", "start")).repartition(3)
    out = fresh_path(spark, "test")
    token_codes.write_tokens(docs, out)
    got = sorted(token_codes.read_index(spark, out).collect(), key=lambda r: r["start"])
    ids = {t: plain.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows}
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start, flat = 0, []
    by_crc = {(i, zlib.crc32(np.array(ids[t], "<u4").tobytes())): ids[t] for i, t, *_ in rows}
    for r in got:
        own = by_crc[r["doc_id"], r["ids_crc32"]]
        assert (r["start"], r["n_tokens"]) == (start, len(own))
        start += len(own)
        flat += own
    for place in (0, 5, start // 2, start - 1):
        assert token_codes.read_token(spark, out, place) == flat[place]
    with pytest.raises(IndexError):
        token_codes.read_token(spark, out, start)
    assert token_codes.round_trip(docs.limit(0)).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: most * sizes[s] for s in capped}
        capped |= over


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(40), "en", rng.choice(["a", "b", "c", "B", None, "hot", "hot", "hot"]), 1) for i in range(1500)]
    rows += [(i, None if i % 2 else "", "en", "empty", 1) for i in range(2000, 2010)] + [(3000, "z " * 900, "en", "one", 1), (None, "n n", "en", "a", 1), (7, rows[7][1], "en", rows[7][3], 1)]
    docs = spark.createDataFrame(rows, DOC.replace("n_chars", "size")).repartition(4)
    got = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken, biggest = Counter(), Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        biggest[s] = max(biggest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] * 1.01 + 1e-6
    assert sorted(map(str, mixing.mix_plan(docs.repartition(2)).collect())) == sorted(map(str, got))
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert words == taken - Counter()
    assert mixing.mix_plan(docs.limit(0)).collect() == [] and mixing.apply_mix(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.apply_mix(docs.withColumnRenamed("lang", "__mix_h"))


@pytest.mark.parametrize("small", [mixing.SMALL, 0])
def test_mixing_of_copies(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL", small)
    text = "w " * 100
    rows = [(None, text, f"x{i}", "a", 1) for i in range(50)] + [(None, text, "x", None, 1)] * 3 + [(None, text, "x", "", 1)] * 2
    rows += [(i, text, "x", "b", 1) for i in range(60)] + [(7, text + "more", "x", "b", 1), (8, text, "x", "a", 1)]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    mixed = Counter()
    for r in mixing.apply_mix(docs).collect():
        mixed[r["source"]] += len(r["text"].split())
    for s in sizes:
        assert abs(mixed[s] - want[s]) <= 102, (s, mixed[s], want[s])
    assert sum(mixed.values()) == sum(r["taken"] for r in got)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    again = mixing.mix_plan(docs.repartition(2, "lang")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def brute_components(rows, percent=80):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = {}
    for (d, *_), x in zip(rows, label, strict=True):
        if d is not None:
            ids[x] = min(ids.get(x, d), d)
    return sorted(((d, len(s), ids.get(x)) for (d, *_), s, x in zip(rows, sets, label, strict=True)), key=str), label, sets


def jaccard_rows():
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(3000)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (60, 80, 120, 6, 5, 4, 1)]
    boiler = [rng.choice(vocab) for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:4]:
        for _ in range(45):
            words = list(b)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append("  ".join(words).upper() if rng.random() < 0.5 else " ".join(words))
    for _ in range(40):
        extra = [rng.choice(vocab) for _ in range(rng.choice((5, 12, 100)))]
        texts.append(" ".join(boiler + extra))
    texts += ["one two", "ONE TWO", "one  two three", None, "", " \t", "É x", "é x", "a b c d e", "a b c d e a b c d e"] + [texts[0]] * 30 + [" ".join(rng.choice(vocab) for _ in range(20000))]
    rng.shuffle(texts)
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[5], "en", "s", 1), (None, "null id only words here now", "en", "s", 1), (3, texts[3], "en", "s", 1)]


@pytest.mark.parametrize("block,wide,hot", [(1024, 8, 64), (8, 8, 3), (8, 1, 2)])
def test_jaccard(spark, block, wide, hot, monkeypatch):
    for name, value in (("BLOCK_ROWS", block), ("WIDE", wide), ("HOT", hot)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = jaccard_rows()
    docs = spark.createDataFrame(rows, DOC.replace("lang", "node").replace("source", "key")).repartition(6)
    want, label, sets = brute_components(rows)
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    if block == 1024:
        kept = jaccard_join.keep_one(docs)
        assert kept.columns == docs.columns
        expected = len({x for x, s in zip(label, sets, strict=True) if s}) + sum(1 for s in sets if not s)
        assert kept.count() == expected
        # repeated rows beside wordless ones that are repeated too: rows without words stay, whatever else is there
        some = [(1, None), (1, None), (2, "one two three"), (None, ""), (None, ""), (1, ""), (4, " ")]
        for extra in ([], [(2, "one two three")], [(2, "one two three")] * 3 + [(3, "ONE two three")]):
            left = jaccard_join.keep_one(spark.createDataFrame([(d, t, f"r{i}") for i, (d, t) in enumerate(some + extra)], "doc_id long, text string, root string")).collect()
            assert Counter((r["doc_id"], r["text"]) for r in left) == Counter(some)
        with pytest.raises(ValueError):
            jaccard_join.keep_one(docs.withColumnRenamed("n_chars", "__lose_id"))
        assert jaccard_join.jaccard_components(docs.limit(0)).collect() == [] and jaccard_join.keep_one(docs.limit(0)).collect() == []


@pytest.mark.parametrize("wide", [8, 0])
def test_jaccard_of_chains_and_common_shingles(spark, wide, monkeypatch):
    for name, value in (("BLOCK_ROWS", 8), ("WIDE", wide), ("HOT", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(8)
    parts = [" ".join(f"c{rng.randrange(10**6)}" for _ in range(25)) for _ in range(91)]
    common = "the same five words everywhere here"
    # each shares half of its words with the next one, all share a passage, and a few are near copies
    texts = [f"{parts[i]} {common} {parts[i + 1]}" for i in range(90)]
    texts += [texts[i] + " and more" for i in range(0, 90, 9)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want, _, _ = brute_components(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert len({r["component_id"] for r in got}) == 90


def test_counted_in_a_chunk(monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    tokens, owner = np.array([4, 4, 7, 7, 7, 9, 9, 9, 9], np.uint64), np.array([0, 1, 0, 2, 3, 0, 1, 2, 3], np.uint16)
    t, o, w, (hot, bounds, held) = jaccard_join._counted_here(tokens, owner)
    assert t.tolist() == [4, 4, 7, 9] and o.tolist() == [0, 1, 65535, 65535] and w.tolist() == [1, 1, 3, 4]
    assert hot.tolist() == [7, 9] and bounds.tolist() == [0, 3, 7] and held.tolist() == [0, 2, 3, 0, 1, 2, 3]
    t, o, w, (hot, bounds, held) = jaccard_join._counted_here(tokens[:0], owner[:0])
    assert len(t) == len(o) == len(w) == len(hot) == len(held) == 0


def test_overlap_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(70)]
    want = np.array([[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (jaccard_join._overlaps(sets) == want).all()


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    vocab = {"en": "the of and house river green walks slowly under bridge".split(), "de": "der die und haus fluss grün geht langsam unter brücke".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) + rng.choice("abcdefghij") * 2 for _ in range(60)), lang, f"s{i % 3}", 1) for i in range(120) for lang in ["en" if i % 2 else "de"]]
    item = " ".join(f"q{i}uiz" for i in range(30))
    rows += [(500, rows[0][1], "de", "s0", 1), (501, rows[1][1] + " tail", "en", "s1", 1), (502, rows[2][1] + " " + item, "de", "s2", 1), (503, "123 456", "en", "s0", 1), (504, None, "en", "s0", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "shards":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(Counter(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert set(seen[0]) == {r[0] for r in rows} - {503, 504}
    assert set(seen[1]) == set(seen[0]) - {500, 501}
    assert set(seen[2]) == set(seen[1]) - {502}
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 3 and seen[4] == seen[3]
    assert sorted(r["shard"] for r in docs.select("shard").distinct().collect()) == list(range(8))
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r["doc_id"] for r in final.collect()) == seen[4]


def test_pipeline_cases(spark, tmp_path):
    """Empty tables, repeated rows that differ in other columns, null ids and clashing names, through every stage."""
    rng = random.Random(10)
    vocab = {"en": "the of and house river green walks slowly under bridge".split(), "de": "der die und haus fluss grün geht langsam unter brücke".split()}
    text = {i: " ".join(rng.choice(vocab["en" if i % 2 else "de"]) + rng.choice("abcdefghij") * 2 for _ in range(40)) for i in range(60)}
    item = " ".join(f"q{i}uiz" for i in range(20))
    clash = DOC + ", shard_ string, node long, root string, key int, taken int, score double, lang_pred string, item_id long, h string, budget string, part int"
    tail = ("s", 1, "r", 2, 3, 0.5, "l", 4, "h", "b", 5)
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 2}" if i % 5 else None, 1, *tail) for i, t in text.items()]
    rows += [(5, text[5], "en", "other", 9, *tail), (5, text[5], "en", "s1", 7, *tail), (None, text[6] + " more", "de", "s0", 1, *tail), (None, "tail " + item, "en", "s0", 1, *tail), (None, " ".join(text[i] for i in (7, 9, 11)), "en", "s0", 1, *tail)]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, some in (("full", rows), ("empty", [])):
        docs = spark.createDataFrame(some, clash)
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, docs, str(tmp_path))
            if stage != "shards":
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}_{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}_{stage}")
            left = Counter((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()) if stage != "shards" else left
            if name == "full" and stage == "near_duplicates":
                assert left[5, text[5]] == 1 and sum(v for (d, _), v in left.items() if d is None) == 2
            if name == "full" and stage == "benchmark_decontamination":
                assert sum(v for (d, _), v in left.items() if d is None) == 1 and len(left) == 61
        assert docs.count() == sum(left.values()) and (name == "full") == bool(left)
