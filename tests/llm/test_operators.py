"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from evidentia.operators.components import components
from evidentia.llm import ann, bpe, langid, licenses, mixing, neardup, phrases, toxicity, url_filter, warc

#: Columns whose names clash with the operators' own.
EXTRA = "score double, size long, key string, rep long, host string, verdict string, _k string, text2 string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
X = (0.5, 1, "k", 2, "h", "v", "u", "t")
LONG = "lorem ipsum dolor " * 8000
TEXTS = [None, "", " \t\n", "one", "a b c d e", "same words in this very text", "same words in this very text", LONG, "x" * 5000, "\U0001f600 emoji éè text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", 0, *X) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here at all", None, None, None, *X)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0, 1 if i == 4 else 0) for i in range(8)] + [(None, None, None), (9, None, None)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.limit(0)


def test_operators_take_edge_cases(docs, labels):
    model, lang = toxicity.fit(docs, labels), langid.fit(docs)
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    runs = {
        "toxicity": lambda d: toxicity.score_documents(d, model),
        "langid": lambda d: langid.identify(d, lang),
        "mixing": mixing.mix,
        "phrases": phrases.fingerprint_documents,
        "neardup": neardup.near_duplicates,
        "bpe": lambda d: bpe.encode_documents(d, vocabulary, public_tokenizers.PATTERN),
    }
    for name, run in runs.items():
        assert run(docs).count() == len(TEXTS) + 2, name
        assert run(empty(docs)).count() == 0, name
    assert licenses.scan_documents(docs).count() == 0
    assert toxicity.fit(empty(docs), empty(labels)).score(set()) < 0.01
    assert langid.fit(empty(docs)).predict(["word"]) == (["und"], [0.0], [0.0])
    und = {r["doc_id"] for r in langid.identify(docs, lang).where("lang_pred = 'und'").collect()}
    assert {0, 1, 2} <= und


def test_url_rules(spark):
    urls = [
        "http://x.example.com/en/1", "http://WWW.Example.com/en/1", "http://example.com/de", "http://a.net/es/?q", "http://net/fr/", "http://a.net", "nothing", None,
        "http://notexample.org/en/#x", "https://evil.com?x=/en/",
    ]
    pages = spark.createDataFrame([(i, u, *X) for i, u in enumerate(urls)] + [(0, urls[0], *X)], f"page_id long, url string, {EXTRA}")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")], "host string, path string, verdict string")

    def brute(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in rules.collect() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    want = sorted(map(str, [(i, brute(u)) for i, u in enumerate(urls)] + [(0, brute(urls[0]))]))
    for limit in (8 << 20, 0):  # by broadcast, and by salted shuffle
        got = url_filter.judge_urls(pages, rules, broadcast_bytes=limit).collect()
        assert sorted(str((r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"]))) for r in got) == want
    assert url_filter.judge_urls(pages, rules.limit(0)).count() == len(urls) + 1


def as_rows(x):
    text, ids = np.nonzero(x)
    return toxicity.Rows(ids, text, len(x), x.shape[1])


def test_nnpu_learns_markers():
    rng = np.random.default_rng(1)
    x = (rng.random((2000, 20)) < 0.2).astype(np.float32)
    y = x[:, 0] > 0
    w, b = toxicity.nnpu(as_rows(x[y][:150]), as_rows(x), np.ones(20), float(y.mean()))
    assert w[0] > 3 * np.abs(w[1:]).max() and ((x @ w + b > 0) == y).mean() > 0.95
    rows = as_rows(x)
    assert np.allclose(rows.dot(w), x @ w) and np.allclose(rows.back(x[:, 1].astype(float)), x[:, 1] @ x) and np.allclose(rows.only(y).dot(w), x[y] @ w)


def test_toxicity_held_out(spark):
    """Markers are found in texts that nothing was learnt from, and scores are those of a plain sum over the text's features."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(1500):
        bad = rng.random() < 0.15
        t = [rng.choice(words) for _ in range(40)] + (["vilesome"] if bad else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        if i % 2:
            marks.append((i, 0, int(bad)))
    rows += [(1500, ""), (1501, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(d, model).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    assert all(got[i]["predicted"] == int("vilesome" in (t or "")) for i, t in rows)
    for i, t in rows:
        z = model.slope * (model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(t or "", {}))) + model.offset
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    assert {r["doc_id"] for r in toxicity.keep_clean(d, model).collect()} == {i for i, t in rows if "vilesome" not in (t or "")}


def test_language_held_out(spark):
    parts = {"en": "the of and ing tion", "de": "der und ung sch ein", "fr": "le eau oux que ai", "es": "el cion los ado que"}
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(2)) for _ in range(30)), lang) for i, lang in enumerate(rng.choices(list(parts), k=600))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    odd = spark.createDataFrame([(9001, "zxqj wvkkq qzzx jjwq xkcd vvwq"), (9002, "1234 !?"), (9003, None)], "doc_id long, text string")
    every = {r["doc_id"]: r for r in langid.identify(d.select("doc_id", "text").unionByName(odd), model).collect()}
    own = {i: v for i, _, v in rows}
    assert np.mean([every[i]["lang_pred"] == v for i, v in own.items() if every[i]["held_out"]]) > 0.97
    for i, t, _ in rows[:40]:  # the vote, pair by pair
        x = langid.histograms([t])[0][0]
        sure = [1 / (1 + np.exp(-k * (x @ w + b))) for w, b, k in zip(model.weights, model.bias, model.slope, strict=True)]
        family = model.families[max(range(len(model.families)), key=lambda f: sum(sure[k] if a == f else 1 - sure[k] for a, b, k in model.between if f in (a, b)))]
        names = model.languages[family]
        best = max(range(len(names)), key=lambda f: sum(sure[k] if a == f else 1 - sure[k] for a, b, k in model.within[family] if f in (a, b)))
        assert every[i]["lang_pred"] == names[best]
    kept = {r["doc_id"] for r in langid.keep_known(d.select("doc_id", "text").unionByName(odd), model).collect()}
    assert kept == {i for i, r in every.items() if r["typical"] > 0} and not {9001, 9002, 9003} & kept and len(kept) >= 0.99 * len(rows)


def test_mixing_comes_near_targets(spark):
    rng = random.Random(4)
    d = spark.createDataFrame([(i, "w " * rng.randint(0, 9), rng.choice(["a", "b", "b", "b", None])) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(d).collect()
    by = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        t = by.setdefault((r["source_size"], r["target"]), [0])
        t[0] += r["taken"]
    assert all(abs(taken[0] - target) <= 9 for (_, target), taken in by.items())
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-6 or any(abs(t - 3 * s) < 1e-6 for s, t in by)
    assert sorted(map(str, mixing.mix(d.repartition(7)).collect())) == sorted(map(str, rows))


M = (1 << 64) - 1


def plain_mix(x):
    for shift, by in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        x = ((x ^ (x >> shift)) * by) & M
    return x ^ (x >> 33)


def plain_parse(sym, salt):
    """One level of the parse, symbol by symbol: phrase names."""
    runs = []
    for x in sym:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    s = [x if n == 1 else plain_mix((x + plain_mix(n + salt)) & M) for x, n in runs]
    lowest = lambda v: (v & -v).bit_length() - 1
    label = []
    for i, x in enumerate(s):
        low = lowest(1 if i == 0 else (x ^ s[i - 1]) or 1)
        label.append(2 * low + (x >> low & 1))
    for _ in range(3):
        before = [label[0] ^ 1, *label[:-1]]
        label = [2 * (k := min(lowest((a ^ b) | 128), 6)) + (b >> k & 1) for a, b in zip(before, label, strict=True)]
    for colour in (5, 4, 3):
        label = [min({0, 1, 2} - {label[i - 1] if i else 7, label[i + 1] if i + 1 < len(label) else 7}) if v == colour else v for i, v in enumerate(label)]
    starts = [i for i in range(len(s)) if i == 0 or (i + 1 < len(s) and label[i - 1] < label[i] > label[i + 1])]
    gold = 0x9E3779B97F4A7C15
    return [plain_mix((sum(plain_mix((x + (k + 1) * gold) & M) for k, x in enumerate(s[a:b])) + salt) & M) for a, b in zip(starts, [*starts[1:], len(s)], strict=True)]


def plain_sketch(text):
    """Counts and least hashes by level, of names of which a repeat is another name."""
    sym, out = [ord(c) for c in text], []
    for level, kept in enumerate(phrases.KEPT):
        sym = plain_parse(sym, level + 1) if sym else []
        seen, names = {}, set()
        for x in sym:
            high = x >> 32
            names.add(plain_mix((high + (seen.get(high, 0) << 32)) & M) >> 32)
            seen[high] = seen.get(high, 0) + 1
        out.append((len(sym) if level == 0 else len(names), sorted(names)[:kept]))
    if out[1][0] >= 4 * phrases.ENOUGH[1]:
        out[0] = (out[0][0], [])
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    kept = [i for i in range(3) if a[i][1] and b[i][1]]
    full = [i for i in kept if min(a[i][0], b[i][0]) >= phrases.ENOUGH[i]]
    if not kept:
        return 0.0
    i = full[-1] if full else kept[0]
    union = sorted(set(a[i][1]) | set(b[i][1]))[: phrases.KEPT[i]]
    return len(set(a[i][1]) & set(b[i][1]) & set(union)) / len(union)


def test_fingerprints_against_a_plain_parse(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde é\U0001f600") for _ in range(rng.choice([0, 1, 5, 30, 120, 400]))) for _ in range(60)]
    ids = rng.sample(range(10**6), 60)
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in phrases.fingerprint_documents(d, rows=7).collect()}
    order = sorted(zip(ids, texts, strict=True))
    shown = lambda s: ".".join(f"{n}:{''.join(f'{x:08x}' for x in names)}" for n, names in s)
    for i, (k, t) in enumerate(order):
        u = order[(i + 1) % 60][1]
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        own, changed, following = map(plain_sketch, (t, e, u))
        assert got[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[k]["n_chars"] == len(t)
        assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (shown(own), shown(changed))
        assert (got[k]["near_edited"], got[k]["near_next"]) == (plain_likeness(own, changed), plain_likeness(own, following))


def test_equal_substrings_share_names():
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    a, b = phrases.sketches(["qq" + body, "some other beginning" + body])
    assert phrases.likeness(a, b) > 0.9


def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16))
    x[300:400] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(6000, [1e39] + [0.0] * 15), (5900, [1e39, 1e38] + [0.0] * 14), (5800, [1e-200] * 16), (5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0]), (None, [1.0] * 16), (5005, [1.0] * 15 + [None])]
    d = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 1500, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(1500), dist)) if i != q][:10]
        mine = [v for _, v, _ in sorted(got[q])]
        hit += len(set(want) & set(mine))
        if q in (200, 300):
            assert mine == want
    assert hit >= 0.9 * 150
    # large and small vectors are queries and candidates like others, and change no other answer
    assert {len(got[q]) for q in (5800, 5900, 6000)} == {10} and sorted(got[6000])[0][:2] == (1, 5900) and abs(sorted(got[6000])[0][2] / 1e38 - 1) < 1e-12
    assert all(v not in (5900, 6000) for q in range(0, 1500, 100) for _, v, _ in got[q])
    assert ann.search(d.limit(0)).count() == 0


def brute_components(rows, percent, size=5):
    def sh(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        n = min(size, len(w))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()

    s = {i: sh(t) for i, t in rows}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in keys}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 500)}" for _ in range(120)]
        for _ in range(rng.choice([1, 2, 5, 80])):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = f"n{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 3, " ".join(t)))
    rows += [(10_000, ""), (10_001, None), (10_002, "Two Words"), (10_003, "two words")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"block": 8, "mass": 2000}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(d, percent=85, **options).collect()}
        assert got == brute_components(rows, 85)


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of a Jaccard of 0.80: 80 words in common and 10 of each text's own."""
    pairs = 2000
    rows = [(2 * i + k, " ".join([f"c{i}w{j}" for j in range(80)] + [f"d{i}k{k}w{j}" for j in range(10)])) for i in range(pairs) for k in (0, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert neardup.near_duplicates(d, size=1).where("kept").count() == pairs
    for percent in (5, 50, 80, 85, 95, 100):
        trees, depth, positions = neardup.forest(percent / 100, 128, 1e-5)
        assert neardup.miss_rate(percent / 100, trees, depth) <= 1e-5 and trees * depth <= positions
        orders = neardup._orders(positions, trees, depth)
        assert len(set(orders[:, :depth].ravel())) == trees * depth and all(len(set(row)) == len(row) for row in orders)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, "chain").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100}


def test_bpe_is_the_merges():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = bpe.codec(f.read(), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(9)
    for k in range(3000):
        s = "".join(rng.choice("abcdthing é日本\n\t0123'.s\U0001f600") for _ in range(rng.randint(0, 60)))
        ids = own.encode(s)
        assert list(array("I", ids)) == other.encode_ordinary(s) and own.decode(ids) == s.encode()
    assert list(array("I", own.encode("ab" * 20000))) == other.encode_ordinary("ab" * 20000)


def test_bpe_query_columns(spark):
    """The digests of the query, text by text, against the library."""
    ranks = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "one two\n three", "one two\n three", "é日本 \U0001f600 don't 12345", "x" * 3000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_documents(d.coalesce(1), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = other.encode_ordinary(t or "")
        raw = array("I", ids).tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], bytes(got[i]["ids"])) == (len(ids), hashlib.sha256(raw).hexdigest(), raw)
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_license_spans(spark):
    text = "intro words here\n" + licenses.TEMPLATES["MIT"].replace("free of charge", "without charge") + "\nend. All rights\n reserved."
    d = spark.createDataFrame([(1, text), (2, "nothing of that kind"), (3, None)], "doc_id long, text string")
    rows = licenses.scan_documents(d).collect()
    assert {(r["doc_id"], r["license"]) for r in rows} == {(1, "MIT"), (1, "All-rights-reserved")}
    mit = next(r for r in rows if r["license"] == "MIT")
    assert 0.95 < mit["coverage"] < 1 and text[mit["span_start"] : mit["span_end"]].startswith("Permission is hereby")


def test_license_repeats(spark):
    """Each of several notices near each other is reported, also after partial ones."""
    apache = licenses.TEMPLATES["Apache-2.0-line"]
    texts = ["Copyright 2020 A. All rights reserved. Copyright 2021 B. All rights reserved.", "All rights reserved.\n" * 50, "under the apache one two three four five six seven " * 3 + apache]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["doc_id"], r["license"], texts[r["doc_id"]][r["span_start"] : r["span_end"]]) for r in licenses.scan_documents(d).collect()]
    assert sorted(got) == [(0, "All-rights-reserved", "All rights reserved")] * 2 + [(1, "All-rights-reserved", "All rights reserved")] * 50 + [(2, "Apache-2.0-line", apache[:-1])]


def test_license_finds_what_aligning_everywhere_finds():
    index = licenses.build_index(licenses.TEMPLATES, 0.8)
    for text, name, coverage in [
        ("Released under the terms of the MIT License.", "MIT-line", 1.0),
        ("Licensed under the terms of the Apache License, Version 2.0.", "Apache-2.0-line", 1.0),
        ("Released under an MIT License.", "MIT-line", 0.8),
    ]:
        assert (name, coverage) in [r[:2] for r in licenses.scan_text(text, index, 8, 0.8)]
    rng = random.Random(10)
    total = 0
    for _ in range(12):
        text = []
        for _ in range(rng.randint(1, 4)):
            for w in index.words[rng.choice(sorted(index.words))]:
                text += [w] * (rng.random() > 0.1) + ["the"] * (rng.random() < 0.1) + ["other"] * (rng.random() < 0.1)
        want = set()
        for name, words in index.words.items():
            found = set()
            for shift in range(-len(words) - 8, len(text) + 9):
                near = {i: [j for j in range(max(0, i + shift - 8), min(len(text), i + shift + 9)) if text[j] == w] for i, w in enumerate(words)}
                found |= {(a, b, n) for b, (n, a) in licenses.align(near, 64).items() if n / len(words) >= 0.8}
            want |= {(name, n, *(sum(len(w) + 1 for w in text[:k]) for k in (a, b))) for a, b, n in licenses.apart(found)}
        got = licenses.scan_text(" ".join(text), index, 8, 0.8)
        assert {(name, n, a, " ".join(text).rfind(" ", 0, b) + 1) for name, _, n, a, b in got} == want
        total += len(want)
    assert total > 12


def test_warc_round_trip(spark):
    big = "z" * 300_000
    rows = [(3, "http://a", "x"), (1, "http://b", "x"), (2, "http://c", big), (7, None, None), (8, "u\r\nv", ""), (5, "d", big), (None, "e", "n"), (9, "f", "é")]
    pages = spark.createDataFrame([(*r, *X) for r in rows], f"page_id long, url string, html string, {EXTRA}")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for k, _, h in rows:
        body = (h or "").encode()
        same = [i for i, _, o in rows if i is not None and (o or "").encode() == body]
        first = min(same) if same else None
        assert got[k]["payload_bytes"] == len(body)
        assert got[k]["payload_digest"] == __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if k is None or k == first else ("revisit", first))
    archives = warc.write_archives(pages, warc.fresh_dir(spark, "test"))
    chunks = warc.read_archives(spark, archives).where("page = '2'").orderBy("chunk").collect()
    assert len(chunks) > 3 and b"".join(r["payload"] for r in chunks) == big.encode()
    assert [r["last"] for r in chunks].count(True) == 1 and chunks[-1]["payload_digest"] == chunks[-1]["declared_digest"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, labels, tmp_path):
    """Each stage against a plain version, on tables with nulls, repeats and columns of clashing names, and on empty ones."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clash = "_same string, _plan_source string, _plan_whole int, _plan_low int, _plan_copy int, _low int, _copies int, _whole int"
    more = [f"cast(1 as {c.split()[1]}) as {c.split()[0]}" for c in clash.split(", ")]
    docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", *more).write.parquet(str(tmp_path / "documents.parquet"))
    now, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    rows = [tuple(r) for r in now.collect()]
    plain = lambda df: sorted(map(str, map(tuple, df.collect())))
    model = toxicity.fit(now, labels)
    clean = corpus_pipeline.drop_toxic(spark, now, sf)
    assert clean.columns == now.columns and plain(clean) == sorted(str(r) for r in rows if model.score(toxicity.features(r[1] or "", {})) < 0.3)
    lang = langid.fit(now)
    known = [r for r in rows if (p := lang.predict([r[1] or ""]))[0][0] != "und" and p[2][0] > 0]
    assert plain(corpus_pipeline.drop_unknown_language(spark, now, sf)) == sorted(map(str, known))
    first = brute_components([(r[0], r[1]) for r in rows if r[0] is not None], 80)
    want = {str(r) for r in rows if r[0] is None or first[r[0]][1] == r[0]}
    assert plain(corpus_pipeline.drop_near_duplicates(spark, now, sf)) == sorted(want)
    mixed = corpus_pipeline.mix_sources(spark, now, sf)
    times = {r["doc_id"]: r["copies"] for r in mixing.mix(now).collect()}
    assert mixed.columns == now.columns and plain(mixed) == sorted(str(r) for r in rows for _ in range(times[r[0]]))
    assert all(n <= 3 for i, n in times.items() if i in (0, 1, 2))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = bpe.codec(f.read(), public_tokenizers.PATTERN)
    tokens = corpus_pipeline.encode(spark, now, sf)
    assert sorted(bytes(r["ids"]) for r in tokens.select("ids").collect()) == sorted(own.encode(r[1] or "") for r in rows)
    assert corpus_pipeline.run(spark, sf).count() > 0
    none = now.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
