"""Operators without an SQL form, against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import neardup, queries, secrets, sharding, sitetree, substrings, tokens, toxicity
from tests.llm import brute, corpus

SF = "/root/testdata/sf0.001"


def _key(r):
    return tuple((x is None, str(x)) for x in r)


# 2: duplicate strings
@pytest.mark.parametrize("many", [substrings.MANY, 1])
def test_duplicate_strings(spark, many):
    rng = random.Random(2)
    data = [(r[0], r[1]) for r in corpus.rows()]
    long = "".join(rng.choice(data)[1] or "" for _ in range(60))
    data += [(2000, long), (2001, "x" + long[500:] + long[:900]), (2002, "ab" * 300), (2003, "é" * 300), (2002, "cd" * 90)]
    got = substrings.dedup(spark.createDataFrame(data, "doc_id bigint, text string"), many=many)
    assert sorted(map(tuple, got.collect()), key=str) == brute.repeated_strings(data)


def test_duplicate_strings_in_pieces(monkeypatch):
    raw = [bytes(random.Random(3).choices(b"abc ", k=3000))]
    whole = {int(p) + i for p, n in zip(*[substrings.runs(raw)[k] for k in ("p", "n")], strict=True) for i in range(n)}
    monkeypatch.setattr(substrings, "_BLOCK", 400)
    parts = [int(p) + i for p, n in zip(*[substrings.runs(raw)[k] for k in ("p", "n")], strict=True) for i in range(n)]
    assert sorted(parts) == sorted(whole) == list(range(3000 - substrings.LENGTH + 1))


def test_no_documents_have_no_duplicate_strings(spark):
    assert substrings.dedup(corpus.frame(spark, [])).collect() == []


# 3: pages
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x"><header><h1>Site</h1></header>'
    '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id="ad-1">Buy</div>'
    "<article><header><h1>The &amp; title</h1></header><p>First <b>bold<br>part<p>Second&nbsp;  one &lt;x&gt;"
    '<script>var a = "</p><p>no";</script><aside>Side</aside><form>Mail <input></form><!-- <p>hidden</p> -->'
    '<ul><li>Point one<li>Point <i>two</i></ul><div class="share">Share it</div><table><tr><td>a</td><td>b</td></tr></table>'
    '<section id="comments"><p>Nice post</p></section></article><aside class="sidebar">Links</aside><footer>&copy; me</footer></body></html>'
)


def test_main_text():
    assert sitetree.main_text(PAGE) == "The & title\nFirst bold part\nSecond one <x>\nPoint one\nPoint two\na b"
    assert sitetree.main_text(None) == sitetree.main_text("") == sitetree.main_text("<p>  </p>") == ""
    assert sitetree.main_text("<p>plain &eacute;<p>two") == "plain é\ntwo"
    assert sitetree.main_text("a < b and <unclosed") == "a < b and <unclosed"
    assert sitetree.main_text('<p class="x>broken</p><p>ok</p>').endswith("ok")


def test_repeated_branches_are_cut_by_their_entropy(spark):
    def page(i):
        body = f"<div class=c0><p>Own words of page {i} about thing {i * 7}</p></div>"
        return f"<html><body><div class=c1><span>All rights</span></div>{body}<div class=c2><p>Same on all</p></div></body></html>"

    data = [(i, f"http://h.example/{i}", page(i)) for i in range(30)] + [(100, "http://few.example/", page(5)), (101, None, None), (102, "::", "")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    out = {r.page_id: r.text for r in sitetree.extract(pages).collect()}
    assert out[3] == "Own words of page 3 about thing 21"
    assert out[100] == "All rights\nOwn words of page 5 about thing 35\nSame on all"
    assert out[101] == out[102] == ""


def _framed(body, menu="Menu"):
    return f"<html><body><div class=c1><span>{menu}</span></div>{body}<div class=c2><p>Same on all</p></div></body></html>"


@pytest.mark.parametrize("tag", ["article", "div class=text"])
def test_copies_of_pages_are_no_boilerplate(spark, tag):
    def body(i):
        return f"<{tag}><h1>Title {i}</h1><p>Words of article {i}</p></{tag.split()[0]}>"

    data = [(i, "http://one.example/", _framed(body(0))) for i in range(12)]
    data += [(100 + i, "http://five.example/", _framed(body(i % 5), f"Menu {i // 50}")) for i in range(100)]
    data += [(300 + i, "http://many.example/", _framed(body(i % 11))) for i in range(990)]
    out = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(data, "page_id bigint, url string, html string")).collect()}
    for first, n, articles in ((0, 12, 1), (100, 100, 5), (300, 990, 11)):
        for i in range(n):
            assert f"Title {i % articles}\nWords of article {i % articles}" in out[first + i]
    assert out[300] == "Title 0\nWords of article 0"


def test_repeated_branches_inside_an_article_are_cut(spark):
    def page(i):
        rare = "<div class=quote><p>Quoted words</p></div>" if i < 3 else ""
        own = f"<p>Own words of page {i}</p>{rare}<article class=comment><p>Reader {i} says so</p></article>"
        return f"<html><body><main><div class=left-col><p>Same menu</p></div><div class=body>{own}</div></main></body></html>"

    data = [(i, "http://h.example/", page(i)) for i in range(30)]
    data += [(100 + i, "http://copies.example/", page(i % 4)) for i in range(40)]
    out = {r.page_id: r.text for r in sitetree.extract(spark.createDataFrame(data, "page_id bigint, url string, html string")).collect()}
    assert out[7] == "Own words of page 7" and out[1] == "Own words of page 1\nQuoted words"
    assert out[103] == "Same menu\nOwn words of page 3"  # four distinct pages are too few to tell
    assert sitetree.main_text("<main><div class=a><p>All</p></div></main>", frozenset({"/main/div.a"})) == "All"


def test_an_article_stays_where_the_branch_around_it_is_cut():
    page = "<html><body><div class=c>Menu<article><p>Text</p></article></div></body></html>"
    assert sitetree.main_text(page, frozenset({"/html", "/html/body", "/html/body/div.c"})) == "Text"


def test_pages_keep_other_columns_and_repeats(spark):
    data = [(1, "http://a/", PAGE, "x", 5)] * 2
    out = sitetree.extract(spark.createDataFrame(data, "page_id bigint, url string, html string, text string, `c0` int"))
    assert out.columns == ["page_id", "url", "html", "c0", "text", "n_chars"]
    rows = out.collect()
    assert rows[0] == rows[1] and rows[0].n_chars == len(rows[0].text)
    assert sitetree.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


# 5: shards
def test_shards(spark):
    data = corpus.rows()
    out = sharding.assign(corpus.clashing(spark), keep=["doc_id", "text"]).collect()
    assert len(out) == len(data)
    slots = {}
    of_id = {}
    for r in out:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        assert of_id.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(corpus.frame(spark, [])).collect() == []


def test_shards_by_weight_and_movement_within_the_changed_subtree(spark):
    ids = spark.range(40_000).select(F.col("id").cast("string").alias("d"))
    old = [[[1.0, 1.0], [2.0]], [[1.0], [3.0]]]
    new = [[[1.0, 1.0], [2.0]], [[1.0], [5.0]]]
    moved = sharding.shard(sharding.shard(ids, F.col("d"), old, "a"), F.col("d"), new, "b").cache()
    share = {r.a: r["count"] / 40_000 for r in moved.groupBy("a").count().collect()}
    assert all(abs(share[i] - w / 8) < 0.01 for i, w in enumerate([1, 1, 2, 1, 3]))
    # documents move only into the region whose weight grew, or within it into its rack
    assert moved.filter("a <> b AND b < 3").count() == 0
    assert moved.filter("a = 3 AND b <> 3 AND b <> 4").count() == 0


# 6: token files
def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokens.public_tokenizer(spark)
    data = corpus.rows() + [(3000, "á b c d ́x it's WE'RE <|endoftext|> \x1c İ ΣΣ", None, None, 0)]
    got = tokens.encode_corpus(corpus.frame(spark, data), path).collect()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want = []
    for r in data:
        ids = plain.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=_key) == sorted(want, key=_key)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == [0, *np.cumsum([r.n_tokens for r in in_order])[:-1].tolist()]
    ids = [r.doc_id for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert tokens.encode_corpus(corpus.frame(spark, []), path).collect() == []


def test_literal_added_tokens_have_their_own_ids(spark, tmpdir_path):
    from tokenizers import Tokenizer

    path = tokens.public_tokenizer(spark)
    texts = ["a <|endoftext|> b", "in<|startoftext|>side <|ENDOFTEXT|>", None, "", "plain <|endoftext |> text", "<|endoftext|>" * 3, "it's é"]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID] for t in texts]
    ids, at = tokens.Encoder(path, literals=True).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmpdir_path}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op6_token_files(spark, tmpdir_path).collect()}
    starts = np.cumsum([0, *map(len, want)]).tolist()
    assert got == {i: (starts[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)}


def test_encoder_forgets_and_still_agrees(spark, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    enc = tokens.Encoder(tokens.public_tokenizer(spark))
    texts = [r[1] for r in corpus.rows()[:10]]
    once = enc.encode(texts)[0].tolist()
    assert enc.encode(texts)[0].tolist() == once


# 7: toxicity
def test_gradients():
    net = toxicity.Network.fresh(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    vocabulary, index, ends = toxicity.split(["one two three idiot", "four five", ""])
    words = toxicity.Words.of(vocabulary)
    start, length, doc = toxicity.windows(ends)
    at = toxicity._places(index, start, length, len(words.word))
    y = np.array([1.0, 0.0, 1.0])
    _, g = net.gradients(at, y, words)
    rng = np.random.default_rng(1)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        pick = np.flatnonzero(g[k].reshape(-1))
        for i in rng.choice(pick, min(4, len(pick)), replace=False):
            keep, e = flat[i], 1e-3
            flat[i] = keep + e
            up = net.gradients(at, y, words)[0]
            flat[i] = keep - e
            down = net.gradients(at, y, words)[0]
            flat[i] = keep
            assert abs((up - down) / (2 * e) - g[k].reshape(-1)[i]) < 2e-3


def test_windows_cover_every_word():
    start, length, doc = toxicity.windows(np.array([0, 5, 5 + 32, 37 + 33, 70 + 500]))
    assert (length >= 0).all()
    for d, (a, b) in enumerate([(0, 0), (0, 5), (5, 37), (37, 70), (70, 570)]):
        seen = {i for s, n in zip(start[doc == d], length[doc == d], strict=True) for i in range(s, s + n)}
        assert seen == set(range(a, b))


def _toxic_corpus(n=500):
    rng = random.Random(5)
    data, labels = [], []
    for i in range(n):
        words = corpus.prose(rng, rng.randint(20, 90)).split(" ")
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "moron,", "scum"]))
        data.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return data, labels


def test_toxic_documents_are_found_by_held_out_rows(spark):
    data, labels = _toxic_corpus()
    docs = corpus.frame(spark, [*data, (None, None, None, None, None), (9000, "", "en", "s", 0), (9001, "quiet " * 3000 + "you idiot moron scum", "en", "s", 0)])
    known = spark.createDataFrame([*labels, (None, 1, 1), (77777, 1, None)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, known), keep=["doc_id"]).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(data) + 3 and all(0 <= r.score <= 1 for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.h and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert next(r for r in out if r.doc_id == 9001).predicted == 1
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)


def test_scores_do_not_depend_on_the_rows_beside(spark):
    data, _ = _toxic_corpus(30)
    one = toxicity.Scorer(toxicity.Network.fresh())
    texts = [r[1] for r in data] + [None]
    together = one.score(texts)
    alone = np.array([toxicity.Scorer(toxicity.Network.fresh()).score([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_one_class_of_labels(spark):
    docs = corpus.frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]).collect()
    assert {r.score for r in out} == {0.0}
    assert toxicity.score(corpus.frame(spark, []), 0.5).collect() == []


# 8: near duplicates
def _near_corpus():
    rng = random.Random(8)
    data = [(r[0], r[1]) for r in corpus.rows()]
    for family in range(6):
        base = corpus.prose(rng, 200).split(" ")
        for k in range(5):
            copy = list(base)
            for _ in range(k):
                copy[rng.randint(0, 199)] = f"edit{family}{k}"
            data.append((5000 + family * 10 + k, " ".join(copy)))
    return data


def test_near_duplicates(spark):
    data = _near_corpus()
    got = neardup.classes(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    texts = {}
    for d, t in data:
        texts.setdefault((d, " ".join(brute.words(t))), t)
    node = {(r.d, hashlib.md5(" ".join(brute.words(t)).encode()).digest()): r for r in got for t in [None] if t}
    assert not node
    by_text = {}
    for r in got:
        by_text.setdefault(bytes(r.node), set()).add(bytes(r.label))
    assert all(len(v) == 1 for v in by_text.values())
    label = {k: next(iter(v)) for k, v in by_text.items()}
    classes = brute.similar(data)
    of = [label[hashlib.md5(" ".join(brute.words(t)).encode("utf-8", "surrogatepass")).digest()] for _, t in data]
    pairs = {(classes[i] == classes[j], of[i] == of[j]) for i in range(len(data)) for j in range(i)}
    assert (True, False) not in pairs  # every class of similar texts is found whole
    assert (False, True) not in pairs


def _large_family(n=300, twins=40, seed=9):
    """Variants of one text, unlike one another by about a third, and a twin of some of them."""
    rng = random.Random(seed)
    base = corpus.prose(rng, 220).split(" ")
    texts = []
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(220), rng.randint(2, 9)):
            copy[at] = f"own{k}x{at}"
        texts.append(copy)
    for k in rng.sample(range(n), twins):
        twin = list(texts[k])
        twin[rng.randint(0, 219)] = f"twin{k}"
        texts.append(twin)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [neardup.BLOCK, 64])
def test_large_families_are_settled_whole(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    data = _large_family()
    got = neardup.classes(spark.createDataFrame(data, "doc_id bigint, text string"))
    label = {r.d: bytes(r.label) for r in got.collect()}
    want = brute.similar(data)
    assert len(set(want)) > 20  # a large bucket of many classes
    assert [label[i] == label[j] for i in range(len(data)) for j in range(i)] == [want[i] == want[j] for i in range(len(data)) for j in range(i)]


def test_settled_links_join_what_all_pairs_join():
    data = _large_family(120, 20, 10)
    idf = np.ones(neardup.DF_BUCKETS, np.float32)
    sets = [neardup.weighted(s, idf) for s in neardup.shingles([t for _, t in data])]
    of = list(range(len(data)))
    for i, j, value in neardup.settle(sets, np.arange(len(data)), None, neardup.SIMILARITY):
        assert abs(value - neardup.similarity(sets[i], sets[j])) < 1e-9
        of = [of[i] if x == of[j] else x for x in of]
    want = brute.similar(data)
    assert [a == b for a in of for b in of] == [a == b for a in want for b in want]


def test_samples_agree_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(4)
    keys = np.sort(neardup.mix(np.arange(1, 400, dtype=np.uint64)))
    a = rng.gamma(2, 1, 399).astype(np.float32)
    b = (a * rng.choice([1.0, 0.3], 399)).astype(np.float32)
    want = neardup.similarity((keys, a), (keys, b))
    s = neardup.Sampler(200, 5)
    got = float(np.mean(s.samples(keys, a) == s.samples(keys, b)))
    assert abs(got - want) < 0.06


def test_one_document_of_every_class_stays(spark):
    docs = corpus.clashing(spark)
    every = neardup.near_duplicates(docs)
    kept = neardup.keep_first(docs)
    assert every.count() == docs.count() and kept.columns == docs.columns
    # rows without an id in common count as classes of their own where their texts differ
    labels = neardup.classes(docs).select("label").distinct().count()
    assert kept.count() == labels
    assert neardup.keep_first(corpus.frame(spark, [])).collect() == []


# 10: secrets
def test_base_secrets(spark):
    data = corpus.rows()
    out = secrets.scan(corpus.clashing(spark), keep=["doc_id", "text"]).collect()
    assert len(out) == len(data)
    for r in out:
        a, b, c, spans = brute.base_secrets(r.text)
        assert (r.n_assign, r.n_access, r.n_hex) == (a, b, c)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert {s for s in r.spans.split(",") if s and not s.startswith("random")} == {s for s in spans.split(",") if s}
    assert secrets.scan(corpus.frame(spark, [])).collect() == []


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(11)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    data = [(i, f"see {''.join(rng.choices(chars, k=44))} here") for i in range(20)]
    plain = ["supercalifragilisticexpialidocious", "this-is-a-long-url-path-with-words", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "SOME_LONG_CONSTANT_NAME_IN_CODE", "12345678901234567890123456"]
    data += [(100 + i, f"the {w} here") for i, w in enumerate(plain)]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert sum(out[i].n_random for i in range(20)) >= 19
    assert all(out[100 + i].n_random == 0 for i in range(len(plain)))
    assert next(r.spans for i, r in out.items() if i < 20 and r.n_random) == "random:4:48"


def test_random_tokens_of_every_encoding_are_found(spark):
    rng = random.Random(12)
    data, of = [], {}
    for name, _, alphabet in secrets.ENCODINGS:
        n = 30 if name in ("decimal", "hex") else 40  # shorter than the fixed pattern for hex
        for _ in range(15):
            of[len(data)] = name
            data.append((len(data), f"see {''.join(rng.choices(alphabet.replace('=', ''), k=n))} here, " + corpus.prose(rng, 40)))
    written = ["internationalizationofconfigurations", "environmentvariablesandtheirdefaults", "getAuthenticationTokenFromRequest", "THEQUICKBROWNFOXJUMPSOVERTHELAZYDOG"]
    data += [(5000 + i, f"the {w} here") for i, w in enumerate(written)]
    out = {r.doc_id: r.n_random for r in secrets.scan(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    found = {name: sum(out[i] for i in of if of[i] == name) for name in of.values()}
    assert all(n >= 13 for n in found.values()), found
    assert not any(out[5000 + i] for i in range(len(written)))


def test_battery_against_numpy(spark):
    token = "q8Zt0LmX2vB7nKc5RwYh3PdJs9FgTeUa"
    r = secrets.battery(spark.createDataFrame([(token,)], "token string")).collect()[0]
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    v = np.array([letters.index(c) for c in token], float)
    n, k = len(v), len(letters)
    chi = k / n * sum(token.count(c) ** 2 for c in set(token)) - n
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / np.sqrt(2 / (9 * (k - 1)))
    from math import erfc, sqrt

    assert r.encoding == "alnum" and abs(r.p_uniform - erfc(z / sqrt(2)) / 2) < 1e-6
    c = v - v.mean()
    zs = ((c[:-1] * c[1:]).sum() / (c * c).sum() + 1 / n) * np.sqrt(n)
    assert abs(r.p_serial - erfc(abs(zs) / sqrt(2))) < 1e-6


def test_many_matches_in_one_text(spark):
    n = 100_000
    text = "".join(f"AKIA{i:012d} \U0001f600" for i in range(n))
    rows = spark.createDataFrame([(1, text), (2, "AKIA012345678901"), (3, "")], "doc_id bigint, text string")
    out = {r.doc_id: r for r in secrets.scan(rows).collect()}
    spans = ",".join(f"access:{i * 18}:{i * 18 + 16}" for i in range(n))
    assert out[1].n_access == n and out[1].n_random == 0 and out[1].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert (out[2].n_access, out[2].spans, out[3].spans) == (1, "access:0:16", "")


def test_candidates_that_overlap_no_base_span(spark):
    span = "array<struct<start:int,kind:int,end:int>>"
    rng = random.Random(5)
    rows, want = [], set()
    for rid in range(60):
        pieces = lambda most: [(a, a + rng.randint(1, 9)) for a in rng.sample(range(60), rng.randint(0, most))]
        base, asked = sorted(pieces(5)), pieces(6)
        rows.append((rid, [(a, 0, b) for a, b in base], [(a, b, f"t{a}") for a, b in asked]))
        want |= {(rid, a, b, f"t{a}") for a, b in asked if all(b <= c or d <= a for c, d in base)}
    frame = spark.createDataFrame(rows, f"rid bigint, base {span}, random array<struct<start:int,end:int,found:string>>")
    assert {tuple(r) for r in secrets._free(frame).collect()} == want


def test_false_discovery_control_against_a_plain_version(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        p = 10 ** -rng.choice([0.2, 0.5, 1.4, 2.2, 3.1, 5.6, 9.3])
        rows.append((i, rng.choice([20, 31, 40, 70, 200]), rng.choice([0.5, 0.4, 0.0001]), 0.5, 0.5, p, 0.9))
    tested = spark.createDataFrame(rows, "id bigint, length int, p_uniform double, p_runs double, p_serial double, p_text double, p_fit double")
    want = set()
    for least, above in zip(secrets.STRATA, (*secrets.STRATA[1:], 10**9), strict=True):
        part = [(2 * min(r[5], r[6]) if r[2] >= secrets.ALPHA / 3 else 1.0, r[0]) for r in rows if least <= r[1] < above]
        power = {i: min(max(int(np.floor(-10 * np.log10(p))), 0), 400) for p, i in part}
        # the largest rank whose p-value, rounded up to its bucket, lies under the line
        ranked = sorted(part, key=lambda x: -power[x[1]])
        good = [power[i] for k, (_, i) in enumerate(ranked) if power[i] and len(part) * 10 ** (-power[i] / 10) <= secrets.FDR * sum(power[j] >= power[i] for _, j in ranked)]
        want |= {i for _, i in part if good and power[i] >= min(good)}
    assert want and {r.id for r in secrets.discoveries(tested).collect()} == want


def test_pairs_of_written_characters_come_from_whole_texts(spark):
    late = "x " * 30_000 + "zq zq Zq"
    counts = secrets.written(spark.createDataFrame([(late,), (None,), ("",), ("ab",)], "text string"))
    assert counts[("z", "q")] == 3.0 and counts[("a", "b")] == 1.0
