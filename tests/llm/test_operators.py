"""Each operator against a plain version, on driver tables and on awkward rows."""

import random
import zlib

import pytest
from tokenizers import Tokenizer

from kodagraf.llm import bpe, decontam, jaccard_join, langid, license_scan, line_dedup, quality, sharding, toxicity, url_filter
from tests.llm import brute

LINE = "This line is long enough to count as one"
ODD = {
    1: None,
    2: "",
    3: " \t\n\n ",
    4: LINE,
    5: f"{LINE}\n  {LINE.upper()} \nrest",
    6: f"own\n{LINE}\n{LINE}",
    7: f"{LINE}\n\nÜber Ärger ärger 'quoted' don't 42 x",
    8: "zebra",
    9: "All rights reserved. all Rights-reserved cc by CC  BY general public license",
    10: "word " * 30_000,
    11: "x" * 300_000,
    12: "naïve café ΣΊΣΥΦΟΣ ﬁ İstanbul e\u0301 \u00a0 tab\there \u2003 emoji 😀😀 日本語 ½ ²",
}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def with_extras(df):
    from pyspark.sql import functions as F

    names = "h1 key row pos n_words spans items score _c0 band block gaps content".split()
    return df.withColumns({n: F.lit(1) for n in names})


def cases(request, make_docs, small):
    return {"odd": make_docs(ODD), "tables": small}[request]


@pytest.fixture(params=["odd", "tables"])
def docs(request, make_docs, small):
    return cases(request.param, make_docs, small)


def test_line_dedup(docs):
    want = brute.line_dedup(pairs(docs))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.report(with_extras(docs)).collect()}
    assert got == {i: (n, d, brute.sha(t)) for i, (n, d, t) in want.items()}
    kept = line_dedup.deduplicated(with_extras(docs))
    assert {r["doc_id"]: r["text"] or "" for r in kept.collect()} == {i: t for i, (_, _, t) in want.items()}
    assert kept.columns == with_extras(docs).columns


def test_line_dedup_hot(spark, make_docs, monkeypatch):
    from kodagraf.llm import skew

    monkeypatch.setattr(skew, "LEAST", 3)
    texts = {i: f"{LINE}\nline of document number {i % 7} and no other\nshort" for i in range(60)}
    docs = make_docs(texts)
    want = brute.line_dedup(pairs(docs))
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.report(docs).collect()}
    assert got == {i: (n, d, brute.sha(t)) for i, (n, d, t) in want.items()}


def test_line_dedup_of_a_long_text_and_of_nothing(make_docs):
    lines = [f"this is line number {i} of a long text that has very many of them" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[7::1000])), (3, lines[7])]
    plan = line_dedup.occurrences(make_docs(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64(text")  # below the explode: once a document
    want = brute.line_dedup(rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.report(make_docs(rows)).collect()}
    assert got == {i: (n, d, brute.sha(t)) for i, (n, d, t) in want.items()}
    assert line_dedup.report(make_docs(rows).limit(0)).count() == 0


def test_line_dedup_repeated_ids(make_docs):
    docs = make_docs([(1, LINE), (1, f"{LINE}\nb"), (None, LINE), (2, LINE), (2, LINE)])
    rows = sorted((r["doc_id"] or 0, r["n_dropped"]) for r in line_dedup.report(docs).collect())
    assert rows == [(0, 1), (1, 1), (1, 1), (2, 0), (2, 0)]


@pytest.mark.parametrize("shard", [decontam.SHARD, 2_000])
def test_decontamination(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD", shard)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, "all rights reserved"), (901, "word " * 20), (902, None), (903, " "), (904, "All Rights RESERVED"), (None, "zebra")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(k, t) for k, t in items if k is not None]
    want = brute.contamination(pairs(docs), known)
    found = decontam.report(with_extras(docs), bench).collect()
    by_id = {r[0]: tuple(r) for r in found}
    for w in want:
        if w[0] == 8 and w[1] == 1:  # marked by the item without id
            assert by_id[8][2] == 1 and by_id[8][3] == 0
        else:
            assert by_id[w[0]] == w
    assert decontam.clean(with_extras(docs), bench).columns == with_extras(docs).columns


def test_decontamination_of_a_long_text(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    words = [f"w{rng.randrange(30)}" for _ in range(3_000)]
    items = [(str(i), " ".join(words[i * 7 : i * 7 + 13])) for i in range(100)] + [("x", "w1 w2"), ("y", "w3")]
    windows = decontam.Windows(items, 13)
    column = pa.array([" ".join(words)])
    whole = [x.to_pylist() for x in decontam._shard(windows, column)]
    monkeypatch.setattr(decontam, "INDEX_WORDS", 40)
    assert [x.to_pylist() for x in decontam._shard(windows, column)] == whole
    monkeypatch.setattr(decontam.t, "PIECE", 100)
    assert [x.to_pylist() for x in decontam._shard(windows, column)] == whole
    want = brute.contamination([(1, " ".join(words))], items)[0]
    assert (whole[0][0], sum(s["end"] - s["start"] for s in whole[1][0]), len(whole[2][0])) == want[1:4]


def test_decontamination_in_blocks(spark, small, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, decontam.report(small, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 2_000)
    assert sorted(map(tuple, decontam.report(small, bench).collect())) == whole
    assert sum(r[2] for r in whole) > 0
    empty = bench.limit(0)
    assert {r["n_hit"] for r in decontam.report(small, empty).collect()} == {0}


def test_suffix_array():
    import numpy as np

    rng = random.Random(3)
    for alphabet in (1, 2, 5):
        seq = [rng.randint(1, alphabet) for _ in range(300)] + [0]
        order = decontam.suffix_array(np.array(seq))
        assert order.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def family(seed, base_size, copies, most):
    """Near copies of one text, some at either side of the bound."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(base_size)]
    return [changed(rng, base, rng.randint(0, most)) for _ in range(copies)]


@pytest.mark.parametrize("k,part", [(3, 90), (5, 80)])
def test_jaccard_join(make_docs, monkeypatch, k, part):
    texts = [*family(1, 200, 40, 12), *family(2, 60, 30, 4), *family(3, 25, 30, 2), *family(4, 12, 20, 1), *family(5, 900, 12, 60)]
    texts += ["a b", "a b", "a  B", "", None, "c", " ", *ODD.values()]
    rows = list(enumerate(texts))
    docs = make_docs(rows)
    want = sorted(brute.near(rows, k, part, 100))
    rule = jaccard_join.Rule(k, part, 100)
    get = lambda: sorted(map(tuple, jaccard_join.report(docs, rule).collect()))
    assert get() == want
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)  # large groups are cut
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    assert get() == want
    monkeypatch.setattr(jaccard_join, "CLUSTER", 20)  # large clusters go by keys
    assert get() == want


def test_jaccard_tables(small):
    rows = sorted(pairs(small))
    got = sorted(tuple(r) for r in jaccard_join.report(small).collect())
    assert got == sorted(brute.near(rows, 3, 90, 100))
    kept = jaccard_join.one_of_each(with_extras(small))
    assert kept.columns == with_extras(small).columns
    want = brute.near(rows, 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in want})


def test_jaccard_repeated_and_missing_ids(make_docs):
    docs = make_docs([(1, "a b c d"), (1, "x y z"), (None, "a b c d"), (2, "a b c d"), (3, "x y z"), (3, None), (None, None)])
    got = sorted((r[0] or 0, r[1], r[2] or 0) for r in jaccard_join.report(docs).collect())
    assert got == [(0, 0, 0), (0, 2, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 1, 1)]
    assert len(jaccard_join.one_of_each(docs).collect()) == 4


def test_sketch_bounds_difference():
    import numpy as np

    rng = np.random.default_rng(5)
    rule = jaccard_join.Rule(3, 90, 100)
    for n in (12, 60, 500):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[2:], rng.integers(0, 1 << 63, 1).astype(np.uint64)]))
        x, y = (jaccard_join.sketch(s, 9) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= 3
    low, segments = jaccard_join.bands(rule)
    for size in range(1, 3000):
        band = np.searchsorted(low, size, "right") - 1
        most = size * 100 // 90
        assert np.searchsorted(low, most, "right") - 1 <= band + 1
        assert segments[band] == 0 or 190 * (jaccard_join.differences(rule, band) + 1) > 10 * (size + most)


@pytest.mark.parametrize("words,part", [(3, 90), (5, 80)])
def test_linked_sets_share_a_key(words, part):
    import numpy as np

    rng = np.random.default_rng(7)
    rule = jaccard_join.Rule(words, part, 100)
    low, _ = jaccard_join.bands(rule)
    new = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    tried = 0
    for _ in range(2000):
        a = np.unique(new(int(rng.integers(1, 400))))
        less, more = rng.integers(0, len(a) // 5 + 1), rng.integers(0, len(a) // 4 + 1)
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[less:]], new(int(more))]))
        both = len(np.intersect1d(a, b))
        if 100 * both < part * (len(a) + len(b) - both) or both == len(a) == len(b):
            continue
        tried += 1
        bands = [int(np.searchsorted(low, len(x), "right")) - 1 for x in (a, b)]
        assert np.intersect1d(*(jaccard_join.keys(x, rule, band) for x, band in zip((a, b), bands))).size
        short = min(jaccard_join.width(rule, band) for band in bands)
        x, y = (jaccard_join.fold(jaccard_join.sketch(s, jaccard_join.width(rule, k)), short) for s, k in zip((a, b), bands))
        assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both
    assert tried > 200


def test_licenses(docs):
    want = brute.licenses(pairs(docs))
    for r in license_scan.report(with_extras(docs)).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"])


def test_license_edits():
    scanner = license_scan.Scanner(license_scan.NOTICES)
    find = lambda x: [(license_scan.NOTICES[k].label, a, b, e) for k, a, b, e in scanner.scan(x.split())]
    assert find("some all rigths reserved text") == [("reserved", 1, 4, 2)]
    assert find("the generl public licence here") == [("gpl", 1, 4, 2)]
    assert find("released in to the public domain") == [("public-domain", 0, 6, 1)]
    assert find("call light reserves") == []
    assert find("all the rest") == []


def test_license_repeated_near_places():
    scanner = license_scan.Scanner(license_scan.NOTICES)
    find = lambda x: [(license_scan.NOTICES[k].label, a, b, e) for k, a, b, e in scanner.scan(x.split())]
    swapped = [("reserved", 4 * i, 4 * i + 3, 2) for i in range(200)]
    assert find("all rigths reserved x " * 200 + "all rights reserved") == [*swapped, ("reserved", 800, 803, 0)]
    assert find("all rights reserved " + "all right reserved " * 200) == [
        ("reserved", 3 * i, 3 * i + 3, int(i > 0)) for i in range(201)
    ]
    assert len(find("all rigths reserved all rights reserved " * 3_000)) == 6_000
    assert find("all rights reservedfoo bar") == [("reserved", 0, 3, 1)]


def test_sharding(spark, docs):
    rows = {r["doc_id"]: r for r in sharding.report(with_extras(docs)).collect()}
    texts = dict(pairs(docs))
    slots = {}
    for i, r in rows.items():
        raw = (texts[i] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 50)
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    layout = sharding.tree(40)
    heavier = sharding.tree(40)
    heavier["region1"]["region1/rack2"][33] = 3.0
    got = sharding.assign(rows, layout, heavier).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(40)]
    assert min(counts) > 350 and max(counts) < 650
    for r in got:  # only subtrees that gained take rows; inside unchanged ones nothing moves
        if r["shard"] != r["grown_shard"]:
            same_region = r["shard"] // 20 == r["grown_shard"] // 20
            assert r["grown_shard"] // 20 == 1
            assert not same_region or 30 <= r["grown_shard"] < 35
    assert sorted(r["slot"] for r in got if r["shard"] == 0) == list(range(counts[0]))
    assert sharding.report(rows.limit(0)).count() == 0


def test_bpe(docs):
    tok = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: r for r in bpe.report(with_extras(docs)).collect()}
    for i, text in pairs(docs):
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want = tok.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids), i
        assert got[i]["ids_sha256"] == brute.sha(" ".join(map(str, ids))), i
        assert got[i]["decoded_sha256"] == brute.sha(want), i


def test_bpe_strings():
    tok = Tokenizer.from_file(bpe.default_path())
    encoder = bpe.Encoder(bpe.Bpe(bpe.default_path()))
    rng = random.Random(7)
    alphabet = "aAbeéÉßſΣσςİıñ'sdtrvml0１²½ \t\n\x1c\x85\u2028\u200b_-.,!<|>😀日е\u0301"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|startoftext|>", "a<|endoftext|>b <|endoftext|", "aaaaaaa", "\x00<|endoftext|>", "I'll we've x'S", "<|STARTOFTEXT|>"]
    for text, (ids, decoded, n) in zip(texts, encoder.encode(texts)):
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), repr(text)
        assert decoded == tok.decode(want, skip_special_tokens=False) and n == len(want)


def test_bpe_long_words():
    tok = Tokenizer.from_file(bpe.default_path())
    vocabulary = bpe.Bpe(bpe.default_path())
    assert vocabulary.reach
    rng = random.Random(11)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    words = [draw("abcdefghijklmnopqrstuvwxyz", 60_000), draw("acgt", 30_000), draw("ae", 20_000), draw("aaaab", 5_000), "x" * 10_001]
    words += ["".join(rng.choice(["the", "tion", "ing", "a", "aa", "pre"]) for _ in range(9_000)), draw("éßa日", 8_000), "short", "no"]
    words += [draw("abst", rng.randrange(bpe.LONG - 2, bpe.LONG + 3)) for _ in range(6)]
    for word, ids in zip(words, vocabulary.merge(words)):
        assert ids == tok.encode(word, add_special_tokens=False).ids, word[:40]


def test_quality(docs):
    texts = dict(pairs(docs))
    for r in quality.report(with_extras(docs)).collect():
        assert tuple(r)[1:7] == brute.quality(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_quality_fences(spark, make_docs):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60))
    texts = [(i, prose()) for i in range(80)] + [(100, " ".join(f"{w}|#|" for w in prose().split())), (101, " ".join(w * 5 for w in prose().split()))]
    got = {r["doc_id"]: r["kept"] for r in quality.report(make_docs(texts)).collect()}
    assert [i for i, kept in got.items() if not kept] in ([100, 101], [101, 100])
    docs = make_docs(texts)
    kept = quality.clean(with_extras(docs))
    assert kept.count() == 80 and kept.columns == with_extras(docs).columns
    mixed = docs.unionByName(make_docs([(200, None), (201, prose())], lang=None, source=None))
    rows = {r["doc_id"]: r["kept"] for r in quality.report(mixed).collect()}
    assert rows[201] and not rows[200] and len(rows) == 84


def test_urls(spark):
    from pyspark.sql import functions as F

    urls = [
        None, "", "no scheme.org/", "http://", "http://a.ORG", "http://a.ORG/", "https://x.example.org/es/1?u#f", "https://example.org/en/123",
        "https://notexample.org/en/1", "http://b.com/fr/", "http://b.com/de/x", "http://b.com/en/", "x://h.com?/fr/", "http://com/fr/#/de/",
        "http://a.b.c.d.e.org//", "http://example.org/en/12://y", "http://h.com/\nfr", "HTTP://a..org/x", "ftp://.com/de/",
    ]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, "http://"), (5, "http://a.ORG/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("x"), "digest": F.lit(1)})

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, slash, path = rest.partition("/")
        host, path = host.translate(brute.LOWER), slash + path
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    want = sorted(((i, *plain(u)) for i, u in rows), key=repr)
    assert sorted(map(tuple, url_filter.report(pages).collect()), key=repr) == want


def test_urls_many_rules(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted(map(tuple, url_filter.report(pages).collect()), key=repr)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, url_filter.report(pages).collect()), key=repr) == want


def test_language_id(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text IS NOT NULL")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in langid.report(docs).collect()]
    assert len(rows) == len(lang) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    model = langid.fit(docs.select("lang", "text"))
    odd = {r["doc_id"]: r for r in langid.predict(with_extras(make_docs({1: None, 2: "", 3: "123 !!", 4: "xqz", 5: "the " * 200_000})), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and odd[4]["lang_pred"] != "und" and odd[5]["lang_pred"] == "en"
    assert odd[4]["rejected"]
    nothing = langid.report(docs.limit(0))
    assert nothing.count() == 0
    untaught = langid.report(make_docs({1: "abc", 2: None}, lang=None)).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}


def by_hash(spark, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in texts], "text string").orderBy(F.xxhash64("text"))
    return [r["text"] for r in rows.collect()]


def test_sample_counts_copies_once(spark):
    texts = by_hash(spark, [f"text {i}" for i in range(20)])
    copied = [("a", x) for x in texts[:1] * 30 + texts[1:]] + [("b", x) for x in texts[:3] * 5]
    labelled = spark.createDataFrame(copied, "lang string, text string").repartition(3)
    for size in (8, 25):
        got = sorted((r["lang"], r["text"]) for r in langid.sample(labelled, size).collect())
        assert got == sorted([("a", x) for x in texts[:size]] + [("b", x) for x in texts[:3]])


def test_ngram_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["Élan vital, über alles", None, "", "a", "abc def" * 50])
    whole = langid.counts(texts)
    assert whole[0].sum() > 0 and whole[1].sum() == 0 and whole[2].sum() == 0 and whole[3].sum() == 1
    same = langid.counts(pa.array(["élan VITAL, Über alles"]))
    assert np.array_equal(whole[0], same[0])


def test_toxicity(spark, make_docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in toxicity.report(with_extras(docs), labels).collect()}
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    known = [(r["toxic"], rows[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in rows]
    held = [(t, r) for t, r in known if r["held_out"]]
    right = sum(t == r["predicted"] for t, r in held)
    assert right >= 0.9 * len(held)
    nothing = toxicity.report(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in nothing} == {0}


def test_toxicity_with_many_copies(spark, make_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    texts = by_hash(spark, [f"you bloody grobnik number {w}" for w in "abcdefghijklmnopqrstuvwxyz"])
    toxic = [(i, x) for i, x in enumerate(texts[:1] * 60 + texts[1:])]
    clean = [(1_000 + i, f"a calm day by the sea {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]}") for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean], "doc_id long, toxic int")
    rows = toxicity.report(make_docs(toxic + clean), labels).collect()
    assert {r["n_matches"] > 0 for r in rows if r["doc_id"] < 1_000} == {True}
    assert min(r["score"] for r in rows if r["doc_id"] < 1_000) > max(r["score"] for r in rows if r["doc_id"] >= 1_000)


def test_toxicity_folding():
    assert toxicity.folded("ІDІОТ 1d1ot м0r0n $cum ｓtupid st\u200bupid 1984 a$$") == ["idiot", "idiot", "moron", "scum", "stupid", "stupid", "a"]
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " scu": 2.0}, ["village idiot"])
    automaton = lexicon.automaton()
    total = lambda x: sum(toxicity.matched(automaton, toxicity.folded(x)).values())
    assert total("you idiot, scumbag") == 5.0 and total("the village idiot") == 0 and total("idiotic") == 0 and total(None) == 0
    model = toxicity.Model(lexicon, toxicity.fit_curve(toxicity.np.array([[5, 10], [0, 10]] * 20, float), toxicity.np.array([1, 0] * 20)))
    assert model.score(toxicity.np.array([[5.0, 10], [0, 0]])).round().tolist() == [1, 0]
