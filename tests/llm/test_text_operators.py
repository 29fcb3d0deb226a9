"""URL filter, language ID, quality score, decontamination and sentence spans against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deflow.llm import decontam, langid, quality, queries, spans, urls, words
from deflow.llm.zdict import Sizer
from tests.llm.conftest import DOCS, ROWS, prose


# ---- words

def test_words_against_split():
    texts = [(r[1] or "").encode() for r in ROWS] + [b"", b" \x0b\x0c a\xc2\xa0b ", "É é".encode()]
    w = words.split(texts)
    plain = [t.split() for t in texts]
    assert np.diff(w.first).tolist() == [len(p) for p in plain]
    names = {}
    for a, b, h, p in zip(w.starts.tolist(), w.ends.tolist(), w.hashes.tolist(), [x for p in plain for x in p]):
        assert bytes(w.data[a:b]) == p
        assert names.setdefault(p.lower(), h) == h
    assert len(set(names.values())) == len(names)
    assert [y for x in words.portions(texts, 1000) for y in x] == sorted(y for x in words.portions(texts, 1000) for y in x)


# ---- URLs

URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://A.Example.ORG/es/1", "https://example.org/en/12#top", "https://badexample.org/es/",
        "http://x.com/fr/1?cheap", "http://cheap-pills.com/en/", "http://cheapest-pills.com/en/", "http://cheap.net/pills/free", "http://my-casino.net",
        "http://casinos.net/", "ftp://u@h.net:80/XXX\n/a", "http://m.net/WIN/win", "a://b://c/xxx", "http://com/de/", "http://Ünï.com/de/porn", "http://x.org?porn"]


def plain_judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls._UPPER, urls._LOWER)), m[2]) if m else ("", "")
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), not r.allow), default=None)
    text = host + path.translate(str.maketrans(urls._UPPER, urls._LOWER))
    has = lambda t: re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text)
    soft = [t for t in urls.SOFT if has(t)]
    bad = any(map(has, urls.STRICT)) or (len(soft) >= 2 and sum(urls.SOFT[t] for t in soft) >= 2)
    return host, path, best.text if best else None, ("allow" if best.allow else "block") if best else ("block" if bad else "allow")


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "own", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, Rule int")
    out = urls.judge(df)
    assert out.columns == ["page_id", "url", "host", "Rule", "host_", "path", "rule_", "verdict", "strict_terms", "soft_terms", "weight"]
    for r in out.collect():
        assert (r["host_"], r["path"], r["rule_"], r["verdict"]) == plain_judge(r["url"]), r
        assert r["host"] == "own"
    assert urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(df, rules=(), strict=(), soft={}).collect()} == {"allow"}


# ---- language and quality

def test_language_held_out(spark, docs):
    out = langid.identify(docs.withColumn("score", F.lit(1)))
    assert out.columns[-3:] == ["lang_pred", "score_", "lang_ok"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters) and (letters or not r["lang_ok"])
        assert 0 <= r["score_"] <= 1
    clear = [r for r in rows if r["text"] and len(r["text"]) > 100 and r["lang"]]
    assert all(r["lang_pred"] == r["lang"] for r in clear)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.where("length(text) > 100").count() == docs.where("length(text) > 100").count()


def test_language_uses_training_rows_only(spark, docs):
    rows = {(r["doc_id"], r["h"]) for r in docs.select("doc_id", langid.held_out("doc_id", 5, 0).alias("h")).collect()}
    assert rows == {(k, zlib.crc32(str("" if k is None else k).encode()) % 5 == 0) for k in {r[0] for r in ROWS}}


def test_language_without_labels(spark, docs):
    out = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in out.collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0
    one = langid.predict(docs, langid.fit(docs.where("lang = 'xx'")))
    assert {r["lang_pred"] for r in one.collect()} == {"xx", "und"}


def plain_languages(rows, models):
    """Each text's language, score and acceptance, with one compressor call per piece and no blocks."""
    import zstandard

    known = [(n, c, d) for m in models for n, c, d in zip(m.languages, m.counts, m.dictionaries)]
    params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    tools = []
    for n, c, d in known:
        d = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(langid.LEVEL)
        tools.append((n, c, zstandard.ZstdCompressor(compression_params=params, dict_data=d)))
    out = []
    for t in rows:
        if t is None or not known or not any(c.isalpha() for c in t):
            out.append(("und", 0.0, False))
            continue
        data = langid.normal(t)
        order = sorted((sum(len(z.compress(data[i:i + 1024])) for i in range(0, len(data), 1024)), -c, n) for n, c, z in tools)
        score = 1.0 if len(order) == 1 else (order[1][0] - order[0][0]) / order[1][0]
        out.append((order[0][2], score, score >= langid.MARGIN))
    return out


def test_language_against_plain(spark, docs, monkeypatch):
    """Scores recomputed from the dictionaries; with blocks of any size, languages and results are the same."""
    train = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 4).cast("string")))
    whole = list(langid.fit(train))
    assert [len(m.languages) for m in whole] == [7]
    want = sorted(plain_languages([r[1] for r in ROWS], whole))
    got = lambda models: sorted((r["lang_pred"], r["score"], r["lang_ok"]) for r in langid.predict(docs, models).collect())
    assert got(whole) == want
    monkeypatch.setattr(langid, "BLOCK", 1)
    parts = list(langid.fit(train))
    assert 1 < len(parts) <= 7 and {n for m in parts for n in m.languages} == set(whole[0].languages)
    assert got(parts) == want


def test_more_languages_than_a_block(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}qx " * 20, f"l{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    models = list(langid.fit(df, key=F.col("doc_id")))
    assert len(models) == 2 and len(set(models[0].languages) & set(models[1].languages)) == 0 and sum(len(m.languages) for m in models) == 300
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict(df, models).collect())


def test_sizes_cover_the_whole_text():
    z = Sizer([b"abc def " * 50, b"xyz uvw " * 50], 3, 64)
    a, b = z.sizes(b"abc def " * 1000), z.sizes(b"abc def " * 2000)
    assert a[0] < a[1] and abs(b[0] / a[0] - 2) < 0.1 and z.sizes(b"").tolist() == [0, 0]


def test_quality(spark, docs, tiny):
    rows = queries.op3_quality(spark, tiny).collect()
    assert len(rows) == spark.read.parquet(f"{tiny}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 60]
    assert np.mean([r["predicted"] == (r["doc_id"] % 2 == 0) for r in held]) >= 0.9
    assert quality.fit(docs, docs.select("doc_id", F.lit(1).alias("quality"))) is None
    assert {r["score_"] for r in quality.score(docs.withColumn("score", F.lit(2)), None).collect()} == {0.5}


def test_curve():
    x = np.concatenate([np.random.default_rng(1).normal(m, 1, 300) for m in (-1, 1)])
    slope, offset = quality.logistic_fit(x, np.repeat([0.0, 1.0], 300))
    assert slope > 1 and abs(offset) < 0.3


# ---- decontamination

def plain_tiles(item, doc, least):
    """Greedy tiling by trying every pair of places again and again."""
    used_i, used_d, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return sorted(out)
        out.append(best)
        used_i |= set(range(best[0], best[0] + best[2]))
        used_d |= set(range(best[1], best[1] + best[2]))


def test_tiles_against_plain():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.choice("abc") for _ in range(rng.randint(3, 14))]
        doc = [rng.choice("abc") for _ in range(rng.randint(3, 20))]
        w = words.split([" ".join(doc).encode()], True)
        block = decontam.Block.of([(7, " ".join(item).encode())], 3)
        tiles = plain_tiles(item, doc, 3)
        got = decontam.contained(w, block, 1e-9)[0]
        assert sum(t[2] for t in tiles) == sum(t[2] for g in got for t in g[2])
        assert not got or got[0][2] == tiles


def test_decontamination(spark, tiny, monkeypatch):
    rng = random.Random(9)
    item = prose(rng, 40).split()
    half = " ".join(item[20:]) + " zz " + " ".join(item[:20])
    rows = [(1, prose(rng, 50) + " " + half), (2, prose(rng, 60)), (3, " ".join(item[:15])), (4, None), (5, ""), (6, " ".join(item).upper()), (6, "!! ".join(item)), (None, half), (8, "q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (11, None), (12, " "), (13, "Q R")], "item_id long, text string")
    for limit in (1_000_000, 10):   # one block, and a block per item
        monkeypatch.setattr(decontam, "BLOCK_WORDS", limit)
        monkeypatch.setattr(decontam.blocks, "__defaults__", (limit,))
        hit = sorted(((r["doc_id"], r["item_id"]) for r in decontam.hits(docs, bench).collect()), key=repr)
        assert hit == sorted([(1, 10), (1, 10), (6, 10), (6, 10), (6, 10), (6, 10), (None, 10), (None, 10), (8, 13)], key=repr)
        assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontam.hits(docs, bench.limit(0)).count() == 0 and decontam.clean(docs.limit(0), bench).columns == docs.columns
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_decontamination(spark, tiny).collect()}
    assert (2, 0) in got and all(i == 0 for _, i in got)


# ---- sentence spans

def plain_sentences(text):
    out = []
    for line in (text or "").encode().split(b"\n"):
        piece = []
        for w in line.split():
            piece.append(w.lower())
            if len(piece) == spans.PIECE or w[-1:] in (b".", b"!", b"?", b"|"):
                out.append(piece)
                piece = []
        if piece:
            out.append(piece)
    return out


def plain_removals(rows):
    seen, out = {}, {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        s = plain_sentences(text)
        for i in range(len(s)):
            ends = [j for j in range(i + min(spans.SPAN, len(s)), len(s) + 1) if sum(map(len, s[i:j])) >= spans.LEAST]
            run = tuple(w for p in s[i:ends[0]] for w in p) if ends else None
            if run and seen.setdefault(run, (key, i)) != (key, i):
                out.setdefault(key, set()).update(range(i, ends[0]))
    return out


def test_spans(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: set(r["sentences"]) for r in queries.op10_sentence_spans(spark, tiny).collect()}
    assert got == plain_removals(rows)
    assert set(range(91, 110)) <= set(got) and 90 not in got


def test_span_rewrite(spark, docs):
    wide = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("_drop", F.lit("x")).withColumn("k", F.lit(1))
    out = spans.dedup(wide)
    assert out.columns == wide.columns
    lost = plain_removals([(r["doc_id"], r["text"]) for r in wide.collect()])
    before = {r["doc_id"]: r["text"] for r in wide.collect()}
    for r in out.collect():
        kept = [w for i, s in enumerate(plain_sentences(before[r["doc_id"]])) if i not in lost.get(r["doc_id"], ()) for w in s]
        assert (r["text"] or "").encode().lower().split() == kept
        assert r["doc_id"] in lost or r["text"] == before[r["doc_id"]]


def test_passages_at_any_word(spark):
    """Every repeated run of 50 words (or characters, without blanks) costs its later documents words of it, and no others."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    rows, shared = [], {}
    for g in range(60):     # one endless sentence each, a passage at random offsets in two hosts
        passage = [word() for _ in range(50)]
        for k in (2 * g, 2 * g + 1):
            rows.append((k, " ".join([word() for _ in range(rng.randint(0, 40))] + passage + [word() for _ in range(rng.randint(0, 40))])))
        shared[2 * g + 1] = set(passage)
    for g in range(60, 80):
        passage = han(50)
        for k in (2 * g, 2 * g + 1):
            rows.append((k, han(rng.randint(0, 40)) + passage + han(rng.randint(0, 40))))
        shared[2 * g + 1] = set(passage)
    prose_ = lambda n: [word() + "." * (rng.random() < 0.06) for _ in range(n)]
    for g in range(80, 140):    # sentences of all lengths
        passage = prose_(50)
        for k in (2 * g, 2 * g + 1):
            rows.append((k, " ".join(prose_(rng.randint(0, 40)) + passage + prose_(rng.randint(0, 40)))))
        shared[2 * g + 1] = set(passage)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    units = lambda k, t: list(t) if 120 <= k < 160 else t.split()
    for r in spans.dedup(df).collect():
        before, after = units(r["doc_id"], dict(rows)[r["doc_id"]]), units(r["doc_id"], r["text"])
        gone = set(before) - set(after)
        assert gone <= shared.get(r["doc_id"], set())
        assert len(gone) >= (16 if r["doc_id"] < 160 else 1) if r["doc_id"] in shared else not gone


def test_characters_as_words():
    got = words.split(["ab \u4e2d\u6587x\u3042 \u0e01 \U00020000z \ud55c\uae00".encode(), None, "\u4e2d".encode()], characters=True)
    assert [bytes(got.data[a:b]).decode() for a, b in zip(got.starts.tolist(), got.ends.tolist())] == [
        "ab", "\u4e2d", "\u6587", "x", "\u3042", "\u0e01", "\U00020000", "z", "\ud55c\uae00", "\u4e2d"]
    assert got.first.tolist() == [0, 9, 9, 10]


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None)], [(1, ""), (2, " ")], [(1, "a b. c d."), (2, "a b. c d.")]])
def test_spans_small(spark, rows):
    assert spans.removals(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_rows_that_repeat(spark):
    text = prose(random.Random(4), 60)
    df = spark.createDataFrame([(5, text), (5, text), (4, text), (None, text)], DOCS.split(", lang")[0])
    got = {r["doc_id"]: r["firsts"] for r in spans.removals(df).collect()}
    assert set(got) == {4, 5}
