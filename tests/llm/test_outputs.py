"""Mixing, token files, chat formatting, fingerprints and the pipeline against plain versions."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from deflow.llm import chat, common, decontam, fingerprints, langid, mixing, queries, setjoin, spans, tokenfile, tokens
from tests.llm.conftest import DOCS, ROWS, prose
from tests.llm.test_setjoin import plain

PATH = queries.TOKENIZER


# ---- mixing

def test_targets():
    for sizes, weights in (([10, 10, 10], [5, 2, 1]), ([100, 1, 0, 7], [5, 2, 1, 5]), ([], []), ([0, 0], [1, 1]), ([3], [1])):
        t = mixing.targets(sizes, weights)
        assert all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes)) and abs(sum(t) - 1.5 * sum(sizes)) < 1e-6
        free = [x / w for x, w, s in zip(t, weights, sizes) if s and x < 2 * s - 1e-9]
        assert not free or max(free) - min(free) < 1e-6
        assert not free or all(2 * s / w <= free[0] + 1e-6 for x, w, s in zip(t, weights, sizes) if x >= 2 * s - 1e-9)


def test_tree_deals_exact_counts():
    tree = mixing.SplittingTree((1000, 37, 0, 512), 7, 3)
    source = np.repeat(np.arange(4), tree.counts)
    draw = np.concatenate([np.arange(c) for c in tree.counts])
    shard = tree.shard_of(source, draw, {})
    again = np.concatenate([tree.shard_of(source[i::5], draw[i::5], {}) for i in range(5)])
    assert np.array_equal(again, np.concatenate([shard[i::5] for i in range(5)]))
    assert set(np.bincount(shard, minlength=7)) <= {1549 // 7, 1549 // 7 + 1}
    for s in range(4):
        assert np.all(np.diff(shard[source == s]) >= 0)     # disjoint ranges of a source's sequence
    share = np.bincount(shard[source == 0], minlength=7)
    assert share.min() > 0.5 * share.max()


def test_gap():
    rng = np.random.default_rng(4)
    for _ in range(100):
        sizes = rng.integers(0, 50, 30)
        gap = float(rng.uniform(0, sizes.sum()))
        marks = rng.permutation(30) - 15
        mark, fills = mixing.close_gap(marks, sizes, gap)
        taken = [(mark is not None and m <= mark) or m in fills for m in marks.tolist()]
        assert len(set(fills)) == len(fills) and not any(mark is not None and f <= mark for f in fills)
        assert abs(sizes[taken].sum() - gap) <= 25  # half a document at most


def test_mix(spark, docs):
    wide = docs.withColumn("Target", F.lit("own")).withColumn("_size", F.lit(1))
    out = mixing.mix(wide, shards=5)
    assert out.columns == [*wide.columns, "size", "source_size", "target_", "taken", "draws", "shards", "ranks"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    sizes = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    goal = dict(zip(names, mixing.targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for n in names:
        own = [r for r in rows if r["source"] == n]
        assert all(r["source_size"] == sizes[n] and abs(r["target_"] - goal[n]) < 1e-6 and r["taken"] == r["size"] * len(r["draws"]) <= 2 * r["size"] for r in own)
        base = int(goal[n] // sizes[n]) if sizes[n] else 0
        left = min((r["size"] for r in own if r["size"] and len(r["draws"]) == base), default=0)     # whole documents only
        assert abs(sum(r["taken"] for r in own) - goal[n]) <= max(left / 2, 1)
    again = mixing.mix(wide.repartition(2), shards=5).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    made = mixing.assemble(out, docs.columns)
    assert made.columns == docs.columns and made.count() == sum(len(r["draws"]) for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


# ---- tokens

def test_encoder_is_the_tokenizer():
    enc, rng = tokens.WordEncoder(PATH), random.Random(3)
    parts = [" ", "\n", "a", "Bé", ".", ",", "!", "1", "_", "'s", "word", "\t", " .", "%%", "\x00", "<|endoftext|>", "日本", "\r\n", "²", "½", "́", " ", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [r[1] or "" for r in ROWS]
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files(spark, docs, tmp_path):
    folder = str(tmp_path / "out")
    manifest = tokenfile.write(docs.withColumn("ids", F.lit(1)), folder, PATH, 2).collect()
    tok = Tokenizer.from_file(PATH)
    want = sorted(([(r[0], np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in ROWS]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted((r for r in tokenfile.read(spark, folder).collect()), key=lambda r: r["start"])
    assert [r["key"] for r in got] == [k for k, _ in want]
    assert sorted(bytes(r["ids"]) for r in got) == sorted(b for _, b in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    assert sum(m["documents"] for m in manifest) == len(ROWS) and sum(m["tokens"] for m in manifest) == at
    f = tokenfile.FileReader(f"{folder}/{manifest[0]['file']}", folder)     # one document alone
    assert f.document(0).astype("<u4").tobytes() == bytes(got[0]["ids"])
    with open(f"{folder}/{[x for x in os.listdir(folder) if x.endswith('.zdict')][0]}", "ab") as z:
        z.write(b"x")
    with pytest.raises(ValueError):
        tokenfile.FileReader(f"{folder}/{manifest[0]['file']}", folder)


def test_token_query(spark, tiny, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect())
    tok, at, want = Tokenizer.from_file(PATH), 0, []
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op4_token_files(spark, tiny).collect())) == want
    assert tokenfile.encode_documents(docs.limit(0), PATH).count() == 0


# ---- chat

CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok\\"), (1, 2, "assistant", None), (2, None, "a ### b", "####</turn>\\\\"), (2, 0, None, ""),
         (None, 1, "assistant", "null id é 日本"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (3, 0, "user", "<|endoftext|>" * 3), (4, 0, "assistant", "long " * 20000)]


def test_chat(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("own"))
    got = {r["conv_id"]: r for r in chat.summaries(chat.format_turns(turns, PATH), PATH).collect()}
    assert set(got) == {c[0] for c in CHATS}
    for c, r in got.items():
        own = sorted((x for x in CHATS if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        learned = "".join(x[3] or "" for x in own if x[2] == "assistant")
        text = "".join(chat.TURN + chat.escape(x[2] or "") + chat.BODY + chat.escape(x[3] or "") + chat.END for x in own)
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == len(text)
        parsed = re.findall(r"### ((?:\\.|[^\\#]|#(?!##))*) ###\n((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", text, re.S)
        assert [(chat.unescape(a), chat.unescape(b)) for a, b in parsed] == [(x[2] or "", x[3] or "") for x in own]
    assert chat.summaries(chat.format_turns(turns.limit(0), PATH), PATH).count() == 0


def test_no_content_makes_a_mark():
    ids, mask = chat.assemble(np.array([5, 6]), np.array([7, 8, 9]), (100, 101, 102), True)
    assert ids.tolist() == [100, 5, 6, 101, 7, 8, 9, 102] and mask.tolist() == [0, 0, 0, 0, 1, 1, 1, 0]
    assert not chat.assemble(np.array([5]), np.zeros(0, int), (100, 101, 102), True)[1].any()


# ---- fingerprints

def _h(b):
    return int(np.uint64(xxhash.xxh64_intdigest(b, seed=42)).view(np.int64))


def plain_fingerprints(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), _h((r[1] or "").encode())))
    out = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        sets = [list(dict.fromkeys(_h(p.encode()) for p in re.findall(r"[^\n]{1,128}\n?|\n", x))) for x in (t, edited, after)]

        def sketch(s):
            cells = [[0, 0, 0] for _ in range(18)]
            for d in s:
                for r in range(3):
                    c = cells[6 * r + (np.uint64(d & (2**64 - 1)) >> np.uint64(20 * r)).view(np.int64) % 6]
                    c[0], c[1], c[2] = c[0] + 1, c[1] ^ d, c[2] ^ _h(d.to_bytes(8, "little", signed=True))
            show = lambda v: f"{v & (2**64 - 1):X}"
            return f"{len(s)}:" + " ".join(".".join(map(show, c)) for c in cells)

        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), sketch(sets[0]), sketch(sets[1]), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return sorted(out, key=repr)


def test_fingerprints(spark, docs):
    rows = [(r[0], r[1]) for r in ROWS]
    got = fingerprints.fingerprints(docs.withColumn("id", F.lit("x")).withColumn("block", F.lit(1))).collect()
    assert sorted(map(tuple, got), key=repr) == plain_fingerprints(rows)
    by_text = {}
    for r in spark.createDataFrame(got).join(docs.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").collect():
        assert by_text.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1 << 50, "b\nc"), (-5, "")], [(7, "x\n" * 3), (7, "x\n" * 3)]])
def test_fingerprints_small(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, fingerprints.fingerprints(df).collect()), key=repr) == plain_fingerprints(rows)


def test_differences_are_recovered(spark):
    rng = random.Random(6)
    pairs = [([rng.getrandbits(63) for _ in range(rng.randint(0, 400))],) * 2 for _ in range(40)]
    pairs = [(a, a[:rng.randint(0, len(a))] + [rng.getrandbits(63) for _ in range(rng.choice([0, 1, 5, 300]))]) for a, _ in pairs]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>").select("a", "b", F.expr(fingerprints.differing("a", "b")).alias("d"))
    for r in df.collect():
        assert {(x["n"], x["k"]) for x in r["d"]} == {(1, x) for x in set(r["a"]) - set(r["b"])} | {(-1, x) for x in set(r["b"]) - set(r["a"])}


def test_followers(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "FEW", 3)
    ids = [1, 2, 5, 70000, 70001, 1 << 40, -9, -(1 << 63)]
    got = dict(map(tuple, fingerprints.followers(spark.createDataFrame([(i,) for i in ids], "id long")).collect()))
    down = sorted(ids, reverse=True)
    assert got == {a: b for a, b in zip(down, down[1:] + down[:1])}


# ---- pipeline

def test_pipeline(spark, tiny):
    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixture", "token_files"]
    state, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, tiny)
        assert name == "token_files" or out.columns == docs.columns
        kept[name] = rows(out)
        state = spark.createDataFrame(out.collect(), out.schema)
    known = {r["doc_id"] for r in langid.identify(docs).where("lang_ok").collect()}
    assert {r[0] for r in kept["language_id"]} == known
    assert {r[0] for r in kept["jaccard_join"]} == {k for k, _, c in plain([(r[0], r[1]) for r in kept["language_id"]]) if k == c}
    hit = {r["doc_id"] for r in decontam.hits(docs, spark.read.parquet(f"{tiny}/benchmark.parquet")).collect()}
    assert hit & {r[0] for r in kept["jaccard_join"]}
    assert {r[0] for r in kept["decontamination"]} == {r[0] for r in kept["jaccard_join"]} - hit
    mixed = mixing.mix(spark.createDataFrame(kept["decontamination"], docs.schema)).collect()
    assert kept["mixture"] == sorted([tuple(r)[:5] for r in mixed for _ in r["draws"]], key=repr)
    tok, want, at = Tokenizer.from_file(PATH), [], 0
    for r in sorted(kept["mixture"]):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert kept["token_files"] == sorted(want, key=repr)
    assert rows(corpus_pipeline.run(spark, tiny)) == kept["token_files"]


def test_stages_on_nothing(spark, tiny, docs):
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tiny).count() == 0
    assert DOCS and setjoin.join(empty).count() == 0


# ---- rows of one key, samples

def test_samples_are_bounded_for_repeated_keys(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("y"), F.lit("t").alias("t"))
    got = common.hash_sample(rows, "y", F.col("k"), 500).collect()
    assert {r["y"] for r in got} == {0, 1} and len(got) == 1000
    assert len({(r["y"], r["k"]) for r in got}) == 1000
    assert sorted(got) == sorted(common.hash_sample(rows.repartition(7), "y", F.col("k"), 500).collect())
    assert common.hash_sample(rows.limit(0), "y", F.col("k"), 5).count() == 0
    assert common.hash_sample(rows.where("k < 20 AND k <> 7"), "y", F.col("k"), 500).count() == rows.where("k < 20 AND k <> 7").select("k", "y").distinct().count()


def test_spans_of_rows_without_or_with_one_key(spark):
    rng = random.Random(1)
    passage = prose(rng, 60, "abcdefg")
    clean = prose(rng, 64, "hijklmn")
    for key in (None, 5):
        rows = [(key, prose(rng, 30, "opqrst") + "\n" + passage), (key, passage + "\n" + prose(rng, 40, "uvwxyz")), (key, clean)]
        out = {r["text"] for r in spans.dedup(spark.createDataFrame(rows * 2, "doc_id long, text string")).collect()}
        assert clean in out and len(out) == 3
        assert sum(passage in t for t in out) == 1
