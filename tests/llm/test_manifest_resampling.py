"""The manifest and the resampling against plain loops, on rows with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeledger.llm import manifest, ranks, resampling

# The extra columns carry names that the operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "tree string, pos long, n long, digest string, key string, row_id long"
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        words = [rng.choice(["Alpha", "beta", "GAMMA", "été", "x1"]) for _ in range(rng.randrange(60))]
        out.append((i, "\n".join([" ".join(words), "end."]), "en", f"s{min(i % 7, 2)}", len(words)))
    out += [
        (100, None, None, None, None), (101, "", "de", None, 0), (102, "a\n\nb", "en", "", 4),
        (103, "lone\n", "en", "é only", 5), (None, "no id\n", "en", "s0", 6),
        (None, "no id\n", "en", "s0", 6), (7, "same id, other text", "en", "s0", 3),
        (104, "y" * 40_000 + " z" * 30, "en", "s1", 40_060), (105, "!? \t", "en", "s1", 4),
        (106, "twin " * 25, "en", "s2", 1), (106, "twin " * 25, "en", "s2", 1),
        (107, "a b c ç " * 9, "en", "s2", 2), (-5, "beta\x00x1 " * 21, "xx", "s2", 9),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(*r, "t", 1, 2, "d", "k", 3) for r in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_leaf(doc_id, source, lang, n_chars, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(parts))


def plain_tree(level):
    """The root, and for each leaf its siblings with its place, by simple levels."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, p in enumerate(at):
            near = level[p // 3 * 3 : p // 3 * 3 + 3]
            paths[k].append((near[: p % 3], near[p % 3 + 1 :]))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], paths


def plain_audit(rows):
    leaves = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = plain_leaf(doc_id, source, lang, n_chars, text)
        other = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            other = text.replace("\n", "")
        checked = plain_leaf(doc_id, source, lang, n_chars, other)
        leaves.setdefault(source, []).append((doc_id, own, checked))
    order = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        leaves[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = plain_tree([x[1] for x in leaves[s]])
    root, tops = plain_tree([trees[s][0] for s in order])
    found = Counter()
    for s, top in zip(order, tops):
        for (doc_id, own, checked), path in zip(leaves[s], trees[s][1]):
            h, proof = checked, ""
            for left, right in path + top:
                h = sha("".join([*left, h, *right]))
                proof += "".join([*left, *right])
            found[doc_id, own, trees[s][0], root, sha(proof), h, h == root] += 1
    return found


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(docs, rows, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    monkeypatch.setattr(manifest, "SHARE", 2)
    got = Counter(tuple(r) for r in manifest.audit(docs).collect())
    assert got == plain_audit(rows)
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_few_rows(spark, docs, nothing):
    assert manifest.audit(nothing).count() == 0
    lone = docs.filter("doc_id = 103")
    found = manifest.manifest(lone).first()
    assert found.leaf == found.subroot == found.root and found.siblings == []


def test_multiproof_is_minimal():
    # Leaves 0-2 and 4 of ten: node 1 of level 1 needs leaves 3 and 5, the rest follows.
    assert manifest.missing([0, 1, 2, 4], 10) == [(0, 3), (0, 5), (1, 2), (2, 1)]
    assert manifest.missing(list(range(10)), 10) == []
    assert manifest.missing([0], 1) == []


def test_places(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaaab"), rng.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(6)
    got = {r.i: (r.pos, r.n) for r in ranks.places_in(df, "k", [F.col("v"), F.col("i")], "t").collect()}
    for key in "ab":
        own = sorted((v, i) for k, v, i in data if k == key)
        assert [got[i] for _, i in own] == [(p, len(own)) for p in range(len(own))]
    got = {r.i: r.pos for r in ranks.places(df, [F.col("v"), F.col("i")], "t").collect()}
    assert [got[i] for _, _, i in sorted(data, key=lambda r: r[1:])] == list(range(500))


def plain_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_resample(rows, target, run, buckets):
    def grams(text):
        w = plain_words(text)
        return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]

    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    s = Counter(bucket(g) for r in rows for g in grams(r[1]))
    t = Counter(bucket(g) for x in target for g in grams(x))
    scored = []
    for r in rows:
        own = grams(r[1])
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
            for b in map(bucket, own)
        ]
        mean = sum(gain) // len(gain) if gain else 0
        h = int(sha(f"2024:{'' if r[0] is None else r[0]}")[:8], 16)
        score = mean + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((r[0], len(own), mean, score, len(plain_words(r[1])) >= 20))
    ranked = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = ranked[: 10 * len(ranked) // 100]
    found = Counter((*x[:4], k + 1) for k, x in enumerate(drawn))
    for x in [x for x in scored if not x[4]] + ranked[len(drawn) :]:
        found[(*x[:4], None)] += 1
    return found


@pytest.mark.parametrize("run", [1, 2, 3])
def test_resampling(spark, docs, rows, nothing, run):
    texts = ["alpha beta beta", "x1 été x1", None, "", "y" * 40_000]
    target = spark.createDataFrame([(t,) for t in texts], "text string")
    got = Counter(tuple(r) for r in resampling.resample(docs, target, run=run, buckets=997).collect())
    assert got == plain_resample(rows, texts, run, 997)
    if run == 1:
        assert resampling.resample(nothing, target).count() == 0
        got = Counter(tuple(r) for r in resampling.resample(docs, nothing).collect())
        assert got == plain_resample(rows, [], 1, 10_000)


def test_composed_crcs():
    rng = random.Random(2)
    a = [rng.randbytes(rng.randrange(9)) for _ in range(50)]
    b = [rng.randbytes(rng.choice([0, 1, 5, 255, 70_000])) for _ in range(50)]
    got = resampling.appended(
        np.array([zlib.crc32(x) for x in a], np.uint32), np.array([len(x) for x in b]),
        np.array([zlib.crc32(x) for x in b], np.uint32),
    )
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_texts_are_grouped_by_size(monkeypatch):
    monkeypatch.setattr(resampling, "BATCH_BYTES", 10)
    groups = list(resampling._groups(["a" * 6, "b" * 6, None, "c" * 30, "d"]))
    assert groups == [["a" * 6, "b" * 6], [None, "c" * 30], ["d"]]
