"""Operators against brute force on small tables with the awkward cases in them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeledger.llm import (
    decontaminate,
    language,
    language_model,
    licenses,
    lines,
    near_duplicates,
    packing,
    sharding,
    substrings,
    topk,
)
from routeledger.llm.components import components

SCHEMA = "doc_id long, text string, block int, start string, row string, k string, node int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(1, 60)
    near = prose(2, 200).split()
    changed = near[:]
    changed[100] = "other"
    return [
        (1, f"{prose(3, 50)} {shared} {prose(4, 40)}"),
        (2, f"{prose(5, 20)}\n{shared}\n{prose(6, 45)}"),
        (3, " ".join(near)),
        (4, " ".join(changed)),
        (5, " ".join(near)),
        (6, None),
        (7, ""),
        (8, " \n\t \n"),
        (9, "three words only"),
        (10, "three words only"),
        (11, "Élan vital É é ǅ <|endoftext|> it's 12,5 \x01 x"),
        (12, prose(7, 9000, 5000)),
        (13, "same line here\nsecond line\nthird line\nfourth"),
        (14, "zero\nsame line here\nsecond line\nthird line\n\nlast"),
        (15, "a\na\na\na\na"),
        (None, "no id at all but words " * 3),
        (16, "twice"),
        (16, "twice"),
        (17, "x" * 50_000),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, 7, "s", "r", "k", 1) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_substrings(docs, rows, nothing):
    got = Counter(
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
        for r in substrings.remove_repeats(docs).collect()
    )
    seen = Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t in rows) for i in range(len(w) - 34))
    want = Counter()
    for doc_id, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[(doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert substrings.remove_repeats(nothing).count() == 0


def test_line_windows(docs, rows, nothing):
    got = {(r.doc_id, r.text, r.lines_removed) for r in lines.without_repeats(docs).collect()}
    assert (13, rows[12][1], 0) in got
    assert (14, "zero\n\nlast", 3) in got
    assert (15, "a", 4) in got
    assert (6, None, 0) in got and (7, "", 0) in got
    assert lines.without_repeats(docs).columns == [*docs.columns, "lines_removed"]
    assert lines.without_repeats(docs).count() == len(rows)
    assert lines.without_repeats(nothing).count() == 0


def shingles(text):
    w = words((text or "").translate(LOW))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(docs, rows, nothing):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates.near_duplicates(docs).collect())
    sets = [shingles(t) for _, t in rows]
    link = defaultdict(set)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                link[a].add(b)
    want = Counter()
    for a, (doc_id, _) in enumerate(rows):
        reach, todo = {a}, [a]
        while todo:
            fresh = link[todo.pop()] - reach
            reach |= fresh
            todo += fresh
        ids = [rows[b][0] for b in reach if rows[b][0] is not None]
        want[(doc_id, min(ids) if ids else None, len(link[a]))] += 1
    assert got == want
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 6, 7, 8, 9, *range(11, 18)]
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_large_group_is_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK", 8)
    base = prose(9, 400).split()
    texts = []
    for i in range(40):
        w = base[:]
        w[10 * i] = f"changed{i}"
        texts.append((i, " ".join(w)))
    found = near_duplicates.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {(r.class_id, r.n_links) for r in found.collect()} == {(0, 39)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = components(spark.createDataFrame(edges, "u long, v long"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_prefixes_are_shortened_until_the_recall():
    depth = near_duplicates.prefix_depth(0.8, 32, 8, 0.9999)
    assert 1 - (1 - 0.8**depth) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 32


def test_contamination_of_lines_phrases_and_unspaced_scripts(spark):
    benchmark = spark.createDataFrame(
        [
            (1, "What is 3 times 9 plus one"), (2, "Who wrote hamlet"), (3, "中国的首都是哪里？"),
            (4, "The treaty between France and Spain was signed by King Louis in Paris"),
            (5, "ประเทศไทยมีกี่จังหวัด"), (6, "of the day"),
        ],
        "item_id long, text string",
    )
    texts = [
        (1, "Exercise one\nWhat is 3 times 9 plus one"), (2, "I asked who wrote hamlet and left"),
        (3, "请问中国的首都是哪里？谢谢"), (4, "The treaty between\r\n  France and Spain was signed by King Louis in Paris"),
        (5, "Exercise two\n\n  What is 14 times 2 plus one\nmore"), (6, "ถาม ประเทศไทยมีกี่จังหวัด ครับ"),
        (7, "我们明天去北京的首都机场"), (8, "Exercise one\nWhy is the sky blue at noon in May"),
    ] + [(100 + i, f"the end of the day number {'x' * i}") for i in range(20)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("a b", F.lit(1))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(frame, benchmark).collect()}
    assert found == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 5)}


def test_contamination_finds_every_literal_copy(spark):
    rng = random.Random(12)
    vocabulary = ["Anna", "rome", "12", "3.5", "kg", "run", "the", "Of", "blue", "x-ray", "it's", "Paris", "river", "go"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(4, 25)))) for k in range(30)]
    texts = []
    for k in range(120):
        words = [f"{rng.choice('abc')}{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 60))]
        if k % 2:
            at = rng.randrange(len(words))
            copy = rng.choice(items)[1].split()
            copy = [w.lower() for w in copy] if rng.random() < 0.3 else copy
            words[at:at] = [w + rng.choice(["", "", "\n", ","]) for w in copy]
        texts.append((k, rng.choice([" ", "\n", "  "]).join(words)))
    bare = lambda t: re.findall(r"[\w\x02-]+", re.sub(r"[^\w\s]", "", t.lower()))
    want = set()
    for k, text in texts:
        w = bare(text)
        for i, item in items:
            n = len(bare(item))
            want |= {(k, i)} if any(w[p : p + n] == bare(item) for p in range(len(w) - n + 1)) else set()
    found = decontaminate.contamination(
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert want and want <= got and all(k % 2 for k, _ in got)


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(docs).toPandas()
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(whole.encode(text or "", add_special_tokens=False).ids + [2])
    for doc_id, texts in ids.items():
        mine = pieces[pieces.doc_id.isna() if doc_id is None else pieces.doc_id == doc_id]
        assert mine.length.sum() == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in mine.sort_values("start").itertuples():
                part = np.array(texts[0][p.start : p.start + p.length], dtype="<u4").tobytes()
                assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(part), len(texts[0]))
                at += p.length
    for _, group in pieces.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert list(group.offset) == [0, *np.cumsum(group.length)[:-1]]
        n = group.length.sum()
        assert n <= 4096 and (group.padding == (0 if n & (n - 1) == 0 else 4096 - n)).all()
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    position, penalty = [0], [0]
    while len(position) < 12:
        position.append(position[-1] + rng.randrange(1, 9))
        penalty.append(rng.choice([0, 3, 9]))
    chosen = packing.choose_cuts(position, penalty, 16)

    def cost(cuts):
        total, before = 0, 0
        for j in cuts:
            n = position[j] - position[before]
            if n > 16:
                return 10**9
            total += (0 if n & (n - 1) == 0 else 16 - n) + penalty[j] + packing.SEQUENCE_COST
            before = j
        return total

    last = len(position) - 1
    every = ([j for j in range(1, last) if mask >> j & 1] + [last] for mask in range(0, 1 << last, 2))
    assert cost(chosen) == min(map(cost, every))


def test_licenses(spark, rows, docs, nothing):
    texts = [
        (1, "Code under the MIT-License. Also: CC-BY-NC, cc by nc 4.0"),
        (2, "Apache License, Version 2.0 applies"),
        (3, "licensed under the gnu general public license, version 3"),
        (4, "the license of a version"),
        (5, None),
        (6, "under the mit license " * 3),
    ]
    found = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.doc_id: r for r in found.collect()}
    base = lambda i: (got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels)
    assert base(1) == (3, 1, 9, "cc-by-nc,mit") and base(2) == (1, 0, 0, "apache-2")
    assert base(3) == (0, None, None, "") and got[3].labels == "gpl"
    assert got[4].labels == "" and got[5].n_words == 0 and base(6) == (3, 0, 8, "mit")
    plain = licenses.scan(docs)
    assert plain.count() == len(rows) and licenses.scan(nothing).count() == 0
    counts = {r.doc_id: r.n_words for r in plain.collect()}
    for doc_id, text in rows:
        low = (text or "").translate(LOW)
        assert counts[doc_id] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))


def test_sharding(spark, docs, rows, nothing):
    texts = [(i, prose(i, 10)) for i in range(150)] + [(200 + i, f"group {i % 6}") for i in range(60)]
    texts += [(300 + i, "hot") for i in range(90)]
    for frame, n in ((spark.createDataFrame(texts, "doc_id long, text string"), 300), (docs, len(rows))):
        found = sharding.shard(frame).toPandas()
        assert len(found) == n
        sizes = found.groupby("shard").size()
        assert sizes.max() - sizes.min() <= 1 and len(sizes) == 16
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
        if n == 300:
            small = found[(found.doc_id >= 200) & (found.doc_id < 300)]
            assert (small.groupby("text_crc32").shard.nunique() == 1).mean() > 0.8
    assert sharding.shard(nothing).count() == 0


def test_large_group_fills_few_shards(spark):
    texts = [(i, prose(i, 10)) for i in range(640)] + [(1000 + i, "hot") for i in range(320)]
    found = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    hot = found[found.doc_id >= 1000].groupby("shard").size()
    assert len(found) == 960 and set(found.groupby("shard").size()) == {60}
    assert len(hot) == 6


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    vectors += [(1000 + i, [0.5] * 8) for i in range(60)]
    vectors += [(50, None), (51, [None] * 8), (100, [float("nan")] * 8), (150, [float("inf")] * 8)]
    vectors += [(2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (None, [0.1] * 8), (2050, [])]
    found = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()}
    valid = [
        (i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)))
        for i, v in vectors
        if i is not None and v and None not in v and np.isfinite(v).all()
    ]
    want = set()
    for q, x in valid:
        if q % 50 == 0:
            ranked = sorted((-int(x @ y), i) for i, y in valid if i != q and len(x) == len(y))
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(ranked[:5], 1)}
    assert got == want


def test_language_model(docs, rows, nothing):
    got = {(r.doc_id, r.n_tokens): r for r in language_model.score(docs).collect()}
    texts = [(i, [*words((t or "").translate(LOW)), None]) for i, t in rows]
    counts = Counter(x for i, w in texts if not language_model.held_out(i) for x in w)
    total = sum(counts.values())
    for i, w in texts:
        r = got[(i, len(w))]
        base = sum(np.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w)
        assert (r.n_known, r.train_tokens) == (sum(counts[x] > 0 for x in w), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert language_model.score(nothing).count() == 0


def test_contamination(spark, docs, rows, nothing):
    benchmark = spark.createDataFrame(
        [
            (1, "On Monday the trader Anna bought 12 kg of rice for 30 euros and sold 5 kg to Bob"),
            (2, "a b"), (3, None), (4, "what is the largest river of this country called"),
            (4, "what is the largest river of this country called"),
        ],
        "item_id long, text string",
    )
    texts = [
        (1, "Intro. On Monday the trader Carla bought 99 kg of rice for 7 euros and sold 4 kg to Dan. End"),
        (2, "Tell me: What is the largest river of this country called?"),
        (3, "On Monday the weather was fine and the trader slept a b"),
        (4, None), (5, ""),
    ]
    found = decontaminate.contamination(
        spark.createDataFrame(texts, "doc_id long, text string"), benchmark
    )
    assert {(r.doc_id, r.item_id, r.exact) for r in found.collect()} == {(1, 1, False), (2, 4, True)}
    assert decontaminate.clean(docs, benchmark).count() == len(rows)
    assert decontaminate.clean(docs, benchmark).columns == docs.columns
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).count() == 0


def test_slots_must_agree(spark):
    item = "the clerk Anna met the clerk Anna and the guard Bob near the old gate again"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    agree = item.replace("Anna", "Carla").replace("Bob", "Dan")
    differ = agree.replace("Carla", "Eve", 1)
    frame = spark.createDataFrame([(1, agree), (2, differ)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.contamination(frame, benchmark).collect()] == [1]


def test_items_of_slots_and_short_items(spark):
    items = [
        (1, "Compute 12 + 7 * 3 - 45 / 9."), (2, "Add 3, 5, 8, 13, 21, 34 and 55 to 100."),
        (3, "2 + 2 = ?"), (4, "Who wrote Hamlet?"), (5, "Stop. Go!"),
    ]
    texts = [(i, f"Some words come first. {text} And more follow here") for i, text in items]
    texts += [
        (11, "Compute 12 + 7 * 3 - 45 / 8."), (12, "Add 3, 5, 9, 13, 22, 34 and 56 to 100."),
        (13, "there are 2 + 2 reasons to stay"), (14, "I forgot who wrote hamlet in the end"),
        (15, "stop\ngo\nhome"), (16, "stop go"), (17, None),
    ]
    found = decontaminate.contamination(
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    # Three words that the corpus holds rarely count inside a sentence too.
    want = {(i, i, 4) for i in range(1, 6)} | {(15, 5, 0), (14, 4, 2)}
    assert {(r.doc_id, r.item_id, r.start) for r in found} == want
    assert all(r.exact and r.cover == 1 for r in found)


def test_slots_that_may_differ(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    more = [prose(71, 30).lower().translate(letters), prose(72, 20).lower().translate(letters)]
    long = f"the clerk Anna met {more[0]} and then Anna left the town {more[1]}"
    sums = "a farmer sells 2 apples and 2 pears to each child that comes by the gate"
    benchmark = spark.createDataFrame([(1, long), (2, sums)], "item_id long, text string")
    texts = [
        (1, long.replace("Anna", "Eve", 1)),
        (2, sums.replace("2 apples", "3 apples").replace("2 pears", "5 pears")),
        (3, prose(73, 60)),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontaminate.contamination(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.exact) for r in found} == {(1, 1, False), (2, 2, False)}


def test_case_and_white_space_of_copies(spark):
    item = "The treaty between France and Spain was signed by King Louis in Paris"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [
        item.lower(), item.upper(), item.replace(" France", "  France").replace(" King", "\r\n\tKing"),
        item.replace("and Spain", "and\u00a0\u00a0Portugal").replace(" King", "\r\n  King").replace("France", "Genoa"),
        "the treaty was signed by the king in paris between the two of them",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contamination(frame, benchmark).collect()
    assert {(r.doc_id, r.exact) for r in found} == {(0, True), (1, True), (2, True), (3, False)}


def test_language(spark, docs, rows, nothing):
    speech = {"xx": "lorem ipsum dolor sit amet consectetur", "yy": "ganz viele worte mit anderem klang"}
    rng = random.Random(3)
    texts = [
        (i, " ".join(rng.choices(speech[lang].split(), k=60)), lang)
        for i in range(120) for lang in [rng.choice(["xx", "yy"])]
    ]
    frame = spark.createDataFrame([*texts, (999, "no label", None)], "doc_id long, text string, lang string")
    raw = language.dictionaries(language.training_rows(frame))
    assert set(raw) == {"xx", "yy"}
    odd = frame.withColumn("row", F.lit(1)).withColumn("a b", F.lit(2)).withColumn("x,y:z", F.lit(3))
    assert language.identify(odd, raw).columns[:6] == odd.columns
    found = language.identify(odd, raw).collect()
    assert all(r.lang_pred == r.lang and r.accepted and 0 <= r.score <= 1 for r in found if r.lang)
    plain = {r.doc_id: r for r in language.identify(docs, raw).collect()}
    assert [plain[i].lang_pred for i in (6, 7, 8)] == ["und"] * 3
    assert language.identify(docs, {}).count() == len(rows)
    assert language.identify(nothing, raw).count() == 0
    assert language.dictionaries(nothing.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_every_label_gets_a_dictionary(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    speech = [[word() for _ in range(12)] for _ in range(140)]
    texts = [
        (1000 * n + i, " ".join(rng.choices(speech[n], k=40)), f"l{n:03d}")
        for n in range(140) for i in range(1 + (n < 130))
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    raw = language.dictionaries(frame)
    assert set(raw) == {f"l{n:03d}" for n in range(140)}
    assert sum(map(len, raw.values())) <= language.ALL_BYTES
    assert all(r.lang_pred == r.lang and r.accepted for r in language.identify(frame, raw).collect())
