"""Rename pairing against a plain loop over all pairs."""

import random

from pyspark.sql import functions as F

from routeledger.operators import provenance, ranks, renames

FILE = "repo string, path string, blob string"


def plain_renames(now, then, lines):
    """Pairs of one repo: equal contents by base name and path, then the most alike."""
    added = sorted(p for p in now if p not in then)
    removed = sorted(p for p in then if p not in now)
    pairs = {}

    def left(paths, used):
        return [p for p in paths if p not in used]

    for key in (lambda f, p: (f[p], p.rsplit("/", 1)[-1]), lambda f, p: f[p]):
        new, old = left(added, pairs), left(removed, {o for o, _ in pairs.values()})
        for value in {key(now, p) for p in new if now[p] is not None}:
            mine = [p for p in new if key(now, p) == value]
            theirs = [p for p in old if key(then, p) == value]
            pairs |= {a: (b, 1.0) for a, b in zip(mine, theirs)}

    def alike(a, b):
        x, y = set(lines.get(now[a], [])), set(lines.get(then[b], []))
        return len(x & y) / max(len(x), len(y)) if x and y else 0

    new, old = left(added, pairs), left(removed, {o for o, _ in pairs.values()})
    sets_new = [p for p in new if lines.get(now[p])]
    sets_old = [p for p in old if lines.get(then[p])]
    for a in sets_new:
        same = a.rsplit("/", 1)[-1]
        mine = [p for p in sets_new if p.rsplit("/", 1)[-1] == same]
        theirs = [p for p in sets_old if p.rsplit("/", 1)[-1] == same]
        if len(mine) == len(theirs) == 1 and alike(a, theirs[0]) >= 0.5:
            pairs[a] = (theirs[0], alike(a, theirs[0]))
    new, old = left(sets_new, pairs), left(sets_old, {o for o, _ in pairs.values()})
    for score, a, b in sorted((-alike(a, b), a, b) for a in new for b in old if alike(a, b) >= 0.5):
        if a not in pairs and b not in {o for o, _ in pairs.values()}:
            pairs[a] = (b, -score)
    return pairs


def test_renames_match_a_plain_loop(spark):
    rng = random.Random(9)
    now, then, known, want = [], [], [], set()
    for repo in ("a", "b"):
        lines = {}
        # Families of related contents, some shared, one very common, one unknown.
        for family in range(6):
            base = [f"{family}.{k}" for k in range(10)] + ["}", ""]
            for variant in range(4):
                kept = rng.sample(base, rng.randrange(4, 12))
                lines[f"{family}/{variant}"] = kept + [f"own {family} {variant} {k}" for k in range(rng.randrange(5))]
        lines["common"], blobs = ["# same"], [*lines, "common", "common", "common", None, "unknown"]
        known += [(repo, b, x) for b, x in lines.items()]
        old, new = (
            {f"{top}{rng.randrange(3)}/f{rng.randrange(30)}.py": rng.choice(blobs) for _ in range(40)} for top in "xy"
        )
        kept = {p: rng.choice(blobs) for p in ("k1", "k2")}
        old, new = old | kept, new | kept
        then += [(repo, p, b) for p, b in old.items()]
        now += [(repo, p, b) for p, b in new.items()]
        want |= {(repo, p, o, round(s, 6)) for p, (o, s) in plain_renames(new, old, lines).items()}
    head, baseline = spark.createDataFrame(now, FILE), spark.createDataFrame(then, FILE)
    blobs = spark.createDataFrame(known, "repo string, blob string, lines array<string>")
    hashed = blobs.withColumn("lines", F.transform("lines", lambda x: F.xxhash64(x)))
    found = renames.renames(head.repartition(3), baseline.repartition(2), hashed)
    assert {(r.repo, r.path, r.old_path, round(r.score, 6)) for r in found.collect()} == want
    assert any(s < 1 for *_, s in want)
    added = provenance.added_since_ref(head, baseline, hashed)
    moved = {(r, p) for r, p, *_ in want}
    fresh = {(r, p) for r, p, _ in now} - {(r, p) for r, p, _ in then} - moved
    assert {tuple(r) for r in added.collect()} == fresh


def test_renames_without_files_or_contents(spark):
    nothing = spark.createDataFrame([], FILE)
    one = spark.createDataFrame([("a", "x.py", "b1"), ("a", "y.py", None)], FILE)
    assert renames.renames(nothing, nothing).count() == 0
    assert renames.renames(one, nothing).count() == renames.renames(nothing, one).count() == 0
    moved = spark.createDataFrame([("a", "z/x.py", "b1"), ("a", "z/y.py", None)], FILE)
    assert [r.path for r in renames.renames(moved, one).collect()] == ["z/x.py"]


def test_numbers_within_a_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), i) for i in rng.sample(range(900), 400)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    got = {(r.k, r.i): r.number for r in ranks.number_within(df, ["k"], [F.col("i")], "n").collect()}
    for key in "ab":
        assert [got[key, i] for i in sorted(i for k, i in rows if k == key)] == list(range(sum(k == key for k, _ in rows)))
