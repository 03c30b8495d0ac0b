"""Personal data: patterns against plain regular expressions, the field against enumeration."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from routeledger.llm import crf, personal

SCHEMA = "doc_id long, text string, `a b` int, personal string, row string, kind string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(number):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_matches(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(n) <= 19 and plain_luhn(n),
                "phone": 10 <= len(n) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


AWKWARD = [
    "", "a@b.c@d.e", "@@a.b", "x@y..z a@b-c.d-e.f. ..@..", "a@b a@b.", "1.2.3.4.5.6.7.8.9", "1.2.3",
    "256.1.1.1 001.02.0003.255", "4111111111111111 4111 1111 1111 1111-2", "+1 (743) 555-3824 170.106.47.218",
    "+1 555 123 4567+49 30 1234567", "+1(", "é4111-1111-1111-1111é +49.30.1234567-", "0" * 16, "1 - 2",
    "a.b@c.d1.2.3.4", "%@%.% a@%", "+" * 5 + "1234567890", "٤٥٦ 1.1.1.1 ٤@٥.٦",
]


def test_patterns_match_plain_expressions():
    rng = random.Random(4)
    signs = ["1", "22", "333", "4111", "0", ".", "-", " ", "@", "+", "(", ")", "a", "b.c", "é", "\n", "4111111111111111"]
    texts = AWKWARD + ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(4000)]
    for text in texts:
        assert personal.matches(text) == plain_matches(text), text


def test_long_runs_take_linear_time():
    for text in ["x" * 400_000, "1" * 400_000, "@" * 400_000, "300." * 100_000, "a@" * 200_000, "+1 " * 150_000]:
        assert personal.matches(text) == []


def small_field(seed):
    model = crf.Crf(["p", "q"])
    rng = np.random.default_rng(seed)
    model.moves = rng.normal(size=model.moves.shape)
    scores = rng.normal(size=(3, 4, 5))
    return model, scores, np.array([4, 1, 3])


def plain_labellings(model, scores, n):
    for labels in itertools.product(range(5), repeat=n):
        total = model.first[labels[0]] + sum(scores[t, k] for t, k in enumerate(labels))
        total += sum((model.moves + model.barred)[a, b] for a, b in zip(labels, labels[1:]))
        yield total, labels


def test_viterbi_and_posteriors_match_enumeration():
    model, scores, lengths = small_field(1)
    best = model.viterbi(scores, lengths)
    total, chance, pairs = model.posteriors(scores, lengths)
    want_pairs = np.zeros((5, 5))
    for k, n in enumerate(lengths):
        every = list(plain_labellings(model, scores[k], n))
        assert tuple(best[k, :n]) == max(every)[1]
        weights = np.exp([s for s, _ in every])
        assert total[k] == pytest.approx(np.log(weights.sum()))
        want = np.zeros((n, 5))
        for w, (_, labels) in zip(weights / weights.sum(), every):
            want[np.arange(n), labels] += w
            for a, b in zip(labels, labels[1:]):
                want_pairs[a, b] += w
        assert np.allclose(chance[k, :n], want) and not chance[k, n:].any()
    assert np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def model():
    return personal.trained(personal.labelled())


def test_field_on_held_out_fillings(model):
    rows = personal.labelled(seed=77, copies=6)
    got = personal.find_all([t for t, _ in rows], model)
    right = found = wanted = 0
    for spans, (text, gold) in zip(got, rows):
        gold = {g for g in gold if personal.plausible(g[0], text[g[1] : g[2]])}
        own = {s[:3] for s in spans}
        right, found, wanted = right + len(own & gold), found + len(own), wanted + len(gold)
    assert right / found > 0.93 and right / wanted > 0.93


def test_field_adds_other_forms(model):
    text = "call (743) 555-3824 or write to anna.b [at] example [dot] org, card 4111.1111.1111.1111 of 2024-05-17"
    spans = personal.find_all([text], model)[0]
    assert [(k, text[s:e]) for k, s, e, _ in spans] == [
        ("phone", "(743) 555-3824"), ("email", "anna.b [at] example [dot] org"), ("card", "4111.1111.1111.1111"),
    ]
    assert not any(base for *_, base in spans)
    clean = ["From 1990 to 1995 prices rose by 12.5 %.", "token = \"586908a73d53ffc7776756ed304e7317d12d4663\"",
             "It cost $1,250.00 on 2024-05-17 at 14:30.", "a card 4111.1111.1111.1112"]
    assert personal.find_all(clean, model) == [[], [], [], []]


def test_pieces_cover_a_window_once(monkeypatch):
    monkeypatch.setattr(personal, "LONGEST", 100)
    monkeypatch.setattr(personal, "OVERLAP", 20)
    for end in range(1, 500):
        cut = personal.pieces(0, end)
        assert cut[0][2] == 0 and cut[-1][3] == end
        assert all(a[3] == b[2] for a, b in zip(cut, cut[1:]))
        assert all(s <= low and high <= e and e - s <= 100 for s, e, low, high in cut)


def test_digest(spark, model):
    rows = [(k, t) for k, t in enumerate(AWKWARD)] + [
        (100, None), (101, "plain words"), (101, "plain words"), (None, "x@y.zz"),
        (102, ("+1 (743) 555-3824 and é " * 3000)), (103, "tel (743) 555-3824"),
    ]
    docs = spark.createDataFrame([(i, t, 1, "p", "r", "k") for i, t in rows], SCHEMA).repartition(3)
    got = {}
    for r in personal.digest(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text in rows:
        base = plain_matches(text or "")
        for r in got[doc_id]:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
                sum(k == kind for k, _, _ in base) for kind in personal.KINDS
            ]
            joined = [f"{k}:{s}:{e}" for k, s, e in base]
            assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
            assert set(joined) <= set(r.spans.split(","))
    assert got[103][0].spans == "phone:4:18" and got[101][0].spans == ""
    found = personal.find(docs, model, ["doc_id", "a b", "row", "kind"])
    assert found.columns == ["doc_id", "a b", "row", "kind", "personal"]
    assert found.count() == len(rows)
    nothing = spark.createDataFrame([], SCHEMA)
    assert personal.digest(nothing).count() == 0
