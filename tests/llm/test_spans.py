"""Personal data: the base patterns against plain regular expressions, the model against sums over all segmentations."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from tessella.llm import queries, spans

SCHEMA = "doc_id long, text string, kind string, spans string, start long, base int"


def plain(text: str) -> list[tuple]:
    """The contract's patterns, by the library's matcher."""
    fits = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[ -]", "", s)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return [(kind, *m.span()) for kind, (pattern, fit) in fits.items() for m in re.finditer(pattern, text) if fit(m.group())]


def luhn(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def test_base_spans():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", "+", " ", "1", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1 (243) 555-5526", "x@y.z", "\n", "(", ")", "0", "é", "%", "_", "٣", "1.2.3.4", "a@b", "ab@c-.d.", ",", "+1"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert spans.base_spans(text) == plain(text), text


def test_base_spans_of_documents():
    duckdb = pytest.importorskip("duckdb")
    try:
        texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    except duckdb.IOException:
        pytest.skip("the tables aren't there")
    found = [spans.base_spans(t) for (t,) in texts]
    assert found == [plain(t) for (t,) in texts] and len(set(k for s in found for k, *_ in s)) == 4


@pytest.mark.parametrize("unit", ["x", "1", "1 ", "1.", "+1", "a@", "@", "+1 ", "1-", "a.b@c", "1.2.3.4 "])
def test_long_texts_take_linear_time(unit):
    began = time.time()
    spans.all_spans(unit * (60_000 // len(unit)), spans.fitted())
    assert time.time() - began < 40
    spans.base_spans(unit * (2_000_000 // len(unit)))
    assert time.time() - began < 60


def segmentations(n: int, candidates: list[tuple[int, int]]):
    """All ways to cut n tokens into single tokens of nothing and candidates of a kind: rows of (start, end, kind)."""
    begins: dict[int, list] = {}
    for i, j in candidates:
        begins.setdefault(i, []).append(j)

    def go(t):
        if t == n:
            yield []
            return
        for rest in go(t + 1):
            yield [(t, t + 1, 0), *rest]
        for j in begins.get(t, ()):
            for rest in go(j):
                for kind in range(1, len(spans.KINDS) + 1):
                    yield [(t, j, kind), *rest]

    return go(0)


def total(model: spans.Model, region: spans.Region, segments: list[tuple]) -> float:
    last, out = 0, 0.0
    for i, j, kind in segments:
        out += model.steps[last, kind] + (model.score(region.features(i, j))[kind - 1] if kind else 0)
        last = kind
    return out


TEXTS = ["call 555-1234 or a@b.io", "ip 10.0.0.1 x", "to x (at) y.de 12", "+1 22 33", "key a1b2c3d4e5f6a7b8c9 5"]


@pytest.mark.parametrize("text", TEXTS)
def test_best_segmentation_is_the_best_of_all(text):
    rng = np.random.default_rng(6)
    names = dict(spans.fitted().names)
    for _ in range(5):
        model = spans.Model(names, rng.normal(size=(len(names), len(spans.KINDS))), rng.normal(size=(len(spans.KINDS) + 1,) * 2))
        (region,) = spans.regions(text)
        best = max(total(model, region, s) for s in segmentations(len(region.tokens), region.candidates()))
        found = {i: (j, k + 1) for i, j, k in model.best(region)}
        segments, t = [], 0
        while t < len(region.tokens):
            j, kind = found.get(t, (t + 1, 0))
            segments.append((t, j, kind))
            t = j
        assert total(model, region, segments) == pytest.approx(best)


def test_likelihood_and_slopes():
    rng, names = np.random.default_rng(7), {}
    gold = [("phone", 5, 13), ("email", 17, 23)]
    given = spans.lattice([(TEXTS[0], gold), (TEXTS[1], [("ip", 3, 11)])], names)
    weights, steps = rng.normal(size=(len(names), len(spans.KINDS))) / 3, rng.normal(size=(len(spans.KINDS) + 1,) * 2) / 3
    value, up, slope = given.gradient(weights, steps)
    model, want = spans.Model(names, weights, steps), 0.0
    for text, right in ((TEXTS[0], gold), (TEXTS[1], [("ip", 3, 11)])):
        (region,) = spans.regions(text)
        scores, own = [], None
        for s in segmentations(len(region.tokens), region.candidates()):
            scores.append(total(model, region, s))
            if {(spans.KINDS[k - 1], region.tokens[i][0], region.tokens[j - 1][1]) for i, j, k in s if k} == set(right):
                own = scores[-1]
        want += own - np.logaddexp.reduce(scores)
    assert value == pytest.approx(want)
    for _ in range(20):
        at, which = (rng.integers(len(names)), rng.integers(len(spans.KINDS))), (rng.integers(6), rng.integers(6))
        for values, index, found in ((weights, at, up), (steps, which, slope)):
            both = []
            for e in (1e-5, -1e-5):
                values[index] += e
                both.append(given.gradient(weights, steps)[0])
                values[index] -= e
            assert found[index] == pytest.approx((both[0] - both[1]) / 2e-5, abs=1e-5)


def test_held_out_sentences():
    model, rng = spans.fitted(), random.Random(99)
    right = wanted = found = 0
    for _ in range(1000):
        text, gold = spans.sentence(rng)
        own = model.spans(text)
        right += len(set(gold) & set(own))
        wanted += len(gold)
        found += len(own)
    assert right >= 0.98 * wanted and right >= 0.98 * found


def test_boundaries_and_kinds():
    model = spans.fitted()
    cases = {
        "write to jo (at) mail (dot) org, or": ("email", "jo (at) mail (dot) org"), "call (243) 555-5526 now": ("phone", "(243) 555-5526"), "visa 4111 1111 1111 1111": ("card", "4111 1111 1111 1111"),
        "host 10[.]20[.]30[.]40 up": ("ip", "10[.]20[.]30[.]40"), 'token = "a94f8fe5ccb19ba61c4c0873d391e987982fbbd3"': ("secret", "a94f8fe5ccb19ba61c4c0873d391e987982fbbd3"),
    }
    for text, (kind, span) in cases.items():
        assert [(k, text[a:b]) for k, a, b in model.spans(text)] == [(kind, span)], text
    for text in ("in 1999 and 2024-05-12 at 12:30", "pages 10-20, price 1,299.50", "12 34 56 78 9", "look at this dot there", "version 3.2.1 of 2020"):
        assert model.spans(text) == [], text


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.io"), (3, "é 😀 a@b.io, +1 (243) 555-5526 and (243) 555-5526"), (3, "é 😀 a@b.io, +1 (243) 555-5526 and (243) 555-5526"), (4, "x" * 300_000 + " 1.2.3.4"), (5, "no")]
    df = spark.createDataFrame([(*r, "k", "s", 1, 2) for r in rows], SCHEMA)
    found = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in spans.find_spans(df).collect()), key=str)
    three = [("email", 4, 10, True), ("phone", 12, 29, True), ("phone", 34, 48, False)]
    assert found == sorted([(1, []), (2, []), (None, [("email", 0, 6, True)]), (3, three), (3, three), (4, [("ip", 300_001, 300_008, True)]), (5, [])], key=str)
    assert spans.find_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, tmp_path):
    text = "b@c.de 9.9.9.9 a@b.io"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    listed = "email:0:6,email:15:21,ip:7:14"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, queries.QUERIES["op12_personal_spans"](spark, str(tmp_path)).collect()))
    assert got == [(1, 2, 1, 0, 0, digest(listed), listed), (2, 0, 0, 0, 0, digest(""), "")]
