"""Operators 11 to 13 against plain Python: permutations one by one, all pairs, one eigendecomposition."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from comparing import by_duckdb, by_spark
from conftest import SMALL
from samples import HARD, frame

from meterlark.llm import entries, filter_audit, vector_dedup
from meterlark.llm.filter_audit import audit_filters
from meterlark.llm.vector_dedup import near_vectors
from meterlark.llm.whitening import whiten

VECTORS = "vec_id long, embedding array<float>, label int, n long, list int, node int"


def failed(rows):
    """(part, set of failed filters, id) of (id, text, source), as the contract words them."""
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", math.inf), math.inf if i is None else i)
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": (math.inf if i is None else i) > first[t]}
        yield source or "", {k for k, v in tests.items() if v}, i


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = {}
    for part, f, i in failed(rows):
        parts.setdefault(part, []).append((f, i))
    out = []
    for part, docs in parts.items():
        share, told = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[0]]
                left = [d for d in left if k not in d[0]]
                share[k] += len(gone)
                told.append((k, ("".join(order), step, len(left), len(gone), sum(k in f for f, _ in docs) - len(gone), sum(f == {k} for f, _ in docs), sum(i in good for _, i in gone if i is not None), sum(i in toxic for _, i in gone if i is not None))))
        out += [(part, *row, share[k]) for k, row in told]
    return sorted(out)


def test_audit_equals_sql(spark):
    assert by_spark(entries.op11_filter_audit(spark, SMALL)) == by_duckdb(entries.SQL["op11_filter_audit"], SMALL)


def test_audit_of_hard_rows_equals_each_order_by_hand(spark):
    sources = ["s", None, "", "web"]
    rows = [(i, t, sources[at % 4]) for at, (i, t) in enumerate([*HARD, (7, HARD[6][1]), (None, "twice"), (None, "twice"), (99, "twice"), (100, "Long " * 300_000), (None, None)])]
    labels = [(7, 1, 0), (7, 0, 1), (8, None, 1), (9, 1, None), (None, 1, 1), (100, 1, 1), (12345, 1, 1), (22, 1, 0), (22, 1, 0)]
    docs = spark.createDataFrame([(i, t, s, 1, 1, 1) for i, t, s in rows], "doc_id long, text string, source string, n long, fails int, quality int")
    told = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, part int")
    assert sorted(map(tuple, audit_filters(docs, told).collect())) == plain_audit(rows, labels)
    none = spark.createDataFrame([], told.schema)
    assert audit_filters(docs.limit(0), told).count() == 0
    assert audit_filters(frame(spark, extra=True), none).count() == 600


def test_shares_add_up():
    """Shapley's shares add up to what all filters remove, and a filter that nobody fails has none."""
    p = filter_audit.polynomial({0: 5, 1: 3, 3: 4, 7: 2, 31: 1})
    assert sum(filter_audit.shapley(p, k) for k in "ABCDE") == filter_audit.at_corner(p, filter_audit.FULL) == 10
    assert filter_audit.shapley(filter_audit.polynomial({1: 9}), "B") == 0


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def plain_links(rows, cosine):
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if label is not None and usable(v) and any(v or []) else None for _, v, label in rows]
    links = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(rows))]
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((row[0], len(links[i]), least, least == row[0]))
    return sorted(out, key=repr)


def planted(seed=0):
    """Copies, near copies, chains of steps near the threshold and strangers, in two labels; then rows that link with nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for family in range(12):
        centre = rng.normal(size=16)
        for k in range(25):
            rows.append((centre + rng.normal(size=16) * (0, 0.05, 0.15, 0.3)[family % 4]) * (1 + k % 3))
    step = rng.normal(size=16)
    for k in range(40):  # neighbours of a chain are linked, its ends are not
        rows.append(step + 0.15 * k * np.eye(16)[1])
    rows += list(rng.normal(size=(200, 16)))
    out = [(1000 - 2 * i, [float(np.float32(c)) for c in v], i % 3 // 2) for i, v in enumerate(rows)]
    odd = [(1, None, 0), (3, [], 0), (5, [0.0] * 16, 0), (7, [math.nan] + [1.0] * 15, 0), (9, [None] + [1.0] * 15, 0), (11, [math.inf] + [1.0] * 15, 0), (13, out[0][1], None), (15, [1.0, 2.0], 0), (17, [2.0, 4.0], 0), (19, [1.0, 2.0], 1)]
    return out + odd + [out[3], out[3], (None, [3.0, -1.0], 0), (None, [3.0, -1.0], 0), (None, out[30][1], out[30][2])]


@pytest.mark.parametrize("block", [16, 1024])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = planted()
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)
    found = sorted(map(tuple, near_vectors(table, 0.98).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert found == plain_links(rows, 0.98)
    assert sum(n for _, n, _, _ in found) > 1000


def test_near_vectors_of_little(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 0, 1, 1, 1)], VECTORS)
    assert near_vectors(table.limit(0)).count() == 0
    assert [tuple(r) for r in near_vectors(table).collect()] == [(1, 0, 1, True)]
    assert [tuple(r) for r in near_vectors(table.selectExpr("vec_id", "cast(null as array<float>) as embedding", "label")).collect()] == [(1, 0, 1, True)]


def test_near_vectors_query_equals_sql(spark):
    assert by_spark(entries.op12_embedding_dedup(spark, SMALL)) == by_duckdb(entries.SQL["op12_embedding_dedup"], SMALL)


def plain_whitening(rows, components=8):
    rows = [(i, v) for i, v in rows if usable(v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(rows), x.sum(axis=0)
    d = n * x - s
    centred = d.astype(np.float64) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return [(i, n, int((row**2).sum()), c @ axes[:, :components] / np.sqrt(values[:components]), values[:components] / values.sum()) for (i, _), row, c in zip(rows, d, centred, strict=True)]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.5, 12)) + 5
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    rows += [rows[4], (None, rows[9][1]), (500, None), (501, [math.nan] * 12), (502, [None] * 12), (503, [math.inf] * 12)]
    table = spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], VECTORS)
    found = whiten(table).collect()
    want = plain_whitening(rows)
    assert len(found) == 8 * len(want)
    first = {r["component"]: r["whitened"] for r in found if r["vec_id"] == 0}
    sign = {c + 1: np.sign(want[0][3][c] * first[c + 1]) for c in range(8)}
    for r in found:
        i = r["vec_id"] if r["vec_id"] is not None else 9
        _, n, deviation, w, explained = want[i]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        c = r["component"] - 1
        assert r["whitened"] == pytest.approx(sign[c + 1] * w[c], abs=1e-8) and r["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    def table(*vectors):
        return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in enumerate(vectors)], VECTORS)

    assert whiten(table([1.0]).limit(0)).count() == 0
    assert whiten(table(None, [], [math.nan])).count() == 0
    alone = whiten(table([1.0, 2.0])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["identity_error"]) for r in alone] == [(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    # of two lengths the commoner one, a direction without variance whitened to 0
    found = whiten(table([0.0, 1.0], [1.0, 1.0], [1.0])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in found) == [(0, 1, 1.0), (0, 2, 0.0), (1, 1, 1.0), (1, 2, 0.0)]
    # the exact deviation goes past 64 bits
    big = whiten(table([4e9] * 2, [-4e9] * 2)).collect()
    assert int(big[0]["deviation"]) == 2 * (2**2 * 1024 * 4_000_000_000) ** 2 // 4
