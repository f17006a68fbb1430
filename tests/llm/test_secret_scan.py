"""Operator 11: base rules against plain regular expressions, the network against loops, recall on secrets it was not trained on."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from memlake.llm import secret_scan as ss

SCHEMA = "doc_id long, text string"


def brute_base(text: str) -> list[str]:
    out = []
    value = "[A-Za-z0-9+/_.=-]+"
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?(" + value + ")", text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [s for _, _, s in sorted(out)]


def noise(rng, n):
    parts = []
    for _ in range(n):
        parts.append(rng.choice(["".join(rng.choice("abcdefghijklmnopéß") for _ in range(rng.randrange(2, 12))), f"mail{rng.randrange(10)}.example.com", f"{rng.randrange(255)}.{rng.randrange(255)}.205.106", f"20{rng.randrange(10, 25)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", "notableWords", "extraordinarily-long-compound.words"]))
    return " ".join(parts)


def secret(rng):
    digits = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    return rng.choice([f'token = "{digits("0123456789abcdef", 40)}"', f"Password={digits('0123456789abcdef', 18)}", f"AKIA{digits('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 16)}", digits("0123456789abcdef", 24), f"api_key: '{digits('ABCdefGHIjkl0123456789', 20)}'"])


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    return [(i, noise(rng, 15) + (" " + secret(rng) if i % 3 else "") + " " + noise(rng, 5)) for i in range(n)]


ODD = [
    (1, None), (1, ""), (None, "token=short"), (2, "token=password: abcdefghijklmnop"), (3, "SECRET '=  \"" + "x" * 12), (4, "é" * 30 + "passwd:" + "a1" * 40_000), (5, "AKIAAKIA" * 2 + " AKIA" + "A" * 13 + " xAKIA" + "9" * 14),
    (6, "token = = tokentoken:aaaaaaaaaaaa api_key==abcdefghijkl"), (7, "0" * 15 + " " + "f" * 16 + "g" + "1" * 200_000), (7, "tokEn=abcdefghijk\u017f secret=" + "k" * 12), (8, "to\u212aen=abcdefghijklmn \U0001f511 token=abcdefghijklmn"),
]


def test_base_rules_equal_plain_expressions(spark):
    rows = corpus(n=60) + ODD
    got = ss.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    expected = sorted(((i, tuple(brute_base(t or ""))) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, tuple(s for s in r.spans.split(",") if s and not s.startswith("model:"))) for r in got), key=repr) == expected
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("model:")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign:", "access:", "hex:"))
        order = [(int(s.split(":")[1]), ss.KINDS.index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert order == sorted(order) and r.n_model == sum(k == 3 for _, k in order)


def test_candidates_cover_every_notable_run():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice("abZ19./ é=") for _ in range(300)) + " " + secret(rng)
        base = ss.base_spans(text)
        for c in ss.candidates(text, base):
            value = text[c["start"] : c["end"]]
            assert c["region"][c["lead"] : c["lead"] + len(value)] == value and text[c["start"] - c["lead"] :].startswith(c["region"])
            assert c["secret"] == any(s < c["end"] and e > c["start"] for s, _, e in base)


def naive(net, region):
    padded = [ss._EDGE, ss._EDGE, *region.tolist(), ss._EDGE, ss._EDGE]
    active = [[max(0.0, net.bias[f] + sum(float(net.embed[padded[i + k]] @ net.filters[k][:, f]) for k in range(5))) for f in range(24)] for i in range(len(region))]
    columns = list(zip(*active, strict=True))
    return np.array([max(c) for c in columns] + [sum(c) / len(c) for c in columns])


def test_network_equals_loops_and_its_gradients(monkeypatch):
    rng = np.random.default_rng(3)
    net, regions = ss.Network.new(), [rng.integers(0, 258, n) for n in (1, 2, 7, 40)]
    expected = np.stack([naive(net, r) for r in regions])
    np.testing.assert_allclose(net.pooled(regions), expected)
    monkeypatch.setattr(ss, "_PIECE", 3)  # regions of several pieces
    np.testing.assert_allclose(net.pooled(regions), expected)
    labels, weights = np.array([1.0, 0, 1, 0]), np.full(4, 0.25)

    def loss():
        z = net.pooled(regions) @ net.out + net.shift
        return float((weights * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - labels * z)).sum())

    for value, gradient in zip([net.embed, net.filters, net.bias, net.out, net.shift], net.gradients(regions, labels, weights), strict=True):
        for i in rng.choice(value.size, min(value.size, 12), replace=False):
            was = value.flat[i]
            value.flat[i] = was + 1e-6
            up = loss()
            value.flat[i] = was - 1e-6
            assert (up - loss()) / 2e-6 == pytest.approx(gradient.flat[i], abs=1e-5)
            value.flat[i] = was


def test_held_out_secrets_and_others(spark):
    net = ss.fitted(ss.scan(spark.createDataFrame(corpus(n=400), SCHEMA)), ss.SAMPLE, 0.98)
    found = [c | {"value": t[c["start"] : c["end"]]} for _, t in corpus(seed=77, n=200) for c in ss.candidates(t, ss.base_spans(t))]
    chance = net.chances([ss.symbols(c["region"], c["lead"], c["end"] - c["start"]) for c in found])
    hit = np.array([p >= net.thresholds[ss.shape_of(c["value"])] for p, c in zip(chance, found, strict=True)])
    truth = np.array([c["secret"] for c in found])
    assert hit[truth].mean() >= 0.95 and hit[~truth].mean() <= 0.05
    assert all(0 < t <= 0.5 for t in net.thresholds)


def test_adds_what_the_rules_miss_and_is_repeatable(spark):
    rows = [*corpus(n=300), (1000, "see Passwort 0f3a9c77d1e2b45 and mail3.example.com"), (1001, "plain words, nothing more 2011-03-12")]
    got = {r.doc_id: r for r in ss.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1000].n_model >= 1 and not got[1001].n_model
    assert got == {r.doc_id: r for r in ss.find(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}


def test_empty_clashing_columns_and_no_labels(spark):
    extra = SCHEMA + ", base string, spans string, region int"
    assert ss.find(spark.createDataFrame([], extra)).count() == 0
    assert [(r.spans, r.n_model) for r in ss.find(spark.createDataFrame([(1, "only token=abcdefghijkl", "x", "y", 2)], extra)).collect()] == [("assign:5:23", 0)]
