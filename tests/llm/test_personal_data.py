"""Base spans against the contract's plain patterns, estimates against a plain EM, decisions on planted spans, defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from emberlake.llm import personal_data as pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return kind == "email" or (12 <= len(digits) <= 19 and sum(twice) % 10 == 0)


def base_spans(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m.group())]
    return [s for *_, s in sorted(found)]


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, kind string, start int, t string").write.parquet(f"{tmp_path}/documents.parquet")
    return pii.op12_personal_data(spark, str(tmp_path))


def check(got, rows):
    got = got.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r["doc_id"]], r["spans"])
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in PLAIN] == want
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k + ":") for s in want) for k in PLAIN]


def test_base_spans_equal_plain_patterns(spark, tmp_path):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", "_", "%", " ", "\n", "12", "4", "255", "256", "0", "007", "+", "(", ")", "é", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+1 (202) 555-0143", "😀", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += [None, "", "1" * 50_000, "1-" * 40_000 + "1", "a." * 40_000, "a@b" + ".c" * 40_000, "+1" + "(" * 50_000, "4111111111111111 " * 3000, "1.2.3.4.5.6.7.8", "+49 30 1234567-"]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, "y"), (None, "a@b.c", "x", 1, "y")]
    check(run(spark, tmp_path, rows), rows)


def test_given_tables(spark):
    from conftest import SMALL

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = pii.op12_personal_data(spark, SMALL)
    check(got, rows)
    assert got.where("n_email + n_ip + n_card + n_phone = 0 AND spans <> ''").count() == 0  # clean texts are left alone


def plain_em(counts):
    """share, yes, no after ``ROUNDS`` rounds, from {votes: n}."""
    yes = [[pii.FIRST_GUESS[v] for v in (-1, 0, 1)] for _ in pii.LABELERS]
    no = [[pii.FIRST_GUESS[-v] for v in (-1, 0, 1)] for _ in pii.LABELERS]
    share, n = 0.5, sum(counts.values())
    first = {True: [list(x) for x in yes], False: [list(x) for x in no]}
    guess = pii.STRENGTH + pii.SHARE * n
    for _ in range(pii.ROUNDS):
        p = {}
        for votes in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(yes[j][v + 1] / no[j][v + 1]) for j, v in enumerate(votes))
            p[votes] = 1 / (1 + math.exp(-odds))
        new = {}
        for side in (True, False):
            w = {v: c * (p[v] if side else 1 - p[v]) for v, c in counts.items()}
            new[side] = [[(first[side][j][x + 1] * guess + sum(w[v] for v in counts if v[j] == x)) / (guess + sum(w.values())) for x in (-1, 0, 1)] for j in range(len(pii.LABELERS))]
        share = (pii.STRENGTH + sum(counts[v] * p[v] for v in counts)) / (n + 2 * pii.STRENGTH)
        yes, no = new[True], new[False]
    return share, [x for j in yes for x in j], [x for j in no for x in j]


def test_estimates_equal_plain_em(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice([-1, 0, 1, 1 if k == "a" else 0]) for _ in pii.LABELERS]) for k in "ab" for _ in range(300)]
    got = pii.reliabilities(spark.createDataFrame(rows, "kind string, votes array<tinyint>")).collect()
    for r in got:
        share, yes, no = plain_em(Counter(tuple(v) for k, v in rows if k == r["kind"]))
        assert abs(r["state"]["share"] - share) < 1e-9
        assert max(abs(a - b) for a, b in zip([*r["state"]["yes"], *r["state"]["no"]], [*yes, *no])) < 1e-9


def test_method_adds_planted_spans(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    fill = lambda: " ".join(word() for _ in range(12))
    rows, planted, decoys = [], {}, {}
    for i in range(300):
        n = f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        good = [f"please call ({n[:3]}) {n[4:]}", f"her ssn is {rng.randrange(101, 660)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", f"dear Mr. {rng.choice(pii.GIVEN_NAMES)} {word().title()}", f"he lives at {rng.randrange(1, 99)} {word().title()} Street"][i % 4]
        bad = [f"order number 111-{n[4:]}", "ticket 000-00-0000", f"in New {word().title()}", f"version 10.{i}"][i % 4]
        rows += [(2 * i, f"{fill()} {good} {fill()}", "", 0, ""), (2 * i + 1, f"{fill()} {bad} {fill()}", "", 0, "")]
        planted[2 * i], decoys[2 * i + 1] = i % 4, i % 4
    spans = {r["doc_id"]: r["spans"] for r in run(spark, tmp_path, rows).collect()}
    kinds = ("local_phone", "national_id", "person", "street")
    assert sum(kinds[k] in spans[i] for i, k in planted.items()) >= 0.95 * len(planted)
    assert sum(spans[i] != "" for i in decoys) <= 0.02 * len(decoys)


def test_checks(spark):
    rows = [("4111111111111111", True), ("4111111111111112", False), ("378282246310005", True), ("12345678901", None)]
    df = spark.createDataFrame(rows, "d string, ok boolean")
    assert df.where(~pii.luhn(F.col("d")).eqNullSafe(F.col("ok"))).count() == 0
    accounts = spark.createDataFrame([("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("DE88370400440532013000", False)], "d string, ok boolean")
    assert accounts.where(pii.mod_97(F.col("d")) != F.col("ok")).count() == 0


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []).count() == 0
    assert [(r["doc_id"], r["spans"]) for r in run(spark, tmp_path / "one", [(None, None, "x", 1, "y")]).collect()] == [(None, "")]
