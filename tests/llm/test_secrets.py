"""All spans and the masked text of the secret scan against a plain Python version, on edge cases, long texts and the sample table."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest

from tessera.llm import secrets

from .conftest import EDGES
from .test_operators import SECRETS, base

R = random.Random(5)
TOKEN = string.ascii_letters + string.digits + "+/"


def run(n, letters=TOKEN):
    return "".join(R.choice(letters) for _ in range(n))


def entropies(value, alphabet):
    """Entropy of each window by counting anew."""
    w = secrets.WINDOW
    for i in range(len(value) - w + 1):
        yield sum(-c / w * math.log2(c / w) for c in Counter(value[i : i + w]).values())


def extra(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        v = m[0]
        if any(re.search(rule, v) for rule in secrets.ALLOW):
            continue
        alphabet, bar = next((a, b) for _, a, b in secrets.CLASSES if set(v) <= set(a))
        if bar is not None and max(entropies(v, alphabet)) >= bar - 1e-9:
            found.append((m.start(), 3, m.end()))
    return found


def kinds(text):
    return [(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in base(text).split(",") if s)]


def every(text):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(kinds(text) + extra(text)))


def masked(text, mask="[secret]"):
    if text is None:
        return None
    out, at = [], 0
    end = -1
    for a, _, b in sorted(kinds(text) + extra(text), key=lambda s: (s[0], s[2])):
        if a > end:
            out += [text[max(0, end) : a], mask]
        end = max(end, b)
    return "".join(out) + text[max(0, end) :] if out else text


LONG = [
    (20, run(100_000)), (21, "x " + run(9000, "0123456789abcdef") + " y"), (22, " ".join(f"token=abc{i:06d}é" for i in range(9000))),
    (23, "a-" * 50_000), (24, "password" + " " * 50_000), (25, run(4096 + 19)), (26, run(4097, "ab") + run(40)), (27, "ab" * 3000 + run(40) + "ab" * 3000),
    (28, "secret=" + "+".join("0123456789abcdef01234567" for _ in range(300)) + " tail"), (29, run(30) + "\n" + "AKIA" + "Z9" * 20 + " \U0001f600 token:" + run(50)),
]


@pytest.mark.parametrize("rows", [EDGES, SECRETS, LONG], ids=["edges", "kinds", "long"])
def test_all_spans(make, rows):
    got = Counter((r["doc_id"], r["base_sha256"], r["spans"]) for r in secrets.report(make(rows)).collect())
    assert got == Counter((i, hashlib.sha256(base(t).encode()).hexdigest(), every(t)) for i, t in rows)


@pytest.mark.parametrize("rows", [EDGES, SECRETS, LONG], ids=["edges", "kinds", "long"])
def test_masked_text_and_clashing_columns(make, rows):
    docs = make(rows)
    out = secrets.redact(docs)
    assert out.dtypes == docs.dtypes
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert Counter(map(tuple, out.select(kept).collect())) == Counter(map(tuple, docs.select(kept).collect()))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((i, masked(t)) for i, t in rows)


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = secrets.report(docs)
    assert {r["doc_id"]: r["spans"] for r in found.collect()} == {i: every(t) for i, t in rows}
    assert sum(bool(every(t)) for _, t in rows) > 5
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_nothing_and_clash(nothing, make):
    assert secrets.report(nothing).count() == 0 and secrets.redact(nothing).count() == 0
    with pytest.raises(ValueError):
        secrets.scan(make([(1, "x")]).withColumnRenamed("h", "_spans"))
