"""The models against plain versions: votes, field, licence chains; rows, ties, repeats and clashing columns in their reports."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import html_crf, licenses, toxicity

from .conftest import EDGES

# ---- toxicity


def plain_label_model(votes, weight, prior, anchor, rounds=30):
    """EM over vote frequencies, with loops."""
    n, m = len(votes), len(votes[0])
    post = [min(0.98, max(0.02, 0.9 if v[anchor] > 0 else 0.1 if v[anchor] < 0 else prior)) for v in votes]
    share = [1.0] * m
    for step in range(rounds):
        freq = {}
        for c in (0, 1):
            w = [(p if c else 1 - p) * x for p, x in zip(post, weight)]
            for j, v in product(range(m), (-1, 0, 1)):
                freq[c, j, v] = (sum(a for a, row in zip(w, votes) if row[j] == v) + 1) / (sum(w) + 3)
        if step in (5, 15):
            rest = [[(row[j] - sum((p if c else 1 - p) * (freq[c, j, 1] - freq[c, j, -1]) for c in (0, 1))) * math.sqrt(x) for j in range(m)] for row, p, x in zip(votes, post, weight)]
            cov = [[sum(r[i] * r[j] for r in rest) for j in range(m)] for i in range(m)]
            for i in range(m):
                near = (abs(cov[i][j]) / math.sqrt(max(cov[i][i], 1e-9) * max(cov[j][j], 1e-9)) for j in range(m) if j != i)
                share[i] = 1 / (1 + sum(x for x in near if x >= 0.1))
            share[anchor] = 1.0
        z = [math.log(prior / (1 - prior)) + sum(share[j] * math.log(freq[1, j, row[j]] / freq[0, j, row[j]]) for j in range(m)) for row in votes]
        post = [1 / (1 + math.exp(-min(30, max(-30, x)))) for x in z]
    return post, share


def test_label_model_against_loops():
    r = np.random.default_rng(3)
    y = r.random(60) < 0.4
    votes = np.array([np.where(y, 1, -1) * r.choice([1, 1, 1, 0, -1], 60) for _ in range(4)]).T
    votes = np.hstack([votes, votes[:, :1]])
    weight = r.choice([1.0, 2.5], 60)
    post, _, share = toxicity.label_model(votes, weight, 0.4, anchor=3)
    want, plain_share = plain_label_model(votes.tolist(), weight.tolist(), 0.4, 3)
    assert np.allclose(post, want, atol=1e-9) and np.allclose(share, plain_share, atol=1e-9)


def test_a_torn_label_is_in_doubt():
    """The classifier learns posteriors: a label that all other voters speak against counts for little."""
    votes = np.array([[1, 1, 1, 1]] * 30 + [[-1, -1, -1, -1]] * 30 + [[-1, -1, -1, 1]])
    assert toxicity.label_model(votes, np.ones(61), 0.5, anchor=3)[0][-1] < 0.6


def test_scores_from_weights():
    model = toxicity.Model({"idiot": (2.0, 0.5), "stup*": (1.0, 0.25)}, [0.0] * 5, -1.0)
    z = -1 + 2.0 + 0.5 * math.log(2) + 1.0 + 0.25 * math.log(1)
    assert model.score(["Idiot, idiot: stupid!", ""]) == pytest.approx([1 / (1 + math.exp(-z)), 1 / (1 + math.exp(1))])


def test_toxicity_rows(edges, nothing, spark):
    """Edge rows, repeats and clashing columns; the score column must be free."""
    labels = spark.createDataFrame([(6, 0, 1, "x"), (10, 0, 0, "y"), (11, 1, None, "z"), (None, 0, 1, "z"), (6, 0, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    got = toxicity.report(edges, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in EDGES) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
    assert len(by[6]) == 1 and by[1] == by[2] == by[17]
    model = toxicity.train(edges, labels)
    assert toxicity.score(edges, model, "new").select(edges.columns).dtypes == edges.dtypes
    with pytest.raises(ValueError):
        toxicity.score(edges, model)
    assert toxicity.report(nothing, labels).count() == 0


# ---- pages


def small_field(seed):
    r = random.Random(seed)
    names = sorted({f for page in (html_crf.blocks(p) for p in PAGES) for fs in html_crf.features(page) for f in fs})
    return html_crf.Field({f: (r.gauss(0, 1), r.gauss(0, 1)) for f in names}, [[r.gauss(0, 1) for _ in "ab"] for _ in "ab"], [r.gauss(0, 1), r.gauss(0, 1)])


PAGES = [
    "<nav><a href=x>Home</a></nav><article><h1>A title</h1><p>First text.<p>Second text.</article><footer>&copy; x</footer>",
    "<div class='a b'><p>One</p><ul><li>Two<li>Three</ul></div><aside>Four</aside><p>Five</p>", "<p>only", "<p>x<p>y<p>z<p>x<p>y<p>z<p>x",
]


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_against_all_labellings(seed):
    field = small_field(seed)
    for page in PAGES:
        blocks = html_crf.blocks(page)
        names = html_crf.features(blocks)

        def total(labels):
            score = field.start[labels[0]] + sum(field.weights[f][y] for fs, y in zip(names, labels) for f in fs)
            return score + sum(field.moves[a][b] for a, b in zip(labels, labels[1:]))

        assert tuple(field.decode(blocks)) == max(product((0, 1), repeat=len(blocks)), key=total)


def test_training_climbs_to_a_flat_point():
    """At the fitted weights the penalised likelihood, summed over all labellings, has no slope left to speak of."""
    pages = [("<p>Aa one.</p><div class=nav>bb</div><p>Cc two.</p>", ["Aa one.", "Cc two."]), ("<div class=nav>xx</div><p>Dd.</p>", ["Dd."]), ("<p>Ee.</p><div class=nav>yy</div>", ["Ee."])]
    penalty = 0.5
    field = html_crf.train(pages, rounds=3000, penalty=penalty)
    labels = [[1, 0, 1], [0, 1], [1, 0]]

    def score(f, names, ys):
        return f.start[ys[0]] + sum(f.weights[n][y] for fs, y in zip(names, ys) for n in fs) + sum(f.moves[a][b] for a, b in zip(ys, ys[1:]))

    def value(f):
        out = -penalty / 2 * (sum(a * a + b * b for a, b in f.weights.values()) + sum(x * x for r in f.moves for x in r) + sum(x * x for x in f.start))
        for (page, _), ys in zip(pages, labels):
            names = html_crf.features(html_crf.blocks(page))
            out += score(f, names, ys) - np.logaddexp.reduce([score(f, names, z) for z in product((0, 1), repeat=len(ys))])
        return out

    def moved(name, y, d):
        w = dict(field.weights)
        w[name] = tuple(x + d * (k == y) for k, x in enumerate(w[name]))
        return html_crf.Field(w, field.moves, field.start)

    for name in sorted(field.weights):
        assert abs(value(moved(name, 1, 1e-4)) - value(moved(name, 1, -1e-4))) / 2e-4 < 0.02, name


@pytest.mark.parametrize("tag,want", [
    ("<p title=Bob's>First part. <b>It</b> isn't</p>", ["First part. It isn't"]), ("<p title='a > b'>x</p>", ["x"]), ('<p data-x="1 > 2" class=c>x</p>', ["x"]),
    ("<p title=\"it's\">x</p><p title='say \"y\"'>z</p>", ["x", "z"]), ("<a href=/o'neil>name</a> rest", ["name rest"]), ("<p title='open>x</p><p>y</p>", ["x", "y"]),
    ("<p a=b'c'd>x</p><p e = 'f'>y</p>", ["x", "y"]), ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]), ("<p =x>y</p>", ["y"]),
])
def test_attribute_values_of_all_forms(tag, want):
    assert [b.text for b in html_crf.blocks(tag)] == want


def test_page_rows(spark):
    """Nulls, repeats and clashing columns."""
    html = "<article><p>The same text stands here twice, once a row.</p></article>"
    rows = [(1, "u", html, "x"), (1, "u", html, "y"), (None, None, html, None), (2, None, None, "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_crf.report(df).collect()
    assert Counter(r["page_id"] for r in got) == Counter([1, 1, None, 2])
    assert len({r["text"] for r in got if r["page_id"] != 2}) == 1 and all(r["n_chars"] == len(r["text"]) for r in got)


# ---- licences


def plain_scan(text):
    """(labels, score) from naive matching statistics and all chains."""
    words = licenses.words_of(text.encode())
    seqs = [(label, t.encode().split()) for label, t in licenses.TEMPLATES]
    base = {label for p, label in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()}
    factors = {}
    for k, (_, s) in enumerate(seqs):
        for a in range(len(s)):
            for b in range(a + licenses.MATCH, len(s) + 1):
                factors.setdefault(tuple(s[a:b]), []).append((k, a, b))
    found = []
    for i in range(len(words)):
        j = i + licenses.MATCH - 1
        while j < len(words) and tuple(words[i : j + 1]) in factors:  # beginnings of factors are factors
            j += 1
        if j - i >= licenses.MATCH and (i == 0 or tuple(words[i - 1 : j]) not in factors):
            found += [(k, i, j, a, b) for k, a, b in factors[tuple(words[i:j])]]
    share, best = {}, {}
    for k, s, e, a, b in sorted(found):
        best[k, s, e, a, b] = e - s + max((n for (k2, _, e2, _, b2), n in best.items() if k2 == k and 0 <= s - e2 <= licenses.GAP and 0 <= a - b2 <= licenses.GAP), default=0)
        share[seqs[k][0]] = max(share.get(seqs[k][0], 0.0), min(1.0, best[k, s, e, a, b] / len(seqs[k][1])))
    return base | {x for x, v in share.items() if v >= licenses.COVERED}, 1.0 if base else max(share.values(), default=0.0)


def test_licences_against_plain_chains(make):
    r = random.Random(4)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            words = r.choice(licenses.TEMPLATES)[1].split()
            for _ in range(r.randint(0, 3)):  # drop, change and repeat words
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 3)] = r.choice([[], ["other"], words[at : at + 5] * 2])
            parts += words + ["filler"] * r.randint(0, 12)
        texts.append(" ".join(parts))
    rows = [*EDGES, *((100 + i, t) for i, t in enumerate(texts)), (300, "of the software and to permit " * 3000), (301, licenses.TEMPLATES[2][1] + " é " * 20000)]
    got = Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in licenses.report(make(rows)).collect())
    want = Counter()
    for i, t in rows:
        if i == 300:
            labels, score = set(), licenses.Scanner().scan(t.encode())[-1]
            assert score < licenses.COVERED
        else:
            labels, score = plain_scan(t or "")
        want[(i, ",".join(sorted(labels)), round(score, 9))] += 1
    assert got == want


def test_mine_against_plain_counts():
    toxic_texts = ["you stupid idiot", "stupidly idiotic trash trash", "stupid trash", "stupidity", "", "trash idiot stupid"]
    clean_texts = ["a calm day", "the bright garden", "", "stupendous calm day", "a day"]
    bags, all_texts = toxicity.Bags(), toxic_texts + clean_texts
    made = [toxicity.bag_of(t) for t in all_texts]
    for low in (0, 4, 11):  # two parts, and one without rows
        some = made[low : {0: 4, 4: 11, 11: 11}[low]]
        columns = [pa.array([list(b) for b, _ in some], pa.list_(pa.string())), pa.array([list(b.values()) for b, _ in some], pa.list_(pa.int64())), pa.array([f for _, f in some], pa.list_(pa.float64()))]
        bags.add(pa.RecordBatch.from_arrays(columns, ["words", "counts", "form"]))
    y = np.array([1.0] * len(toxic_texts) + [0.0] * len(clean_texts))
    kept, where = toxicity.mine(bags, y, least=2)
    plain = {}
    for i, (bag, _) in enumerate(made):
        for w, n in bag.items():
            for u in toxicity.units(w):
                plain.setdefault(u, {}).setdefault(i, 0)
                plain[u][i] += n
    scores = []
    for u, at in plain.items():
        t, c = sum(y[i] == 1 for i in at), sum(y[i] == 0 for i in at)
        lift = np.log((t + 0.5) / 7) - np.log((c + 0.5) / 6)
        if t >= 2 and lift > 1.2:
            scores.append((-t * lift, u))
    want, seen = [], set()
    for _, u in sorted(scores):
        if tuple(plain[u]) not in seen:
            seen.add(tuple(plain[u]))
            want.append(u)
    assert kept == want and "tras*" in kept and "trash" not in kept
    assert all(dict(zip(*(x.tolist() for x in where[u]), strict=True)) == plain[u] for u in where)


def test_fit_without_labelled_documents(spark):
    docs = spark.createDataFrame([(1, "you idiot")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 140)], "doc_id bigint, toxic int")
    assert [r["predicted"] for r in toxicity.report(docs, labels).collect()] == [1]
