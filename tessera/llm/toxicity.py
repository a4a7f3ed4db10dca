"""Toxicity by weak supervision.

1. Voters: a seed lexicon by language, mined words and word beginnings, and patterns of form. Each votes
   toxic (1), clean (-1) or abstains (0) on a text.
2. Label model: a generative model of the votes given the unknown class. EM estimates how often each
   voter gives each vote in each class, so its accuracy; correlations between voters left after the class is
   known are estimated too, and a voter that others repeat counts for its share. The label column of
   training rows is one more voter whose accuracy is estimated.
3. A linear classifier is trained on the posterior labels, over mined units, seeds and densities.

The model is fitted on a bounded sample of labelled rows (SAMPLE per class, by a hash of doc_id, rows
with crc32(doc_id) mod 5 = 0 never among them); everything else reads all rows. labels, lang, source
and doc_id are no inputs of a score.

Defined results: null and empty texts get the score of a text without units; rows are scored one by one,
so ties and repeats score alike; without labelled rows of both classes the seed voters alone decide;
empty tables give no rows; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, modest_batches, texts, trim

#: Labelled rows of each class that the fit may use.
SAMPLE = 2000
FOLDS = 5
# Seed lexicon, public everyday insults.
SEEDS = {
    "insult_en": "idiot idiots moron morons stupid dumb dumbass fool loser losers clown jerk imbecile retard",
    "contempt_en": "pathetic worthless disgusting scum trash garbage filth filthy vermin subhuman disgrace",
    "hostile_en": "hate kill die destroy shut ugly creep freak",
    "insult_de": "idiot dummkopf trottel depp abschaum müll wertlos erbärmlich ekelhaft dumm widerlich",
    "insult_fr": "imbécile crétin débile abruti minable ordure déchet dégoûtant stupide connard nul",
    "insult_es": "idiota imbécil estúpido basura asqueroso inútil patético escoria tonto payaso",
}
BEGIN, END = 4, 8  # lengths of mined word beginnings
MINED = 600
_word = re.compile(r"[^\W\d_]+").findall


def _words(text: str) -> list[str]:
    return _word(text.lower())


def units(word: str) -> list[str]:
    """What a word can be known by: itself, and its beginnings (marked with a trailing *)."""
    return [word, *(word[:n] + "*" for n in range(BEGIN, min(END, len(word) - 1) + 1))]


PATTERNS = ("shout", "marks", "masked", "second_person", "long_runs")


def form(text: str, n_words: int) -> list[float]:
    """Pattern features of a text's form, one for each of PATTERNS."""
    n = max(1, len(text))
    upper = sum(w.isupper() and len(w) > 2 for w in text.split())
    return [
        upper / max(1, n_words),
        text.count("!") / n * 20,
        len(re.findall(r"\w\*{2,}|[#@$%&*]{4,}", text)) / max(1, n_words) * 20,
        len(re.findall(r"(?i)\byou(?:'re| are)\b", text)) / max(1, n_words) * 20,
        float(bool(re.search(r"(.)\1{5,}", text))),
    ]


class Model:
    """Weights of units and patterns; ``score`` maps texts to probabilities."""

    def __init__(self, weights: dict[str, tuple[float, float]], pattern: list[float], bias: float):
        self.weights, self.pattern, self.bias = weights, pattern, bias
        self._seen: dict[str, tuple[str, ...]] = {}

    def _known(self, word: str) -> tuple[str, ...]:
        hit = self._seen.get(word)
        if hit is None:
            if len(self._seen) > 100_000:
                self._seen.clear()
            hit = self._seen[word] = tuple(u for u in units(word) if u in self.weights)
        return hit

    def __getstate__(self):
        return (self.weights, self.pattern, self.bias)

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, batch: list[str]) -> np.ndarray:
        out = np.empty(len(batch))
        for i, text in enumerate(batch):
            words = _words(text)
            hits: Counter = Counter()
            for w in words:
                for u in self._seen[w] if w in self._seen else self._known(w):
                    hits[u] += 1
            z = self.bias + sum(a * b for a, b in zip(self.pattern, form(text, len(words)), strict=True)) if any(self.pattern) else self.bias
            for u, n in sorted(hits.items()):
                once, often = self.weights[u]
                z += once + often * np.log(n)
            out[i] = z
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


BUCKETS = 1 << 22
BLOCK = 500  # texts of the sample that the label model's sums take at once


class Bags:
    """What the fit needs of texts: distinct words, and of each text the words it has (by number), how often, and its form."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.shapes: list[list[float]] = []

    def __len__(self) -> int:
        return len(self.shapes)

    def add(self, part: pa.RecordBatch) -> None:
        """Take the rows of ``part`` (words, counts, form), as ``_bags`` makes them."""
        if not part.num_rows:
            return
        words, counts = part.column("words"), part.column("counts")
        coded = words.flatten().dictionary_encode()
        own = np.array([self.number.setdefault(w, len(self.number)) for w in coded.dictionary.to_pylist()], np.int32)
        ends = np.cumsum([0, *words.value_lengths().to_pylist()])[1:-1]
        at = own[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else own
        self.words += np.split(at, ends)
        self.counts += np.split(counts.flatten().to_numpy().astype(np.int32), ends)
        self.shapes += part.column("form").to_pylist()

    def named(self, name_of) -> np.ndarray:
        """A row for each distinct word with ``name_of`` each of its units, -1 where it has fewer."""
        out = np.full((len(self.number), END - BEGIN + 2), -1, np.int32)
        for w, i in self.number.items():
            got = [name_of(u) for u in units(w)]
            out[i, : len(got)] = got
        return out


def _distinct(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The distinct numbers of units, -1 aside, that some words have by ``table``."""
    found = np.unique(table[words])
    return found[np.searchsorted(found, 0) :]


def mine(bags: Bags, y: np.ndarray, least: int = 4) -> tuple[list[str], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """(units over-represented in toxic texts, most telling first; in which texts each occurs, and how often).

    Of units in the same texts one stays. A first pass counts by hash in a fixed table, so only units that can
    reach ``least`` toxic texts are counted by name.
    """
    table = bags.named(lambda u: zlib.crc32(u.encode()) % BUCKETS)
    rough = np.zeros(BUCKETS, np.uint16 if len(y) < 1 << 16 else np.uint32)
    seen = np.zeros(len(table), bool)
    for words, c in zip(bags.words, y, strict=True):
        if c:
            rough[_distinct(table, words)] += 1
            seen[words] = True
    table = (table >= 0) & (rough[table] >= least) & seen[:, None]
    del rough
    seeds = [w for ws in SEEDS.values() for w in ws.split()]
    fits = {u: i for i, u in enumerate(dict.fromkeys(seeds))}
    for w, i in bags.number.items():
        if table[i].any():
            for u, ok in zip(units(w), table[i], strict=False):
                if ok:
                    fits.setdefault(u, len(fits))
    table = bags.named(lambda u: fits.get(u, -1))
    held = np.zeros((2, len(fits)), np.int64)
    for words, c in zip(bags.words, y, strict=True):
        held[int(c), _distinct(table, words)] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    lift = np.log((held[1] + 0.5) / (n1 + 1)) - np.log((held[0] + 0.5) / (n0 + 1))
    names = list(fits)
    found = sorted((-held[1, i] * lift[i], names[i]) for i in np.flatnonzero((held[1] >= least) & (lift > 1.2)))[: 6 * MINED]
    wanted = {u: i for i, u in enumerate(dict.fromkeys([*(u for _, u in found), *seeds]))}
    del fits, names
    table = bags.named(lambda u: wanted.get(u, -1))
    unit, text, often = [], [], []
    for i, (words, counts) in enumerate(zip(bags.words, bags.counts, strict=True)):
        at = table[words]
        total = np.bincount(at[at >= 0], np.repeat(counts, at.shape[1])[at.ravel() >= 0], len(wanted))
        here = np.flatnonzero(total)
        unit.append(here.astype(np.int32))
        text.append(np.full(len(here), i, np.int32))
        often.append(total[here].astype(np.int32))
    unit, text, often = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (unit, text, often))
    order = np.argsort(unit, kind="stable")
    edge = np.searchsorted(unit[order], np.arange(len(wanted) + 1))
    where = {u: (text[order[edge[i] : edge[i + 1]]], often[order[edge[i] : edge[i + 1]]]) for u, i in wanted.items() if edge[i] < edge[i + 1]}
    kept, taken = [], set()
    for _, u in found:
        key = where[u][0].tobytes()
        if key not in taken:
            taken.add(key)
            kept.append(u)
    return kept[:MINED], where


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 30, anchor: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, accuracy of each voter, share of each voter after correlations).

    votes: texts by voters, in {-1, 0, 1}. EM over the vote frequencies in each class; the ``anchor``
    voter, if any, gives the start.
    """
    n, m = votes.shape
    lean = votes[:, anchor] if anchor is not None else votes.sum(1)
    post = np.clip(np.where(lean > 0, 0.9, np.where(lean < 0, 0.1, prior)), 0.02, 0.98)
    share = np.ones(m)
    blocks = [slice(low, low + BLOCK) for low in range(0, n, BLOCK)]  # so that no table of floats is as large as the votes
    for step in range(rounds):
        by_class = np.stack([(1 - post) * weight, post * weight])
        freq = np.ones((2, m, 3))
        for b in blocks:
            for k, v in enumerate((-1, 0, 1)):
                freq[:, :, k] += by_class[:, b] @ (votes[b] == v)
        freq /= (by_class.sum(1) + 3.0)[:, None, None]
        if step in (5, 15):  # correlation left once the class is known
            cov = np.zeros((m, m))
            for b in blocks:
                mean = post[b, None] * (freq[1, :, 2] - freq[1, :, 0]) + (1 - post[b])[:, None] * (freq[0, :, 2] - freq[0, :, 0])
                rest = (votes[b] - mean) * np.sqrt(weight[b])[:, None]
                cov += rest.T @ rest
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.abs(cov / np.outer(scale, scale))
            corr[corr < 0.1] = 0
            np.fill_diagonal(corr, 1)
            share = 1 / corr.sum(1)
            if anchor is not None:
                share[anchor] = 1
        gain = np.log(freq[1]) - np.log(freq[0])
        z = np.full(n, np.log(prior / (1 - prior)))
        for b in blocks:
            for k, v in enumerate((-1, 0, 1)):
                z[b] += (votes[b] == v) @ (share * gain[:, k])
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    accuracy = freq[1, :, 2] * prior / np.maximum(1e-9, freq[1, :, 2] * prior + freq[0, :, 2] * (1 - prior))
    return post, accuracy, share


def _logistic(x: np.ndarray, p: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by accelerated gradient descent."""
    n, m = x.shape
    w, b, v, c = np.zeros(m), 0.0, np.zeros(m), 0.0
    total = weight.sum()
    u = np.ones(m) / np.sqrt(m)  # power iteration for the largest curvature
    for _ in range(30):
        u = x.T @ ((x @ u) * (weight / total))
        top = float(np.linalg.norm(u))
        u = u / max(top, 1e-12)
    rate = 4.0 / (1.1 * top + 1 + 4 * penalty)
    for k in range(rounds):
        mu = k / (k + 3)
        aw, ab = w + mu * v, b + mu * c
        err = (1 / (1 + np.exp(-np.clip(x @ aw + ab, -30, 30))) - p) * weight / total
        nw, nb = aw - rate * (x.T @ err + penalty * aw), ab - rate * err.sum()
        v, c, w, b = nw - w, nb - b, nw, nb
    return w, b


def bag_of(text: str) -> tuple[Counter, list[float]]:
    """(how often each word stands in a text, the features of its form): what the fit needs of it."""
    words = _words(text)
    return Counter(words), form(text, len(words))


def fit(bags: Bags, toxic: list[int], weight: list[float]) -> Model:
    """Fit the model on labelled texts, given by their bags; ``weight`` undoes the sampling of classes."""
    y, weight = np.array(toxic, float), np.array(weight, float)
    seeds = {w: name for name, ws in SEEDS.items() for w in ws.split()}
    if len(y) == 0 or y.min() == y.max():
        strong = {w: (2.5, 0.5) for w, name in seeds.items() if not name.startswith("hostile")}
        return Model(strong, [0.0] * len(PATTERNS), -2.0)
    shapes = np.array(bags.shapes)
    mined, where = mine(bags, y)
    names = list(dict.fromkeys([*mined, *(s for s in seeds if s in where)]))
    count = np.zeros((len(bags), len(names)), np.float32)
    for j, u in enumerate(names):
        rows, often = where[u]
        count[rows, j] = often
    del where
    at = {u: j for j, u in enumerate(names)}
    voters = [(count[:, [at[w] for w in ws.split() if w in at]].sum(1) > 0).astype(np.int8) for ws in SEEDS.values()]
    voters += list((count > 0).astype(np.int8).T)
    voters += [(shapes[:, j] > np.quantile(shapes[:, j], 0.95)).astype(np.int8) for j in range(len(PATTERNS))]
    voters.append(-(count.sum(1) == 0).astype(np.int8))  # nothing found: clean
    voters.append(np.where(y > 0, 1, -1).astype(np.int8))  # the label column
    votes = np.array(voters).T
    prior = float((y * weight).sum() / weight.sum())
    post, _, _ = label_model(votes, weight, prior, anchor=votes.shape[1] - 1)
    k = len(names)
    x = np.empty((len(bags), 2 * k + shapes.shape[1]))
    x[:, :k], x[:, k : 2 * k], x[:, 2 * k :] = count > 0, np.log(np.maximum(count, 1)), shapes
    del count, votes, voters
    w, b = _logistic(x, post, weight, 2e-4)
    return Model({u: (float(w[i]), float(w[k + i])) for i, u in enumerate(names)}, [float(v) for v in w[2 * k :]], float(b))


def _bags(batches):
    for b in batches:
        made = [bag_of(t) for t in texts(b.column("text"))]
        columns = [pa.array([list(bag) for bag, _ in made], pa.list_(pa.string())), pa.array([list(bag.values()) for bag, _ in made], pa.list_(pa.int64())), pa.array([f for _, f in made], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*b.select(["doc_id", "toxic", "weight"]).columns, *columns], ["doc_id", "toxic", "weight", "words", "counts", "form"])


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[Bags, list[int], list[float]]:
    """Bags, labels and weights of at most ``per_class`` training rows of each class; no text leaves the executors.

    Labels without a class, and documents of the held-out fold, are left out; one label per document.
    """
    spark = docs.sparkSession
    train = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = []
    for c in (0, 1):
        rows = train.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
        chosen += [(r["doc_id"], c, totals[c] / len(rows)) for r in rows]
    if not chosen:
        return Bags(), [], []
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, toxic int, weight double"))  # 2 * per_class rows at most
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    made = rows.mapInArrow(_bags, "doc_id bigint, toxic int, weight double, words array<string>, counts array<bigint>, form array<double>")
    table = made.orderBy("doc_id").toArrow()
    bags = Bags()
    for part in table.select(["words", "counts", "form"]).to_batches(max_chunksize=100):
        bags.add(part)
    return bags, table.column("toxic").to_pylist(), table.column("weight").to_pylist()


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    model = fit(*sample(docs, labels, per_class))
    trim()  # the sample's memory, on the driver
    return model


def _scored(model_ref, name):
    def run(batches):
        model = model_ref.value
        claim("toxicity", model._seen.clear)
        for b in batches:
            rows = b.num_rows
            got = np.concatenate([np.zeros(0), *(model.score(texts(b.column("text").slice(i, 1000))) for i in range(0, rows, 1000))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, name])
        trim()

    return run


def score(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """``docs`` with the score in a column ``name``, which it must not have."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {name} already")
    ref = docs.sparkSession.sparkContext.broadcast(model)  # at most MINED units and the seeds
    schema = docs.select("*", F.lit(0.0).cast("double").alias(name)).schema
    return modest_batches(docs).mapInArrow(_scored(ref, name), schema)


def report(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(own, train(own, labels, per_class))
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
