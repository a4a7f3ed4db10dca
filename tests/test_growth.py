"""Work in proportion to the input, where a plan once took far more."""

import random
import re
import time

from pyspark.sql import functions as F

from tessera.operators import boosting, retrieval, validation
from tessera.plans import catalog


def test_phrase_hits_of_a_long_text(spark):
    """Against a scan in Python; the text of 20,000 words was split again at each of its words before."""
    texts = [None, "", "GNU general public", "gnu-General,\n\npublic gnu general public", "gnus general public", "gnu general publicly", "ignu general public", "gnu general", "gnuégeneral ß public", "gnu general gnu general public", "gnu general x public", "gnu" + " " * 100_000 + "general public"]
    texts.append(("word " * 9_997 + "gnu general public ") * 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)

    def plain(phrase):
        split = [[w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for t in texts]
        found = ((d, sum(t[i : i + len(phrase)] == phrase for i in range(len(t) - len(phrase) + 1))) for d, t in enumerate(split))
        return {(d, n) for d, n in found if n}

    run = lambda phrase: {tuple(r) for r in retrieval.phrase_hits(docs, phrase).collect()}
    began = time.time()
    assert run(["gnu", "general", "public"]) == plain(["gnu", "general", "public"]) and (12, 2) in run(["gnu", "general", "public"])
    assert time.time() - began < 15
    for phrase in (["public"], ["word", "word", "word"], ["gnu-general"], ["GNU"], ["gnu", "general", "gnu"], ["general", "."]):
        assert run(phrase) == plain(phrase)


def _boosting_rows(spark):
    """Two folds over features of 8 values and one of a single value."""
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        x = [rnd.randrange(8) / 8 for _ in range(4)]
        rows.append((i % 2, i, "t", x[0] + x[1] * x[2] + rnd.gauss(0, 0.3), *x, 0.5))
    return spark.createDataFrame(rows, "fold_id int, date int, ticker string, y double, a double, b double, c double, d double, e double"), list("abcde")


def test_boosting_equals_the_library_without_sampling(spark):
    from pyspark.ml.feature import VectorAssembler

    rows, names = _boosting_rows(spark)
    est = validation.gbdt(trees=6).setSubsamplingRate(1.0).setFeatureSubsetStrategy("all").setMinInstancesPerNode(20)
    got = {(r["fold_id"], r["date"]): r["score"] for r in boosting.scores(rows, boosting.fit(rows, names, "y", est), names, est).collect()}
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumn("label", F.col("y"))).coalesce(1)
    for fold in (0, 1):
        part = data.where(F.col("fold_id") == fold)
        want = {r["date"]: r["prediction"] for r in est.fit(part).transform(part).collect()}
        assert len(want) == 750 and len(set(want.values())) > 16
        assert all(abs(got[fold, d] - p) < 1e-9 for d, p in want.items())
    assert len(got) == 1500


def test_boosting_in_several_tasks_equals_one(spark):
    rows, names = _boosting_rows(spark)
    est = validation.gbdt(trees=3).setMinInstancesPerNode(20)
    run = lambda most: sorted(tuple(r) for r in boosting.scores(rows, boosting.fit(rows.repartition(5), names, "y", est, rows=most), names, est).collect())
    one, several = run(1000), run(250)
    assert len(one) == 1500 and [r[:3] for r in one] == [r[:3] for r in several]
    assert all(abs(p[3] - q[3]) < 1e-9 for p, q in zip(one, several, strict=True))


def test_boosting_of_the_registered_query_ends(spark, monkeypatch):
    """All rows of the test blocks from 300 trees a fold; a job for each level of each tree took minutes."""
    seen, whole = {}, validation.walk_forward_predict
    monkeypatch.setattr(validation, "walk_forward_predict", lambda rows, folds, *a: seen.update(rows=rows, folds=folds) or whole(rows, folds, *a))
    began = time.time()
    rows = catalog.QUERIES["gbdt_predictions"](spark, "/root/testdata/sf0.01").collect()
    assert time.time() - began < 150
    want = {tuple(r) for r in seen["rows"].join(seen["folds"].where("role = 'test'"), "date").select("fold_id", "date", "ticker").collect()}
    assert len(rows) == len(want) > 4000 and {tuple(r)[:3] for r in rows} == want and {f for f, *_ in want} == set(range(5))
    most = seen["rows"].agg(F.max(F.abs("fwd_rel_return"))).first()[0]
    assert len({r["score"] for r in rows}) > 1000 and all(abs(r["score"]) <= most for r in rows)


def test_boosting_keeps_rows_of_a_fold_without_training_rows(spark):
    rows, names = _boosting_rows(spark)
    est = validation.gbdt(trees=2)
    got = boosting.scores(rows, boosting.fit(rows.where("fold_id = 0"), names, "y", est), names, est)
    assert {tuple(r) for r in got.groupBy("fold_id").agg(F.count("*"), F.count("score")).collect()} == {(0, 750, 750), (1, 750, 0)}
