"""Invariants of single operators on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking as C
from tessera.functions import text as T
from tessera.operators import corpus, dedup, evidence, outcomes, panel, retrieval, training, validation


@pytest.fixture(scope="module")
def walk(spark):
    """A seeded random-walk panel with a gap, a null close and a late listing."""
    rnd, rows = random.Random(42), []
    for k in range(12):
        price = 100.0
        for d in range(320):
            price *= 1 + rnd.gauss(0.0004, 0.02)
            if (k, d) == (0, 50) or (k == 1 and d < 30):
                continue
            close = None if (k, d) == (2, 60) else round(price, 4)
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=d), f"T{k:02}", k % 3, close, close, close, close, close, 1e6))
    bars = spark.createDataFrame(rows, "date date, ticker string, segment int, open double, high double, low double, close double, adj_close double, volume double")
    return panel.dense_grid(bars, ("segment",)).cache()


def test_grid_is_dense_and_lags_are_positional(walk):
    assert walk.count() == 12 * 320
    p = walk.withColumn("r", panel.change(1)).where("ticker = 'T00'").orderBy("date").collect()
    assert p[50]["close"] is None and p[50]["r"] is None and p[51]["r"] is None and p[52]["r"] is not None


def test_every_feature_computes(walk):
    out = panel.compute(walk, panel.V1 + panel.ORTHOGONAL)
    assert set(panel.V1 + panel.ORTHOGONAL) <= set(out.columns) and not [c for c in out.columns if c.startswith("_")]
    last = out.where("date = date'2020-11-15' and ticker = 'T05'").first()
    assert all(last[c] is not None for c in panel.V1 + panel.ORTHOGONAL if c != "close_location_20d")  # no range here


def test_registry_errors():
    with pytest.raises(ValueError):
        panel.register("momentum_20d")(lambda: None)
    with pytest.raises(KeyError):
        panel.get("nope")
    with pytest.raises(ValueError):
        panel.forward_return(0)


def test_labels_are_leave_one_out_and_thin_dates_null(walk, spark):
    p = panel.relative_labels(walk, 5, 10).where("date = date'2020-06-01'").collect()
    fwd = {r["ticker"]: r["fwd"] for r in p}
    for r in p:
        others = [v for t, v in fwd.items() if t != r["ticker"]]
        assert abs(r["fwd_rel_return"] - (r["fwd"] - sum(others) / len(others))) < 1e-12
    assert panel.relative_labels(walk, 5, 13).where("fwd_rel_return is not null").count() == 0


def test_rank_and_zscore_ties(spark):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(d, "a", 1.0), (d, "b", 1.0), (d, "c", 3.0), (d, "e", None)], "date date, ticker string, v double")
    got = {r["ticker"]: (r["r"], r["z"]) for r in df.select("ticker", panel.pct_rank("v").alias("r"), panel.zscore("v").alias("z")).collect()}
    assert got["a"][0] == got["b"][0] == 0.5 and got["c"][0] == 1.0 and got["e"] == (None, None)
    same = df.withColumn("v", F.lit(2.0)).select(panel.zscore("v").alias("z")).collect()
    assert all(r["z"] is None for r in same)


def test_quantile_buckets_match_cut(spark):
    import pandas as pd

    for n in (10, 11, 12, 13, 14):
        rows = [(dt.date(2020, 1, 1), f"{i:02}", float(i)) for i in range(n)]
        df = spark.createDataFrame(rows, "date date, ticker string, s double").withColumn("b", validation.quantile_bucket("s", "ticker"))
        assert [r["b"] for r in df.orderBy("s").collect()] == pd.qcut(range(n), 5, labels=False).tolist()


def test_folds_are_purged(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i),) for i in range(300)], "date date")
    f = validation.walk_forward(days, 5, 5, 5, 100)
    assert validation.leaks(f, 5).count() == 0 and f.where("role = 'test'").select("date").distinct().count() == 200
    with pytest.raises(ValueError):
        validation.walk_forward(days, 5, 5, 4, 100)
    with pytest.raises(ValueError):
        validation.walk_forward(days, 5, 5, 5, 295)


def test_ic_ignores_date_level_scaling(walk):
    p = panel.relative_labels(walk, 5, 5).withColumn("s", panel.change(20))
    a = {r["date"]: r["ic"] for r in validation.rank_ic(p, "s", "fwd_rel_return").collect()}
    b = {r["date"]: r["ic"] for r in validation.rank_ic(p.withColumn("s", F.col("s") * 7 + F.dayofyear("date")), "s", "fwd_rel_return").collect()}
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-9 for d in a)


# ---- text


@pytest.mark.parametrize("text", ["\n".join(f"Paragraph {i} says one thing. And another." * 3 for i in range(40)), "x" * 5000, "\n" * 500, "short", "a" * 300, "\U0001f600é " * 900])
def test_chunks_cover_and_advance(text):
    out = C.chunk_offsets(text)
    if len(text) < 200 or text.isspace():
        assert out == []
        return
    assert out[0][1] == 0 and out[-1][2] == len(text) and [o for o, _, _ in out] == list(range(len(out)))
    assert all(a < b for _, a, b in out) and all(p[1] < q[1] <= p[2] for p, q in zip(out, out[1:], strict=False))


def test_extract_json():
    assert C.extract_json('so ```json\n{"a": 1}\n``` x') == '{"a": 1}'
    assert C.extract_json('x {"a": "}\\"{", "b": {"c": 2}} y') == '{"a": "}\\"{", "b": {"c": 2}}'
    assert C.extract_json("none") is None and C.extract_json(None) is None and C.extract_json("{open") is None


def test_token_chunks():
    assert C.token_chunks([[1] * 5, [2] * 5, [3] * 5], window=8, overlap=2, least=3) == [[1] * 5, [1, 1] + [2] * 5, [2, 2] + [3] * 5]
    assert [len(x) for x in C.token_chunks([[1], [2] * 20], window=8, overlap=2, least=3)] == [1, 8, 8, 8]
    assert C.token_chunks([], 8, 2, 3) == []


def test_sections_use_the_last_header(spark):
    body = "We make things for people. " * 30
    raw = f"<p>Item 1. Business</p><p>Item 1A. Risk Factors</p><p>ITEM 1. BUSINESS</p><p>{body}</p><p>Item 1A. Risk factors</p><p>{body}{body}</p>"
    caps = f"<p>ITEM 4. INFORMATION ON THE COMPANY</p><p>{body} see Item 4. Information on the Company for more</p><p>{body}</p>"
    df = spark.createDataFrame([(1, raw), (2, f"<div>{body}</div>"), (3, "<p>tiny</p>")], "id int, html string")
    got = {(r["id"], r["section"]): len(r["section_text"]) for r in T.narratives(df, "html").collect()}
    assert set(got) == {(1, "business"), (1, "risk_factors"), (2, "full")} and got[1, "risk_factors"] > got[1, "business"]
    one = T.narratives(spark.createDataFrame([(1, caps)], "id int, html string"), "html", "20-F").first()
    assert one["section_text"].startswith("ITEM 4")


def test_expand_keeps_the_hit(spark):
    text = "First one here. " * 100
    df = spark.createDataFrame([(text, 500, 620), ("no stops at all " * 200, 900, 1000)], "t string, s int, e int")
    for r in df.withColumn("x", C.expanded(F.col("t"), F.col("s"), F.col("e"))).collect():
        assert r["x"]["start"] <= r["s"] and r["x"]["end"] >= r["e"]
        if "." in r["t"]:
            assert r["t"][: r["x"]["end"]].rstrip().endswith(".")


def test_quotes(spark):
    doc = "Revenue grew 12% to $4.1 billion\nin the  second\tquarter, led by cloud. \U0001f600 Margins fell."
    cases = [("Revenue grew 12% to $4.1 billion", "exact"), ("billion in the second quarter, led by", "whitespace"), ("Revenue grew 13% to $4.1 billion", "fabricated"), ("grew", "too_short"), (None, "too_short"), ("quarter, led by cloud. \U0001f600 Margins", "exact")]
    df = spark.createDataFrame([(doc, q, s) for q, s in cases], "d string, q string, want string")
    for r in df.withColumn("r", evidence.resolve(F.col("d"), F.col("q"))).collect():
        assert r["r"]["status"] == r["want"], r["q"]
        if r["r"]["start"] is not None:
            assert doc[r["r"]["start"] : r["r"]["end"]] == r["r"]["text"]


def test_markdown_round_trip(spark):
    claims = spark.createDataFrame([(1, "sourced", "Sales rose.", "s1", "sales rose by ten"), (2, "inference", "So it goes.", None, None), (3, "sourced", "Costs fell.", "s2", "costs fell by two")], "claim_no int, kind string, text string, source_id string, quote string")
    md = evidence.briefing_markdown(claims, "T")
    back = evidence.parse_markdown(spark.createDataFrame([(1, md)], "id int, markdown string"), "id").collect()
    assert [(r["tag"], r["claim"], r["quote"]) for r in back] == [("S1", "Sales rose.", "sales rose by ten"), ("S2", "Costs fell.", "costs fell by two")]
    assert evidence.invalid_claims(claims).count() == 0


# ---- dedup, retrieval, outcomes, training


def test_greedy_keeps_what_only_dropped_ones_resemble(spark):
    got = {(r["doc"], r["rep"]) for r in dedup.greedy(spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")).collect()}
    assert got == {(2, 1)}
    rnd = random.Random(1)
    pairs = sorted({tuple(sorted(rnd.sample(range(30), 2))) for _ in range(60)})
    kept, want = [], set()
    for n in range(30):
        reps = [k for k in kept if (k, n) in pairs]
        want |= {(n, reps[0])} if reps else set()
        kept += [] if reps else [n]
    assert {(r["doc"], r["rep"]) for r in dedup.greedy(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()} == want


def test_as_of_hides_later_documents(spark):
    rows = [(1, dt.date(2020, 1, 1), "alpha beta"), (2, dt.date(2021, 1, 1), "alpha alpha"), (3, None, "alpha")]
    df = spark.createDataFrame(rows, "doc_id int, doc_date date, text string")
    ids = [r["doc_id"] for r in retrieval.candidates(df, as_of=dt.date(2020, 6, 1)).collect()]
    assert ids == [1]


def test_upsert_keeps_identity(spark):
    s = "doc_id int, ticker string, url string, doc_date date, section string, license_ok boolean, status string"
    old = spark.createDataFrame([(1, "A", "u", None, "s", True, "fetched"), (2, "B", "v", None, "s", True, "fetched")], s)
    new = spark.createDataFrame([(1, "Z", "w", None, "t", False, "packed"), (3, "C", "x", None, "s", True, "discovered")], s)
    got = {r["doc_id"]: (r["ticker"], r["url"], r["license_ok"], r["status"]) for r in corpus.upsert(old, new).collect()}
    assert got == {1: ("A", "u", True, "packed"), 2: ("B", "v", True, "fetched"), 3: ("C", "x", True, "discovered")}
    with pytest.raises(AssertionError):
        corpus.assert_empty(corpus.unlicensed(new), "unlicensed")


def test_exhibit_names(spark):
    cases = [("ex99-1.htm", True), ("q1fy27cfocommentary.htm", True), ("a_cal.htm", False), ("0001234567-20-000001.txt", False), ("logo.jpg", False), ("press-release.html", True), ("main.htm", False)]
    df = spark.createDataFrame([(n, w) for n, w in cases], "name string, want boolean")
    assert all(r["ok"] == r["want"] for r in df.withColumn("ok", corpus.is_exhibit(F.col("name"), F.lit("main.htm"), F.lit("8-K"))).collect())


def test_recommendation_contract(spark):
    lv = (100.0, 120.0, 90.0)
    ok = [("bull", 0.5, lv), ("base", 0.3, lv), ("bear", 0.2, lv)]
    rows = [(1, "long", "bull", 0.5, ok), (2, "long", "bull", 0.5, ok[:2]), (3, "flat", "base", 0.5, [(k, p, None) for k, p, _ in ok]), (4, "long", "bull", 1.5, ok), (5, "long", "bull", 0.5, [("bull", 0.5, (1.0, 1.0, 2.0)), *ok[1:]])]
    df = spark.createDataFrame(rows, "id int, direction string, chosen string, conviction double, scenarios array<struct<kind:string,probability:double,levels:struct<entry:double,target:double,invalidation:double>>>")
    assert sorted(r["id"] for r in outcomes.invalid_recommendations(df).collect()) == [2, 4, 5]
    assert df.select(outcomes.entry_price(F.col("scenarios"), F.col("chosen")).alias("e")).first()["e"] == 100.0


def test_arm_statistics(spark):
    df = spark.createDataFrame([("one", 0.1), ("none", None), ("two", 0.1), ("two", -0.1)], "arm string, relative_return double")
    got = {r["arm"]: (r["n"], r["sd"], r["t_stat"]) for r in outcomes.performance_by_arm(df).collect()}
    assert got["one"] == (1, 0.0, None) and "none" not in got and got["two"][0] == 2 and abs(got["two"][2]) < 1e-12


def test_running_offset_and_resume(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11 + 1) for i in range(200)], "doc_id int, n_tokens int")
    rows = training.running_offset(df, ["doc_id"]).orderBy("doc_id").collect()
    at = 0
    for r in rows:
        assert r["token_offset"] == at
        at += r["n_tokens"]
    s = spark.createDataFrame([(i, j) for i in range(3) for j in range(4)], "shard_id int, seq_no int")
    assert training.after_cursor(s, 1, 2).count() == 5
    assert [r["sft_example"] for r in training.interleave(spark.range(8).withColumnRenamed("id", "batch_no"), 2, 0.5).orderBy("batch_no").collect()] == [None, 0, None, 1, None, 0, None, 1]


def test_stream_takes_only_new_files(spark, tmp_path):
    from tessera.streaming import windows

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.range(5).write.parquet(src)
    stream = windows.new_files(spark, "id bigint", src)
    windows.run_once(stream, out, ck)
    spark.range(5, 8).write.mode("append").parquet(src)
    windows.run_once(windows.new_files(spark, "id bigint", src), out, ck)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_porter_examples():
    from tessera.functions.stem import stem

    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "digitizer": "digit", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: stem(w) for w in want} == want


def test_greedy_follows_long_chains(spark):
    """In a chain of neighbours every second document falls, however long it is."""
    from tessera.operators import dedup

    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert sorted(map(tuple, dedup.greedy(pairs).collect())) == [(i, i - 1) for i in range(1, 61, 2)]


def test_the_lexical_index_goes_on_where_it_stopped(spark, tmp_path):
    """Postings of a batch whose documents were never added don't count, and are written anew; a reset empties the index."""
    from tessera.operators import index

    docs = spark.createDataFrame([(1, "red fox"), (2, "red red wine"), (3, "")], "doc_id bigint, text string")
    x = index.LexicalIndex(spark, str(tmp_path / "i"), parts=4)
    x.grow(docs.where("doc_id = 1"))
    index.postings(docs.where("doc_id = 2")).selectExpr("*", "1L as batch", "0L as part").write.mode("append").partitionBy("batch", "part").parquet(x.postings)
    asked = spark.createDataFrame([(0, ["red", "wine"])], "query_id bigint, terms array<string>")
    assert [r["doc_id"] for r in x.search(asked).collect()] == [1]
    x.grow(docs)
    assert sorted(r["doc_id"] for r in x.search(asked).collect()) == [1, 2] and x.documents().count() == 3
    x.reset()
    assert x.documents().count() == 0
