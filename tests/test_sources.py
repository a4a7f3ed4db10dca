import datetime as dt
import json

import pytest

from tessera.sources import records as R
from tessera.sources import sinks as S


def test_submissions_and_index(spark):
    cols = {"accessionNumber": ["a1", "a2"], "form": ["10-K", "8-K"], "filingDate": ["2020-01-02", "2021-01-02"], "primaryDocument": ["x.htm", ""]}
    df = spark.createDataFrame([(1, json.dumps({"filings": {"recent": cols}})), (1, json.dumps({k: [f"o{i}" if k == "accessionNumber" else v for i, v in enumerate(vs)] for k, vs in cols.items()}))], "cik int, body string")
    f = R.submissions(df)
    assert f.count() == 4
    got = R.recent_filings(f, ["10-K", "8-K"], dt.date(2020, 6, 1), 1).collect()
    assert [(r["accession"], r["form"]) for r in got] == [("a1", "10-K")]
    idx = spark.createDataFrame([("a1", json.dumps({"directory": {"item": [{"name": "ex99.htm"}, {"name": "b.txt"}]}}))], "accession string, body string")
    assert [r["name"] for r in R.filing_index(idx).collect()] == ["ex99.htm", "b.txt"]


def test_macro(spark, tmp_path):
    (tmp_path / "m.csv").write_text("DATE,X\n2020-01-01,1.5\n2020-02-01,.\n2020-03-01,2.5\n")
    (tmp_path / "h.csv").write_text("<html>\n<body>no</body>\n")
    assert [(r["value_date"], r["value"]) for r in R.macro_series(spark, str(tmp_path / "m.csv"), "X").collect()] == [(dt.date(2020, 1, 1), 1.5), (dt.date(2020, 3, 1), 2.5)]
    assert R.macro_series(spark, str(tmp_path / "h.csv"), "X").count() == 0


def test_ownership(spark):
    def tx(code, date, shares):
        return f"<nonDerivativeTransaction><securityTitle><value>C</value></securityTitle><transactionDate><value>{date}</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{shares}</value></transactionShares><transactionPricePerShare><value>n/a</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"

    head = "<reportingOwner><reportingOwnerId><rptOwnerName>N</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>{}</isDirector><isOfficer>{}</isOfficer></reportingOwnerRelationship></reportingOwner>"
    a = f"<ownershipDocument>{head.format('1', 'false')}<nonDerivativeTable>{tx('P', '2020-01-02', 5)}{tx('S', '2019-01-02', 7)}{tx('S', '', 7)}</nonDerivativeTable></ownershipDocument>"
    df = spark.createDataFrame([("T", a), ("T", "<broken"), ("T", None)], "ticker string, xml string")
    rows = R.ownership(df).orderBy("tx_date").collect()
    assert [(r["code"], r["shares"], r["price"], r["director"], r["officer"]) for r in rows] == [("S", 7.0, None, True, False), ("P", 5.0, None, True, False)]
    assert R.ownership_window(R.ownership(df), dt.date(2020, 2, 1)).count() == 1


def test_examples_and_universe(spark, tmp_path):
    good = json.dumps({"prompt": "p", "completion": json.dumps({"direction": "long", "conviction": 0.5})})
    (tmp_path / "e.jsonl").write_text(good + "\n\n{broken\n" + json.dumps({"prompt": "p", "completion": "{}"}) + "\n")
    valid, counts = R.examples(spark, str(tmp_path / "e.jsonl"))
    assert valid.count() == 1 and tuple(counts.first()) == (3, 2)
    assert R.universe(spark, {"segments": {"a": ["X", "ON"]}, "pilot": ["X"]}).count() == 2
    with pytest.raises(TypeError):
        R.universe(spark, {"segments": {"a": [True]}})


def test_status_partitions_and_shards(spark, tmp_path):
    c = spark.createDataFrame([(1, "packed"), (2, "dropped")], "doc_id int, status string")
    S.write_catalog(c, str(tmp_path / "cat"))
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "cat")).where("status = 'packed'").collect()] == [1]
    S.write_shards(spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3, 4])], "shard_id int, seq_no int, tokens array<int>"), str(tmp_path / "sh"))
    assert R.shards(spark, str(tmp_path / "sh"), 2).count() == 2
    with pytest.raises(ValueError):
        R.shards(spark, str(tmp_path / "sh"), 3)
    b = R.best_section(spark.createDataFrame([(1, "z"), (1, "mdna"), (2, "b"), (2, "a")], "doc_id int, section string"), ["risk", "mdna"])
    assert {(r["doc_id"], r["section"]) for r in b.collect()} == {(1, "mdna"), (2, "a")}
    got = R.fetch_status(c.select("doc_id"), spark.createDataFrame([(1, "t", None)], "doc_id int, text string, error string"))
    assert {(r["doc_id"], r["status"], r["drop_reason"]) for r in got.collect()} == {(1, "fetched", None), (2, "dropped", "fetch_failed:missing")}
