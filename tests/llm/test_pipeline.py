"""The pipeline against its stages' definitions, and the checks of the registered queries that SQL can make."""

import re
import struct
import zlib
from itertools import combinations

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessera.llm import queries as llm  # noqa: E402
from tessera.llm import toxicity  # noqa: E402

from .test_secrets import masked  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_run(rows, model):
    """The stages in plain Python: rows of (doc_id, text) -> ({stage: rows}, the texts that are packed)."""
    stages = {}
    rows = [(i, t) for i, t in rows if model.score([t or ""])[0] < 0.5]
    stages["toxicity"] = rows
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    keep = {min(g)[1] for g in groups.values()}
    rows = stages["exact_dedup"] = [(i, t) for i, t in rows if i in keep]
    component = join_brute(rows)
    rows = stages["ngram_jaccard_join"] = [(i, t) for i, t in rows if component[i] == i]
    rows = stages["secret_scan"] = [(i, masked(t)) for i, t in rows]
    return stages


def join_brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_run_against_plain_python(spark):
    """Every stage's rows, and the packed token ids, on the sample table."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = plain_run([(r["doc_id"], r["text"]) for r in docs.collect()], toxicity.train(docs, labels))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.dtypes == docs.dtypes
        before = corpus_pipeline.materialise(after, name)
        assert sorted((r["doc_id"], r["text"]) for r in before.collect()) == sorted(want[name]), name
    assert all(len(want[b]) < len(want[a]) for a, b in (("toxicity", "exact_dedup"), ("exact_dedup", "ngram_jaccard_join"))) and len(want["toxicity"]) < docs.count()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in want["secret_scan"]}
    pieces = {(i, k): x[at : at + 4096] for i, x in ids.items() for k, at in enumerate(range(0, len(x), 4096))}
    got = corpus_pipeline.run(spark, SF).collect()
    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == {(i, k): (4096 * k, len(x), crc(x)) for (i, k), x in pieces.items()}
    assert len(got) == len(pieces)
    full = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(full) <= 1.1 * sum(map(len, pieces.values())) / 4096 + 2


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = llm.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(llm.ORACLES[name])
    assert sorted(want.columns) == cols
    assert sorted(map(repr, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(repr, want.select(*cols).fetchall()))


def test_stages_on_edges_and_nothing(spark, edges, nothing):
    """Null ids and texts, repeats, long texts and clashing columns pass every stage; an empty table stays empty."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edges, SF)
        assert out.columns == edges.columns and out.dtypes == edges.dtypes, name
        rows = out.collect()
        assert any(r["doc_id"] is None for r in rows), name
        assert name == "exact_dedup" or any(r["text"] is None for r in rows), name  # null, empty and blank texts are equal there
        assert stage(spark, nothing, SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, edges, SF).count() > 0


def test_stages_begin_with_executors_at_rest(spark, nothing):
    """A full collection runs in the executors before each stage, so that the heap of the stage before goes back to the system."""

    def full():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))

    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, nothing, SF)
        assert full() > before, name
