"""Registered queries at their full settings, on small fixtures."""

import hashlib
import itertools
import random
import re

from tessera.operators import panel, training, validation
from tessera.plans import catalog


def test_sft_masks_at_training_length(spark, tmp_path):
    say = lambda conv, *turns: [(conv, i, role, "w " * n) for i, (role, n) in enumerate(turns)]
    rows = say(1, ("user", 100), ("assistant", 30)) + say(2, ("system", 4), ("user", 4086), ("assistant", 10)) + say(3, ("user", 4096), ("assistant", 10)) + say(4, ("user", 10), ("assistant", 5000))
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in catalog.QUERIES["sft_mask_lengths"](spark, str(tmp_path)).collect()}
    assert training.SEQ_LEN == 4096 and got == {(1, 100, 30), (2, 4090, 6), (4, 10, 4086)}
    assert {tuple(r) for r in catalog.QUERIES["sft_mask_sums"](spark, str(tmp_path)).collect()} == {(1, 130, 30), (2, 4096, 6), (4, 4096, 4086)}


def test_minhash_queries_use_the_whole_signature(spark, tmp_path):
    """Against signatures, bands and the greedy rule written out in Python."""
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(9000)}" for _ in range(120)] for _ in range(4)]
    docs = []
    for part, words in enumerate(base):
        for copy in range(5):
            w = list(words)
            for at in rnd.sample(range(len(w)), copy):
                w[at] = f"x{rnd.randrange(9000)}"
            docs.append((part * 10 + copy, " ".join(w), f"s{part % 2}"))
    docs.append((99, "too short", "s0"))
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    full, sigs, parts = (1 << 50) - 1, {}, {}
    for i, text, part in docs:
        w = re.sub("[0-9]+", "0", text).split()
        marks = [hashlib.md5(" ".join(w[k : k + 9]).encode()).hexdigest() for k in range(len(w) - 8)]
        ab = [(int(h[:15], 16) & full, int(h[16:31], 16) & full) for h in marks]
        if ab:
            sigs[i], parts[i] = [min((a + k * b) & full for a, b in ab) for k in range(128)], part
    cand = {(parts[a], a, b) for a, b in itertools.combinations(sorted(sigs), 2) if parts[a] == parts[b] and any(sigs[a][k : k + 8] == sigs[b][k : k + 8] for k in range(0, 128, 8))}
    same = {(a, b): sum(map(int.__eq__, sigs[a], sigs[b])) / 128 for _, a, b in cand}
    close, kept, dropped = {p for p, s in same.items() if s >= 0.8}, [], set()
    for n in sorted({x for p in close for x in p}):
        reps = [k for k in kept if (k, n) in close]
        dropped |= {(n, reps[0])} if reps else set()
        kept += [] if reps else [n]
    run = lambda name: {tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert close and close < same.keys()
    assert run("minhash_signature") == {(i, ",".join(map(str, s))) for i, s in sigs.items()}
    assert run("lsh_candidates") == cand
    assert {(r["a"], r["b"], r["similarity"]) for r in catalog.QUERIES["minhash_pairs"](spark, str(tmp_path)).collect()} == {(a, b, round(same[a, b], 6)) for a, b in close}
    assert {(r["doc"], r["rep"]) for r in catalog.QUERIES["greedy_dedup"](spark, str(tmp_path)).collect()} == dropped


def test_boosting_has_all_features_and_trees(spark, monkeypatch):
    """The rows and settings the registered query fits on; fitting itself takes minutes."""
    seen = {}

    def fit(rows, folds, names, label, trees=validation.TREES):
        seen.update(rows=rows, names=names, trees=trees)

    monkeypatch.setattr(validation, "walk_forward_predict", fit)
    catalog.QUERIES["gbdt_predictions"](spark, "/root/testdata/sf0.001")
    assert set(seen["names"]) == panel.REGISTRY.keys() and seen["trees"] == validation.gbdt().getMaxIter() == 300
    rows = seen["rows"].select(*seen["names"]).collect()
    assert rows and all(0 < x <= 1 for r in rows for x in r)
