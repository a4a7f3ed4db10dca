"""Quotes, claims and audits: every citation is located in the retained text or rejected with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved

QUOTE_LEAST, TEXT_MOST, QUOTE_MOST = 24, 400, 1200
RUN = 4  # words in a row by which a quote finds the documents that may have it
EXACT, WHITESPACE, FABRICATED, TOO_SHORT = "exact", "whitespace", "fabricated", "too_short"


def squeezed(text: Column) -> Column:
    """White-space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def quote_pattern(quote: Column) -> Column:
    """A pattern that finds the quote with any white space between its words, as the document has it."""
    escaped = F.regexp_replace(squeezed(quote), r"([\\^$.|?*+()\[\]{}-])", r"\\$1")
    return F.concat(F.lit("(?U)"), F.regexp_replace(escaped, " ", r"\\s+"))


def trimmed(quote: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(quote, F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def too_short(quote: Column, least: int = QUOTE_LEAST) -> Column:
    return F.char_length(trimmed(quote)) < least


def resolve(document: Column, quote: Column, least: int = QUOTE_LEAST) -> Column:
    """Struct (status, start, end, text): where a quote stands in a document; text is the document's own.

    Exact matches first, then matches that differ in white space only; offsets are 0-based code points.
    """
    q = trimmed(quote)
    at = F.instr(document, q) - 1
    # The pattern is tried only where the document has the quote's first two words and its last.
    flat = squeezed(q)
    first, second = F.substring_index(flat, " ", 1), F.substring_index(F.substring_index(flat, " ", 2), " ", -1)
    likely = (F.instr(document, first) > 0) & (F.instr(document, second) > 0) & (F.instr(document, F.substring_index(flat, " ", -1)) > 0)
    loose = F.when(likely, F.regexp_substr(document, quote_pattern(q)))
    loose_at = F.instr(document, loose) - 1
    found = lambda s, a, t: F.struct(F.lit(s).alias("status"), a.cast("int").alias("start"), (a + F.char_length(t)).cast("int").alias("end"), t.alias("text"))
    none = lambda s: F.struct(F.lit(s).alias("status"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("text"))
    return (
        F.when(F.char_length(q) < least, none(TOO_SHORT)).when(document.isNull(), none(FABRICATED))
        .when(at >= 0, found(EXACT, at, q)).when(loose.isNotNull(), found(WHITESPACE, loose_at, loose)).otherwise(none(FABRICATED))
    )


def located(claims: DataFrame, documents: DataFrame, batch: str = "batch") -> DataFrame:
    """(claim_id, source_id, r): the documents of each claim's batch that have its quote, with the place (``resolve``).

    Inner words of a quote are whole words of a document that has it, so such a document has every run of RUN of them.
    Each claim goes to the documents of the run that fewest have, and only their texts are searched; quotes too short for
    a run are searched for in every text of their batch. A claim_id names one claim, a source_id one document of its batch;
    documents without either are not searched.
    """
    fit = claims.where(~too_short(F.col("quote"))).select("claim_id", batch, "quote", F.split(trimmed(F.col("quote")), r"(?U)\s+").alias("w"))
    mark = F.xxhash64(F.slice("w", F.col("i"), RUN)).alias("mark")
    runs = fit.where(F.size("w") >= RUN + 2).select("claim_id", batch, "w", F.explode(F.sequence(F.lit(2), F.size("w") - RUN)).alias("i")).select("claim_id", batch, mark)
    held = documents.select(batch, "source_id", F.split("text", r"(?U)\s+").alias("w")).where(F.size("w") >= RUN)
    held = held.select(batch, "source_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - RUN + 1)).alias("i")).select(batch, "source_id", mark)
    held = saved(held.join(runs.select(batch, "mark").distinct(), [batch, "mark"], "left_semi").distinct(), "quote-runs")
    many = runs.join(held.groupBy(batch, "mark").agg(F.count(F.lit(1)).alias("n")), [batch, "mark"], "left")
    rarest = many.groupBy("claim_id", batch).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "mark")).alias("m")).select("claim_id", batch, F.col("m.mark").alias("mark"))
    places = rarest.join(held, [batch, "mark"]).select("claim_id", batch, "source_id")
    rest = fit.where(F.size("w") < RUN + 2).join(documents.select(batch, "source_id"), batch).select("claim_id", batch, "source_id")
    tried = places.unionAll(rest).join(fit.select("claim_id", "quote"), "claim_id").join(documents.select(batch, "source_id", "text"), [batch, "source_id"])
    return tried.select("claim_id", "source_id", resolve(F.col("text"), F.col("quote")).alias("r")).where(F.col("r.status").isin(EXACT, WHITESPACE)).distinct()


def resolve_in_batch(claims: DataFrame, documents: DataFrame, batch: str = "batch") -> DataFrame:
    """Resolve each claim (claim_id, batch, quote, preferred) in its batch's documents (batch, source_id, text).

    The cited document wins; else the first other one that has the quote. A short quote is reported
    as such only where the citation is known.
    """
    known = documents.select(batch, F.col("source_id").alias("preferred")).distinct().withColumn("_known", F.lit(True))
    hits = located(claims, documents, batch).join(claims.select("claim_id", "preferred"), "claim_id")
    best = hits.groupBy("claim_id").agg(F.min(F.struct((~F.col("source_id").eqNullSafe(F.col("preferred"))).alias("other"), "source_id", "r")).alias("m"))
    tried = claims.join(known, [batch, "preferred"], "left").join(best, "claim_id", "left")
    ok = F.col("m").isNotNull()
    short = too_short(F.col("quote")) & F.coalesce("_known", F.lit(False))
    status = F.when(ok, F.col("m.r.status")).when(short, F.lit(TOO_SHORT)).otherwise(F.lit(FABRICATED))
    return tried.select(
        "claim_id", status.alias("status"), F.col("m.source_id").alias("source_id"), F.col("m.r.text").alias("quote"),
        (ok & F.coalesce("_known", F.lit(False)) & (F.col("m.source_id") != F.col("preferred"))).alias("recited"),
    )


CLAIM = "kind string, text string, source string, quote string"


def json_lines(outputs: DataFrame, key: str, text: str = "output") -> DataFrame:
    """One row per line that looks like an object: (key, line_no, raw, claim, malformed)."""
    lines = outputs.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "raw")).where(F.col("raw").rlike(r"^\s*\{.*\}\s*$"))
    parsed = F.from_json("raw", CLAIM + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("_p", parsed).select(key, "line_no", "raw", F.col("_p").dropFields("_bad").alias("claim"), F.col("_p._bad").isNotNull().alias("malformed"))


def claim_status(lines: DataFrame, demos: DataFrame, demo_text: str = "demo") -> DataFrame:
    """Adds kind, text, quote and a first status: malformed_json, missing_fields, copied_demo, inference, or to_resolve.

    Demo sentences are a small stated list, so the anti-join broadcasts where its size allows.
    """
    kind, text = F.lower(F.trim(F.coalesce("claim.kind", F.lit("")))), F.trim(F.coalesce("claim.text", F.lit("")))
    c = lines.withColumns({"kind": kind, "text": F.substring(text, 1, TEXT_MOST), "quote": F.substring(F.coalesce("claim.quote", F.lit("")), 1, QUOTE_MOST), "source": F.trim(F.coalesce("claim.source", F.lit("")))})
    marked = c.join(demos.select(F.col(demo_text).alias("text")).distinct().withColumn("_demo", F.lit(True)), "text", "left")
    status = (
        F.when(F.col("malformed"), "malformed_json").when(~F.col("kind").isin("sourced", "inference") | (F.col("text") == ""), "missing_fields")
        .when((F.col("kind") == "inference") & F.coalesce("_demo", F.lit(False)), "copied_demo").when(F.col("kind") == "inference", "inference").otherwise("to_resolve")
    )
    cited = (F.col("kind") == "inference") & ((F.col("source") != "") | (F.col("quote") != ""))
    return marked.withColumns({"status": status, "inference_with_citation": F.coalesce(cited, F.lit(False))}).drop("_demo")


def extraction_stats(claims: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, exact rate and fabrication rate over quote attempts (a recited quote counts twice there)."""
    n = lambda s: F.count_if(F.col("status") == s)
    recited = F.count_if(F.coalesce("recited", F.lit(False)))
    attempts = n(EXACT) + n(WHITESPACE) + n(FABRICATED) + n(TOO_SHORT) + recited
    names = ("malformed_json", "missing_fields", "copied_demo", "inference", EXACT, WHITESPACE, FABRICATED, TOO_SHORT)
    return claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines_seen"), *(n(s).alias(f"n_{s}") for s in names), recited.alias("n_recited"),
        F.try_divide(n(EXACT), attempts).alias("exact_rate"), F.try_divide(n(FABRICATED), attempts).alias("fabrication_rate"),
    )


def unverified(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Sourced claims whose quote isn't in the retained document of their source."""
    sourced = claims.where("kind = 'sourced'")
    joined = sourced.join(documents.select("source_id", F.col("text").alias("_doc")), "source_id", "left")
    return joined.where(F.col("_doc").isNull() | (F.instr("_doc", F.col("quote")) == 0)).drop("_doc")


def audit(claims: DataFrame, documents: DataFrame, key: str = "briefing_id") -> DataFrame:
    """Per briefing: claims, sourced, unverified, verification rate (null without sourced claims), passed."""
    bad = unverified(claims, documents).groupBy(key).agg(F.count(F.lit(1)).alias("n_unverified"))
    total = claims.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("kind") == "sourced").alias("n_sourced"))
    out = total.join(bad, key, "left").withColumn("n_unverified", F.coalesce("n_unverified", F.lit(0)))
    rate = F.try_divide(F.col("n_sourced") - F.col("n_unverified"), F.when(F.col("n_sourced") > 0, F.col("n_sourced")))
    return out.withColumns({"verification_rate": rate, "sourced_fraction": F.col("n_sourced") / F.col("n_claims"), "passed": F.col("n_unverified") == 0})


def unknown_sources(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims that cite a source which doesn't exist; must be empty."""
    return claims.where(F.col("source_id").isNotNull()).join(sources.select("source_id"), "source_id", "left_anti")


def invalid_claims(claims: DataFrame) -> DataFrame:
    """Claims that break the rule: sourced ones have source and quote, inferences neither."""
    cited = F.col("source_id").isNotNull() & F.col("quote").isNotNull()
    bare = F.col("source_id").isNull() & F.col("quote").isNull()
    return claims.where(~F.when(F.col("kind") == "sourced", cited).otherwise(bare))


def retained(passages: DataFrame, content: str = "text") -> DataFrame:
    """Content-addressed sources: one row per distinct content, id from its SHA-256."""
    digest = F.sha2(F.col(content), 256)
    return passages.withColumns({"content_sha256": digest, "source_id": F.substring(digest, 1, 24)}).dropDuplicates(["source_id"])


def briefing_markdown(claims: DataFrame, title: str, most: int = 40, quote_chars: int = 400) -> str:
    """Markdown of one briefing's claims (kind, text, source_id, quote, claim_no): a report, so bounded and driver-side."""
    w = Window.partitionBy("kind").orderBy("claim_no")
    rows = claims.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).orderBy("claim_no").collect()
    sourced = [r for r in rows if r["kind"] == "sourced"]
    labels = {s: f"S{i + 1}" for i, s in enumerate(dict.fromkeys(r["source_id"] for r in sourced))}
    lines = [f"# {title}", "", "## Sourced", ""]
    for r in sourced:
        lines += [f"- [{labels[r['source_id']]}] {r['text']}", f"  > {(r['quote'] or '')[:quote_chars]}"]
    lines += ["", "## Inference", "", *(f"- {r['text']}" for r in rows if r["kind"] != "sourced"), "", "## Sources", "", *(f"- {v}: {k}" for k, v in labels.items())]
    return "\n".join(lines) + "\n"


def parse_markdown(docs: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """Sourced claims (key, tag, claim, quote) read back from such Markdown."""
    body = F.regexp_extract(F.col(text), r"(?s)## Sourced\s*\n(.*?)(?:\n## |$)", 1)
    items = F.regexp_extract_all(body, F.lit(r"(?m)^- \[(?:S\d+)\] .*\n  > .*$"), F.lit(0))
    one = docs.select(key, F.explode(items).alias("item"))
    part = lambda i: F.regexp_extract("item", r"(?m)^- \[(S\d+)\] (.*)\n  > (.*)$", i)
    return one.select(key, part(1).alias("tag"), part(2).alias("claim"), part(3).alias("quote"))


# ---- point-in-time context


def latest_by_key(obs: DataFrame, keys: list[str], value: str, at: str, as_of) -> DataFrame:
    """Last non-null value per key at or before ``as_of``."""
    return obs.where((F.col(at) <= F.lit(as_of)) & F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def latest_row_within(rows: DataFrame, keys: list[str], at: str, as_of, days: int, tie: str) -> DataFrame:
    """Latest row per key in the ``days`` that end with the day ``as_of``."""
    end = F.date_add(F.lit(as_of).cast("date"), 1)
    fresh = rows.where((F.col(at) < end) & (F.col(at) >= F.date_sub(end, days)))
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def trailing_snapshot(bars: DataFrame, as_of, key: str = "ticker", horizons: tuple[int, ...] = (20, 90, 252)) -> DataFrame:
    """Per key, over bars with a close up to ``as_of``: last close, returns over rows, mean volume, extremes, thin history."""
    past = bars.where((F.col("date") <= F.lit(as_of)) & F.col("close").isNotNull())
    back = Window.partitionBy(key).orderBy(F.desc("date"))
    n = F.row_number().over(back)
    numbered = past.withColumn("_n", n).where(F.col("_n") <= max(horizons) + 1)
    at = lambda k: F.max(F.when(F.col("_n") == k + 1, F.col("close")))
    year = F.col("_n") <= 252
    return numbered.groupBy(key).agg(
        at(0).alias("close"), *((F.try_divide(at(0), F.when(at(k) != 0, at(k))) - 1).alias(f"return_{k}") for k in horizons),
        F.avg(F.when(F.col("_n") <= 20, F.col("volume"))).alias("mean_volume_20"), F.max(F.when(year, F.col("close"))).alias("high_252"), F.min(F.when(year, F.col("close"))).alias("low_252"),
        F.count(F.lit(1)).alias("bars"), (F.count(F.lit(1)) < 60).alias("thin"),
    )


def insider_tallies(tx: DataFrame, key: str = "ticker") -> DataFrame:
    """Open-market buys (code P) and sells (code S) per key."""
    return tx.groupBy(key).agg(F.count_if(F.col("code") == "P").alias("buys"), F.count_if(F.col("code") == "S").alias("sells"), F.count(F.lit(1)).alias("n"))


def consensus(actions: DataFrame, key: str = "ticker") -> DataFrame:
    """Mean, highest and lowest positive target and the grades by count."""
    target = F.when(F.col("target") > 0, F.col("target"))
    grades = actions.groupBy(key, "grade").agg(F.count(F.lit(1)).alias("n"))
    tally = grades.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "grade"))), lambda g: F.concat_ws(":", g["grade"], (-g["n"]).cast("string"))), ",").alias("grades"))
    return actions.groupBy(key).agg(F.avg(target).alias("mean_target"), F.max(target).alias("high_target"), F.min(target).alias("low_target"), F.count(F.lit(1)).alias("n_firms")).join(tally, key)
