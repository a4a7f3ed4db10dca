"""Queries over documents, pages and vectors, with independent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import text as T
from ..operators import corpus as K
from ..operators import dedup as D
from ..operators import retrieval as R
from ..sources.tables import table
from .catalog import query

TERMS = {0: ["license", "worthless", "clown"], 1: ["token", "pathetic", "scum", "public"], 2: ["mit", "released", "idiot"]}
_VALUES = ", ".join(f"({q}, '{t}')" for q, ts in TERMS.items() for t in ts)
TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


def _queries(spark):
    return spark.createDataFrame([(q, t) for q, t in TERMS.items()], "query_id bigint, terms array<string>")


def _bm25_sql(where: str = "true", name: str = "bm") -> str:
    return f"""asked(query_id, term) as (select cast(q as bigint), t from (values {_VALUES}) v(q, t)),
    docs as (select doc_id, {TOK} t from documents where {where}),
    st as (select count(*)::double n, avg(len(t)) avgdl from docs),
    post as (select doc_id, len(t) dl, unnest(t) term from docs),
    tf as (select doc_id, term, dl, count(*) tf from post where term in (select term from asked) group by 1, 2, 3),
    dfs as (select term, count(*) df from tf group by 1),
    {name} as (select query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) score
           from tf join dfs using (term) join asked using (term) cross join st group by 1, 2)"""


def _top_sql(src: str, k: int, key: str = "doc_id") -> str:
    return f"select * from (select *, row_number() over (partition by query_id order by score desc, {key}) rank from {src}) where rank <= {k}"


@query("bm25_topk", f"with {_bm25_sql()} select query_id, doc_id, round(score, 6) score, cast(rank as integer) rank from ({_top_sql('(select query_id, doc_id, round(score, 9) score from bm)', 12)})")
def bm25_topk(spark, sf_dir):
    s = R.bm25(table(spark, sf_dir, "documents"), _queries(spark)).withColumn("score", F.round("score", 9))
    return R.top(s, 12).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("bm25_filtered_topk", f"with {_bm25_sql(chr(39).join(['lang = ', 'en', ' and n_chars >= 400']))} select query_id, doc_id, round(score, 6) score, cast(rank as integer) rank from ({_top_sql('(select query_id, doc_id, round(score, 9) score from bm)', 12)})")
def bm25_filtered_topk(spark, sf_dir):
    docs = R.candidates(table(spark, sf_dir, "documents"), equals={"lang": ["en"]}).where("n_chars >= 400")
    s = R.bm25(docs, _queries(spark)).withColumn("score", F.round("score", 9))
    return R.top(s, 12).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("postings", f"with t as (select doc_id, len({TOK}) dl, unnest({TOK}) term from documents) select doc_id, term, cast(dl as integer) dl, count(*) tf from t group by 1, 2, 3")
def postings(spark, sf_dir):
    return R.postings(table(spark, sf_dir, "documents")).select("doc_id", "term", "dl", "tf")


@query("phrase_match_count", r"select doc_id, len(regexp_extract_all(lower(text), 'general[^a-z0-9]+public')) n from documents where regexp_matches(lower(text), 'general[^a-z0-9]+public')")
def phrase_match_count(spark, sf_dir):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("general[^a-z0-9]+public"), F.lit(0))).cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n > 0")


@query("phrase_hits", f"with t as (select doc_id, {TOK} t from documents), w as (select doc_id, t, unnest(range(1, len(t) - 1)) i from t where len(t) >= 3) select doc_id, count(*) n from w where t[i] = 'gnu' and t[i + 1] = 'general' and t[i + 2] = 'public' group by 1")
def phrase_hits(spark, sf_dir):
    return R.phrase_hits(table(spark, sf_dir, "documents"), ["gnu", "general", "public"])


@query("bm25_stemmed_topk")
def bm25_stemmed_topk(spark, sf_dir):
    return R.top(R.bm25(table(spark, sf_dir, "documents"), _queries(spark), stems=True), 12).select("query_id", "doc_id", "rank")


@query("query_terms", "select item_id, list_distinct_terms terms from (select item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\\-./]*'), lambda x: lower(x)), lambda x: len(x) > 1 and x not in (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")) all_terms, array_to_string(list_filter(all_terms, lambda x, i: list_position(all_terms, x) = i), ' ') list_distinct_terms from benchmark)")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


DOT = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: z[1]::double * z[2]::double))"


@query("dense_topk", f"with s as (select q.vec_id query_id, c.vec_id, round({DOT}, 9) score from embeddings q cross join embeddings c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id) select query_id, vec_id, round(score, 6) score, cast(rank as integer) rank from ({_top_sql('s', 12, 'vec_id')})")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _dense(spark, sf_dir, k=12):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = v.join(q, v["vec_id"] != q["query_id"]).select("query_id", "vec_id", F.round(R.dot(F.col("embedding"), F.col("q")), 9).alias("score"))
    return R.top(s, k, "vec_id")


@query("dense_recall_by_label", f"with s as (select q.vec_id query_id, q.label ql, c.vec_id, c.label cl, round({DOT}, 9) score from embeddings q cross join embeddings c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id), t as ({_top_sql('s', 20, 'vec_id')}), r as (select query_id, min(case when ql = cl then rank end) f from t group by 1) select query_id, cast(coalesce(f <= 5, false) as integer) recall_5, cast(coalesce(f <= 20, false) as integer) recall_20, round(coalesce(1.0 / f, 0), 6) rr from r")
def dense_recall_by_label(spark, sf_dir):
    hits = _dense(spark, sf_dir, 20)
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    gold = lab.select("vec_id", "label").join(lab.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label")), "label").where("vec_id <> query_id").select("query_id", "vec_id")
    return R.recall_and_rr(hits, gold, "vec_id").withColumn("rr", F.round("rr", 6))


@query("l2_normalised", "select vec_id, round(list_sum(list_transform(embedding, lambda x: (x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) ^ 2)), 6) norm from embeddings")
def l2_normalised(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", R.l2_normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(R.dot(F.col("v"), F.col("v")), 6).alias("norm"))


HYBRID = f"""with {_bm25_sql()},
    lex as ({_top_sql('(select query_id, doc_id, round(score, 9) score from bm)', 60)}),
    ds as (select q.vec_id // 100 query_id, c.vec_id doc_id, round({DOT}, 9) score from embeddings q cross join embeddings c where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
    den as ({_top_sql('ds', 60)}),
    fused as (select coalesce(l.query_id, d.query_id) query_id, coalesce(l.doc_id, d.doc_id) doc_id, l.rank rb, d.rank rd, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + d.rank), 0) rrf from lex l full outer join den d on l.query_id = d.query_id and l.doc_id = d.doc_id),
    ord as (select *, row_number() over (partition by query_id order by rrf desc, rb nulls last, rd nulls last, doc_id) rank from fused)"""


def _hybrid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lex = R.top(R.bm25(docs, _queries(spark)).withColumn("score", F.round("score", 9)), 60)
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 100).alias("query_id"), F.col("vec_id").alias("own"), F.col("embedding").alias("q"))
    s = v.join(q, v["vec_id"] != q["own"]).select("query_id", F.col("vec_id").alias("doc_id"), F.round(R.dot(F.col("embedding"), F.col("q")), 9).alias("score"))
    return R.ranked(R.fuse(lex, R.top(s, 60)))


@query("hybrid_rrf", HYBRID + " select query_id, doc_id, round(rrf, 6) rrf, cast(rank as integer) rank, cast(rb as integer) rank_bm25, cast(rd as integer) rank_dense from ord where rank <= 20")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir).where("rank <= 20").select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "rank", "rank_bm25", "rank_dense")


@query("hybrid_capped", HYBRID + ", c as (select query_id, doc_id, source, rank, row_number() over (partition by query_id, source order by rank) n from ord join documents using (doc_id)) select query_id, doc_id, source, cast(place as integer) place from (select *, row_number() over (partition by query_id order by rank) place from c where n <= 3) where place <= 12")
def hybrid_capped(spark, sf_dir):
    hits = _hybrid(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return R.capped(hits, "source", 3, 12).select("query_id", "doc_id", "source", "place")


@query("section_quota", HYBRID + ", c as (select query_id, doc_id, lang, rank, row_number() over (partition by query_id, lang order by rank) n from ord join documents using (doc_id)) select query_id, doc_id, lang from c where n <= case when lang = 'en' then 2 else 1 end")
def section_quota(spark, sf_dir):
    hits = _hybrid(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return R.quota(hits, F.col("lang"), {"en": 2}, 1).select("query_id", "doc_id", "lang")


ANCHORS = {0: "license", 1: "token", 2: "idiot"}
_GOLD = " union all ".join(f"select cast({q} as bigint) query_id, doc_id from documents where regexp_matches(text, '(?i){a}') and regexp_matches(text, '[0-9]')" for q, a in ANCHORS.items())


def _gold(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), None
    for q, a in ANCHORS.items():
        one = docs.where(R.is_gold(F.col("text"), a)).select(F.lit(q).cast("bigint").alias("query_id"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("retrieval_eval", f"{HYBRID}, gold as ({_GOLD}), f as (select g.query_id, min(rank) f from (select distinct query_id from gold) g left join (select o.* from ord o semi join gold using (query_id, doc_id)) o using (query_id) group by 1) select query_id, cast(coalesce(f <= 5, false) as integer) recall_5, cast(coalesce(f <= 20, false) as integer) recall_20, round(coalesce(1.0 / f, 0), 6) rr from f")
def retrieval_eval(spark, sf_dir):
    return R.recall_and_rr(_hybrid(spark, sf_dir), _gold(spark, sf_dir), "doc_id").withColumn("rr", F.round("rr", 6))


@query("retrieval_eval_summary", f"""{HYBRID}, gold as ({_GOLD}),
    modes as (select 'hybrid' mode, query_id, doc_id, rank from ord union all select 'bm25', query_id, doc_id, rank from lex union all select 'dense', query_id, doc_id, rank from den),
    f as (select mode, g.query_id, min(rank) f from (select distinct query_id from gold) g cross join (select distinct mode from modes) m left join (select o.* from modes o semi join gold using (query_id, doc_id)) o using (mode, query_id) group by 1, 2)
    select mode, count(*) n, round(avg(cast(coalesce(f <= 5, false) as integer)), 6) recall_5, round(avg(cast(coalesce(f <= 20, false) as integer)), 6) recall_20, round(avg(coalesce(1.0 / f, 0)), 6) mrr from f group by 1""")
def retrieval_eval_summary(spark, sf_dir):
    h, gold, out = _hybrid(spark, sf_dir), _gold(spark, sf_dir), None
    for mode, rank in (("hybrid", "rank"), ("bm25", "rank_bm25"), ("dense", "rank_dense")):
        one = R.recall_and_rr(h.where(F.col(rank).isNotNull()).select("query_id", "doc_id", F.col(rank).alias("rank")), gold, "doc_id").withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("recall_20"), 6).alias("recall_20"), F.round(F.avg("rr"), 6).alias("mrr"))


@query("candidate_filter", "select doc_id, lang, source, n_chars from documents where lang in ('en', 'de') and source in ('src0', 'src1', 'src2') and n_chars between 500 and 5000")
def candidate_filter(spark, sf_dir):
    docs = R.candidates(table(spark, sf_dir, "documents"), equals={"lang": ["en", "de"], "source": ["src0", "src1", "src2"]})
    return docs.where(F.col("n_chars").between(500, 5000)).select("doc_id", "lang", "source", "n_chars")


@query("thinned_gold", "with n as (select doc_id, row_number() over (order by doc_id) - 1 i, count(*) over () // 300 + 1 step from documents) select doc_id from n where i % step = 0")
def thinned_gold(spark, sf_dir):
    return R.thinned(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 300)


@query("neighbours_range", "select a.conv_id, a.turn at_turn, b.turn from conversations a join conversations b on a.conv_id = b.conv_id and b.turn between a.turn - 1 and a.turn + 1")
def neighbours_range(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"))
    return K.neighbours(c, c, 1).select(F.col("doc_id").alias("conv_id"), F.col("at").alias("at_turn"), F.col("ordinal").alias("turn"))


# ---- text

STRIP = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</tr>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'),
    '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""


@query("strip_html", f"select page_id, {STRIP} as text from pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9))), lambda l: l = '' or (length(l) >= 4 and not regexp_matches(l, '^[0-9 .,$%()+/-]+$') and length(regexp_replace(l, '[^\p{L}]', '', 'g')) >= length(l) * 0.35))"


@query("numeric_lines", f"select doc_id, trim(regexp_replace(array_to_string({LINES}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) as text from documents")
def numeric_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_numeric_lines(F.col("text")).alias("text"))


@query("section_split")
def section_split(spark, sf_dir):
    """Filings made from documents: a table of contents, then sections with the documents' text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    head = "Item 1. Business<br>Item 1A. Risk Factors<br>Item 7. Management's Discussion<br>"
    html = F.concat(F.lit(head + "<p>Item 1. Business</p><p>"), F.col("text"), F.lit("</p><p>Item 1A. Risk Factors</p><p>"), F.col("text"), F.lit("</p>"))
    return T.narratives(docs.select("doc_id", html.alias("html")), "html").select("doc_id", F.col("section").alias("name"), F.char_length("section_text").alias("n_chars"))


NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g'))"


@query("normalize_hash", f"select doc_id, sha256({NORM}) digest from documents")
def normalize_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalise_for_hashing(F.col("text")), 256).alias("digest"))


@query("exact_groups", f"with h as (select doc_id, sha256({NORM}) d from documents) select doc_id, min(doc_id) over (partition by d) survivor, count(*) over (partition by d) copies from h")
def exact_groups(spark, sf_dir):
    return D.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "survivor", "copies")


@query("dedup_manifest", f"with h as (select doc_id, source, min(doc_id) over (partition by sha256({NORM})) s from documents) select source, count(*) n, count_if(s <> doc_id) dropped, round(count_if(s <> doc_id) / greatest(count(*), 1), 6) drop_rate from h group by 1")
def dedup_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    g = D.exact_groups(docs).join(docs.select("doc_id", "source"), "doc_id")
    n, d = F.count(F.lit(1)), F.count_if(F.col("survivor") != F.col("doc_id"))
    return g.groupBy("source").agg(n.alias("n"), d.alias("dropped"), F.round(D.drop_rate(n, d), 6).alias("drop_rate"))


@query("make_id", "select doc_id, substr(sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|'), 1, 24) id from documents")
def make_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.make_id(F.col("source"), F.col("lang"), F.lit(None).cast("string")).alias("id"))


W9 = f"list_filter(string_split_regex({NORM}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
SHINGLES = f"sh as (select doc_id, source, {W9} w from documents), sx as (select doc_id, source, list_distinct(list_transform(range(1, len(w) - 7), lambda i: array_to_string(w[i:i+8], ' '))) s from sh)"


@query("shingle_counts", f"with {SHINGLES} select doc_id, count(distinct x) n_shingles from (select doc_id, unnest(s) x from sx) group by 1")
def shingle_counts(spark, sf_dir):
    return D.shingle_rows(table(spark, sf_dir, "documents"), "source").groupBy("doc_id").agg(F.countDistinct("shingle").alias("n_shingles"))


M50 = (1 << 50) - 1
def _sig_sql(perms):
    return f"{SHINGLES}, ab as (select doc_id, source, ('0x' || substr(md5(x), 1, 15))::bigint & {M50} a, ('0x' || substr(md5(x), 17, 15))::bigint & {M50} b from (select doc_id, source, unnest(s) x from sx)), hs as (select doc_id, source, i, min((a + i * b) & {M50}) m from ab cross join (select unnest(range({perms})) i) group by 1, 2, 3), sg as (select doc_id, source, list(m order by i) sig from hs group by 1, 2)"


SIG = _sig_sql(D.PERMUTATIONS)


def _sigs(spark, sf_dir):
    return D.signatures(table(spark, sf_dir, "documents"), "source")


@query("minhash_signature", f"with {SIG} select doc_id, array_to_string(sig, ',') sig from sg")
def minhash_signature(spark, sf_dir):
    return _sigs(spark, sf_dir).select("doc_id", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig"))


def _band_sql(perms, bands):
    rows = perms // bands
    return f"{_sig_sql(perms)}, bd as (select doc_id, source, b, array_to_string(sig[b*{rows}+1:b*{rows}+{rows}], ',') h from sg cross join (select unnest(range({bands})) b)), cand as (select distinct x.source, x.doc_id a, y.doc_id b from bd x join bd y on x.source = y.source and x.b = y.b and x.h = y.h and x.doc_id < y.doc_id), ver as (select c.source, a, b, len(list_filter(list_zip(s1.sig, s2.sig), lambda z: z[1] = z[2])) / {perms} sim from cand c join sg s1 on s1.doc_id = a join sg s2 on s2.doc_id = b)"


BAND = _band_sql(D.PERMUTATIONS, D.BANDS)


def _pairs(spark, sf_dir):
    s = _sigs(spark, sf_dir)
    return D.verified(D.candidates(s, "source"), s)


@query("lsh_candidates", f"with {BAND} select source, a, b from cand")
def lsh_candidates(spark, sf_dir):
    return D.candidates(_sigs(spark, sf_dir), "source")


@query("minhash_pairs", f"with {BAND} select source, a, b, round(sim, 6) similarity from ver where sim >= 0.8")
def minhash_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


def _greedy_sql(band):
    return f"with recursive {band}, e as (select a, b from ver where sim >= 0.8), nodes as (select a n from e union select b from e), step(i, n, kept) as (select 0, cast(null as bigint), cast([] as bigint[]) union all select i + 1, x.n, case when exists (select 1 from e where e.b = x.n and list_contains(kept, e.a)) then kept else list_append(kept, x.n) end from step, (select n, row_number() over (order by n) r from nodes) x where x.r = i + 1), fin as (select kept from step order by i desc limit 1) select b doc, min(a) rep from e, fin where list_contains(kept, a) and not list_contains(kept, b) group by 1"


@query("greedy_dedup", _greedy_sql(BAND))
def greedy_dedup(spark, sf_dir):
    return D.greedy(_pairs(spark, sf_dir))


# ---- chunks

@query("chunk_offsets")
def chunk_offsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    c = docs.select("doc_id", F.explode(C.chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.ordinal", "c.start", "c.end")


@query("chunk_verbatim_check", "select doc_id, true verbatim from documents where length(text) >= 200")
def chunk_verbatim_check(spark, sf_dir):
    """Chunks cover their document from first to last character, overlap, and stand in it."""
    docs = table(spark, sf_dir, "documents")
    c = docs.select("doc_id", "text", F.explode(C.chunks(F.col("text"))).alias("c")).select("doc_id", "text", "c.*")
    ok = (F.instr("text", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))) > 0) & (F.col("end") > F.col("start"))
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    c = c.withColumn("prev", F.lag("end").over(w)).withColumn("ok", ok & (F.coalesce("prev", F.lit(0)) >= F.col("start")))
    one = c.groupBy("doc_id").agg(F.min("ok").alias("ok"), F.min("start").alias("first"), F.max("end").alias("last"), F.first(F.char_length("text")).alias("n"))
    return one.select("doc_id", (F.col("ok") & (F.col("first") == 0) & (F.col("last") == F.col("n"))).alias("verbatim"))


@query("expand_passage")
def expand_passage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    size = F.char_length("text")
    hit = F.floor(size / 2)
    return docs.select("doc_id", C.expanded(F.col("text"), hit, F.least(hit + 100, size)).alias("e")).select("doc_id", "e.start", "e.end")


# ---- catalog

CAT = "cat as (select doc_id, source, lang, case when n_chars < 300 then 'dropped' when doc_id % 3 = 0 then 'packed' else 'cleaned' end status, case when n_chars < 300 then case when doc_id % 2 = 0 then 'near_duplicate' else 'too_short' end end drop_reason, n_chars // 4 token_len, cast(date '2020-01-01' + cast(doc_id % 700 as integer) as date) doc_date, doc_id % 11 <> 0 license_ok from documents)"


def _catalog(spark, sf_dir):
    d, short = table(spark, sf_dir, "documents"), F.col("n_chars") < 300
    return d.select(
        "doc_id", "source", "lang", F.when(short, "dropped").when(F.col("doc_id") % 3 == 0, "packed").otherwise("cleaned").alias("status"),
        F.when(short, F.when(F.col("doc_id") % 2 == 0, "near_duplicate").otherwise("too_short")).alias("drop_reason"), F.floor(F.col("n_chars") / 4).alias("token_len"),
        F.expr("date_add(date'2020-01-01', cast(doc_id % 700 as int))").alias("doc_date"), (F.col("doc_id") % 11 != 0).alias("license_ok"),
    )


@query("manifest", f"with {CAT} select count(*) n_docs, cast(coalesce(sum(token_len) filter (status in ('deduped', 'packed')), 0) as bigint) tokens, count_if(drop_reason = 'near_duplicate') n_duplicates, round(count_if(drop_reason = 'near_duplicate') / greatest(count(*), 1), 6) dedup_rate, min(doc_date) filter (status <> 'dropped') first_date, max(doc_date) filter (status <> 'dropped') last_date from cat")
def manifest(spark, sf_dir):
    return K.manifest(_catalog(spark, sf_dir)).withColumn("dedup_rate", F.round("dedup_rate", 6))


@query("manifest_grouping_sets", f"with {CAT} select status, source, count(*) n, cast(sum(token_len) as bigint) tokens from cat group by grouping sets ((), (status), (source))")
def manifest_grouping_sets(spark, sf_dir):
    return K.manifest_sets(_catalog(spark, sf_dir)).drop("level")


@query("pending_scan", f"with {CAT} select doc_id, source from cat where status = 'cleaned'")
def pending_scan(spark, sf_dir):
    return K.pending(_catalog(spark, sf_dir), "cleaned").select("doc_id", "source")


@query("cutoff_assertion", f"with {CAT} select count(*) n_after_cutoff from (select * from cat where status <> 'dropped' and doc_date > date '2021-11-29' limit 5)")
def cutoff_assertion(spark, sf_dir):
    import datetime

    return K.after_cutoff(_catalog(spark, sf_dir), datetime.date(2021, 11, 29)).agg(F.count(F.lit(1)).alias("n_after_cutoff"))


@query("licence_assertion", f"with {CAT} select count(*) n_unlicensed from cat where status <> 'dropped' and not coalesce(license_ok, false)")
def licence_assertion(spark, sf_dir):
    return K.unlicensed(_catalog(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_unlicensed"))


@query("catalog_upsert", f"with {CAT}, news as (select doc_id + 500 doc_id, 'new' source, 'xx' lang, 'fetched' status, cast(null as varchar) drop_reason, 1 token_len, date '2022-01-01' doc_date, true license_ok from documents) select coalesce(c.doc_id, n.doc_id) doc_id, case when n.doc_id is null then c.source else n.source end source, case when n.doc_id is null then c.status else n.status end status, case when n.doc_id is null then c.drop_reason else n.drop_reason end drop_reason, case when c.doc_id is not null then c.doc_date else n.doc_date end doc_date, case when c.doc_id is not null then c.license_ok else n.license_ok end license_ok from cat c full outer join news n on c.doc_id = n.doc_id")
def catalog_upsert(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    news = table(spark, sf_dir, "documents").selectExpr("doc_id + 500 as doc_id", "'new' as source", "'xx' as lang", "'fetched' as status", "cast(null as string) as drop_reason", "1L as token_len", "date'2022-01-01' as doc_date", "true as license_ok")
    return K.upsert(c, news).select("doc_id", "source", "status", "drop_reason", "doc_date", "license_ok")


@query("group_by_issuer", "select coalesce(nullif(source, 'src0'), '_none') issuer, count(*) n from documents group by 1")
def group_by_issuer(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(F.nullif("source", F.lit("src0")), F.lit("_none")).alias("issuer")).agg(F.count(F.lit(1)).alias("n"))


@query("incremental_anti_join", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def incremental_anti_join(spark, sf_dir):
    return K.unseen(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"))


@query("incremental_chunk_ids", "select doc_id, 1000 + row_number() over (order by source, doc_id) - 1 chunk_id from documents where doc_id not in (select doc_id from labels)")
def incremental_chunk_ids(spark, sf_dir):
    new = K.unseen(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"))
    return K.next_ids(new, ["source", "doc_id"], 1000).select("doc_id", "chunk_id")


@query("index_counts", "select count(*) n, coalesce(max(doc_id), 0) max_id, count(distinct source) n_sources from documents")
def index_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("max_id"), F.countDistinct("source").alias("n_sources"))


@query("discover_filings", "select o_orderkey, cast(o_orderdate as date) doc_date, case when o_orderdate > timestamp '2000-01-01' then 'dropped' else 'discovered' end status, case when o_orderdate > timestamp '2000-01-01' then 'after_cutoff' end drop_reason from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate >= timestamp '1997-01-01'")
def discover_filings(spark, sf_dir):
    import datetime

    f = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("doc_date"), F.col("o_orderpriority").alias("form"))
    return K.discovered(f, ["1-URGENT", "2-HIGH"], datetime.date(1997, 1, 1), datetime.date(2000, 1, 1)).drop("form")


@query("latest_per_issuer", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) where n <= 2")
def latest_per_issuer(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n <= 2").select("o_custkey", "o_orderkey")


@query("resume_last_record", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations) where n = 1")
def resume_last_record(spark, sf_dir):
    return K.last_record(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role")
