"""Text functions as column expressions; everything stays in the JVM.

Patterns avoid classes that differ between regex engines, so results can be checked elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_html(raw: Column) -> Column:
    """Plain text: scripts and styles go, block ends become newlines, tags and entities spaces; blanks collapse."""
    x = F.regexp_replace(raw, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?i)<br[^>]*>|</p>|</div>|</tr>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"&[a-zA-Z0-9#]{1,8};", " ")
    x = F.regexp_replace(x, r"[ \t\r\f\x0b ]+", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(x, r"^[ \n]+", ""), r"[ \n]+$", "")


def drop_numeric_lines(text: Column, least_alpha: float = 0.35, least: int = 4) -> Column:
    """Drop lines that are short, all numbers, or mostly not letters; blank lines stay, three newlines become two."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.regexp_replace(F.regexp_replace(l, r"^[ \t]+", ""), r"[ \t]+$", ""))
    letters = lambda l: F.char_length(F.regexp_replace(l, r"[^\p{L}]", ""))
    keep = F.filter(lines, lambda l: (l == "") | ((F.char_length(l) >= least) & ~l.rlike(r"^[0-9 .,$%()+/-]+$") & (letters(l) >= F.char_length(l) * least_alpha)))
    return F.regexp_replace(F.regexp_replace(F.array_join(keep, "\n"), r"\n{3,}", "\n\n"), r"^[\n]+|[\n]+$", "")


def normalise_for_hashing(text: Column) -> Column:
    """Lower case, digit runs as 0, other marks as spaces, single spaces."""
    x = F.regexp_replace(F.lower(text), r"[0-9]+", "0")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " ")
    return F.trim(x)


def make_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts, joined by |; nulls are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 24)


def hash60(x: Column) -> Column:
    """A 60-bit hash that any engine with MD5 can reproduce."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("bigint")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


# Words dropped from queries.
STOPWORDS = tuple("a an the of and or in on for to with by from as at is are was were be been being that this these those it its their our your his her they we you i".split())


def query_terms(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case terms in order, without stop words, single characters and repeats."""
    terms = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-./]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(terms, F.lower), lambda t: (F.char_length(t) > 1) & ~t.isin(*stop)))


def match_expression(text: Column) -> Column:
    """Quoted terms joined by OR, as full-text engines take them."""
    return F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def strip_reasoning(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def truncate_at(text: Column, stops: tuple[str, ...]) -> Column:
    """The text before the earliest of the stop strings."""
    at = [F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNotNull(), F.substring(text, F.lit(1), first - 1)).otherwise(text)


def percent(x: Column) -> Column:
    """One-decimal percentage, n/a for null."""
    return F.when(x.isNotNull(), F.format_string("%.1f%%", x * 100)).otherwise(F.lit("n/a"))


def last_match(text: Column, pattern: str) -> Column:
    """0-based offset of the last match of ``pattern``, null without one."""
    head = F.regexp_extract(text, f"(?is)^(.*)(?:{pattern})", 1)
    return F.when(text.rlike(f"(?is){pattern}"), F.char_length(head))


# Header patterns by form, section -> pattern. A form that isn't listed uses the first.
SECTION_PATTERNS = {
    "10-K": {
        "business": r"item\s*1\s*[.\-:\s]*business",
        "risk_factors": r"item\s*1a\s*[.\-:\s]*risk\s*factors",
        "mdna": r"item\s*[27]\s*[.\-:\s]*management.{0,5}s\s*discussion",
        "quantitative_qualitative": r"item\s*[37]a\s*[.\-:\s]*quantitative\s*and\s*qualitative",
        "properties": r"item\s*2\s*[.\-:\s]*propert",
        "legal": r"item\s*3\s*[.\-:\s]*legal\s*proceedings",
    },
    "20-F": {
        "risk_factors": r"item\s*3\s*[.\-:\s]*key\s*information",
        "business": r"item\s*4\s*[.\-:\s]*information\s*on\s*the\s*company",
        "mdna": r"item\s*5\s*[.\-:\s]*operating\s*and\s*financial\s*review",
        "quantitative_qualitative": r"item\s*11\s*[.\-:\s]*quantitative\s*and\s*qualitative",
    },
    "40-F/EX": {"business": r"description\s+of\s+the\s+business", "risk_factors": r"\brisk\s+factors\b", "mdna": r"management.{0,5}s\s+discussion\s+and\s+analysis"},
}
KEPT = ("business", "risk_factors", "mdna", "quantitative_qualitative")
PREFER_CAPS = ("20-F",)


def sections(text: Column, patterns: dict[str, str], prefer_caps: bool = False) -> Column:
    """Array of (start, name, end): from the last match of each header to the next header's start or the end.

    With ``prefer_caps`` the last match that begins in capitals counts, where there is one.
    """

    def start(p: str) -> Column:
        at = last_match(text, p)
        if not prefer_caps:
            return at
        caps = F.regexp_extract(text, rf"(?s)^(.*)(?=[A-Z]{{4}})(?i:{p})", 1)
        return F.when(text.rlike(rf"(?s)(?=[A-Z]{{4}})(?i:{p})"), F.char_length(caps)).otherwise(at)

    starts = F.array_sort(F.filter(F.array(*(F.struct(start(p).alias("start"), F.lit(n).alias("name")) for n, p in patterns.items())), lambda s: s["start"].isNotNull()))
    return F.transform(starts, lambda s, i: F.struct(s["start"].alias("start"), s["name"].alias("name"), F.coalesce(F.get(starts, i + 1)["start"], F.char_length(text)).alias("end")))


def narratives(df: DataFrame, raw: str, form: str = "10-K", least: int = 500, name: str = "section", text: str = "section_text") -> DataFrame:
    """One row per kept section of each filing, or one named full where no header is found; short ones go.

    The stripped text is a column before the sections are exploded, so it is computed once a filing.
    """
    plain = df.withColumn("_plain", strip_html(F.col(raw)))
    found = F.filter(sections(F.col("_plain"), SECTION_PATTERNS.get(form, SECTION_PATTERNS["10-K"]), form in PREFER_CAPS), lambda s: s["name"].isin(*KEPT))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit("full").alias("name"), F.char_length("_plain").alias("end")))
    cut = plain.withColumn("_s", F.explode(F.when(F.size(found) > 0, found).otherwise(whole)))
    body = drop_numeric_lines(F.substring(F.col("_plain"), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")))
    return cut.withColumns({name: F.col("_s.name"), text: body}).where(F.char_length(text) >= least).drop("_plain", "_s")


def try_date(x: Column) -> Column:
    """ISO date text as a date; anything else is null."""
    return F.try_to_timestamp(F.substring(x, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def flag(x: Column) -> Column:
    """Truth of 1/0 and true/false text."""
    return F.lower(F.trim(x)).isin("1", "true")
