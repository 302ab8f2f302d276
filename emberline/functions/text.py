"""Names, free text and text similarity."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import staging

# Abbreviations, legal forms and noise words of facility names, applied in this order.
ABBREVIATIONS = [
    (r"\bindl\.?\b", "industrial"),
    (r"\bindus\.?\b", "industrial"),
    (r"\bmfg\.?\b", "manufacturing"),
    (r"\bmfrs?\.?\b", "manufacturing"),
    (r"\bmanufg\.?\b", "manufacturing"),
    (r"\bprodn\.?\b", "production"),
    (r"\bprod\.?\b", "production"),
    (r"\bengg\.?\b", "engineering"),
    (r"\bengineering\s*works?\b", "engineering"),
    (r"\benterprises?\b", "enterprise"),
    (r"\bindustries\b", "industry"),
    (r"\bindustrial\s+estate\b", "industrial estate"),
    (r"\bindustrial\s+area\b", "industrial area"),
]
LEGAL_FORMS = [
    (r"\bprivate\s+limited\b", "pvt ltd"),
    (r"\bpvt\.?\s*ltd\.?\b", "pvt ltd"),
    (r"\bp\.?\s*ltd\.?\b", "pvt ltd"),
    (r"\bprivate\s+ltd\.?\b", "pvt ltd"),
    (r"\blimited\s+liability\s+partnership\b", "llp"),
    (r"\bllp\b", "llp"),
    (r"\blimited\b", "ltd"),
    (r"\bltd\.?\b", "ltd"),
    (r"\bincorporated\b", "inc"),
    (r"\binc\.?\b", "inc"),
    (r"\bco-operative\b", "cooperative"),
    (r"\bcooperative\b", "cooperative"),
    (r"\bcoop\.?\b", "cooperative"),
]
NOISE = [r"\bunit\s+[ivxlcdm\d]+\b", r"\bphase\s+[ivxlcdm\d]+\b", r"\bplant\s+[ivxlcdm\d]+\b", r"\bdivision\b"]
GENERIC_INDUSTRY = ["industrial", "building industrial", "landuse industrial", "factory", "works", "plant", "manufacturing", "industry", "industrial estate", "industrial area", "general industries", "general", "unit"]


def folded(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def fold_marks(text: Column) -> Column:
    """Compatibility decomposition without combining marks, for any script."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(folded, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def collapse(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def normalise_name(name: Column, fold: bool = True) -> Column:
    """Matching form of a facility name. fold=False keeps the plan free of Python, for names known to be ASCII."""
    t = F.lower(fold_marks(F.trim(name)) if fold else F.trim(name))
    t = F.regexp_replace(t, r"\s*&\s*", " and ")
    for pattern, to in ABBREVIATIONS:
        t = F.regexp_replace(t, pattern, to)
    t = F.regexp_replace(t, r"[\-_/\\]+", " ")
    t = F.regexp_replace(t, r"""[,;:!?'"]+""", " ")
    t = F.regexp_replace(t, r"\.\s*", " ")
    for pattern, to in LEGAL_FORMS:
        t = F.regexp_replace(t, pattern, to)
    for pattern in NOISE:
        t = F.regexp_replace(t, pattern, "")
    return collapse(t)


def legal_form(name: Column) -> Column:
    found = F.lit(None).cast("string")
    for pattern, to in reversed(LEGAL_FORMS):
        found = F.when(name.rlike("(?i)" + pattern), to).otherwise(found)
    return found


def match_text(text: Column) -> Column:
    """Free text for comparison; placeholders become null."""
    t = collapse(F.regexp_replace(F.lower(text), r"[^a-z0-9\s.]", " "))
    return F.when(~t.isin("unknown", "not applicable", "not_applicable"), t)


def column_name(name: str) -> str:
    """Standard form of a column name of a schema-on-read file."""
    import re

    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z]+", "_", words)).strip("_").lower()


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) + F.size(y)) == 0, 0.0).otherwise(both / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence, a row of bits at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    full = [f"{both} {rest}".strip() for rest in (left, right)]
    scores = [_ratio(*full)]
    if both:
        scores += [_ratio(both, full[0]), _ratio(both, full[1])]
    return max(scores)


def _similarity(f, a, b) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(p, q) if p and q else 0.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def ratio(a, b) -> Column:
    """Normalised insert-delete similarity in percent; null and empty give 0."""
    return _similarity(_ratio, a, b)


def token_set_ratio(a, b) -> Column:
    """Best similarity of the common words and either rest, in percent; null and empty give 0."""
    return _similarity(token_set, a, b)


def rounded(number: str, digits: int) -> Column:
    """F.round, by arithmetic wherever the number is small and no tie is near; its decimals cost far more."""
    x, unit = F.col(number), float(10**digits)
    down = F.floor(x * unit)
    off = x * unit - down
    return F.when((F.abs(x) < 1e9 / unit) & (F.abs(off - 0.5) > 1e-6), (down + F.when(off > 0.5, 1).otherwise(0)).cast("double") / unit).otherwise(F.round(x, digits))


#: Different texts up to which all pairs of them are scored once, instead of each pair of rows.
KINDS = 1024


def kinds(*columns: DataFrame) -> DataFrame | None:
    """t and n: the different texts of these one-column tables, numbered from 0 below KINDS; None if there are more."""
    texts = reduce(DataFrame.union, [c.distinct() for c in columns]).distinct().dropna()
    found = sorted(r[0] for r in texts.limit(KINDS + 1).collect())
    return None if len(found) > KINDS else texts.sparkSession.createDataFrame([(t, i) for i, t in enumerate(found)], "t string, n long")


def with_kind(df: DataFrame, column: str, numbers: DataFrame, out: str) -> DataFrame:
    """df with the number of the text in column, null for null."""
    return df.join(F.broadcast(numbers.select(F.col("t").alias("_t"), F.col("n").alias(out))), F.col(column) == F.col("_t"), "left").drop("_t")


def kind_pair(a: str, b: str) -> Column:
    return F.col(a) * KINDS + F.col(b)


def kind_scores(numbers: DataFrame, similarity, least: float | None = None) -> DataFrame:
    """a, b, pair and score of all pairs of kinds, or those of a least score: KINDS * KINDS rows at most. similarity gets the names of two columns."""
    a, b = (numbers.select(F.col("t").alias(f"{x}_t"), F.col("n").alias(x)) for x in ("a", "b"))
    scores = a.repartition(16, "a").crossJoin(F.broadcast(b)).select("a", "b", kind_pair("a", "b").alias("pair"), similarity("a_t", "b_t").alias("score"))
    return staging.persisted(scores if least is None else scores.filter(F.col("score") >= least), "kind-scores")


def like_escaped(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(columns: list[str], needle: str) -> Column:
    """Case-insensitive containment in any of the columns, with wildcards of the needle taken literally."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(f"%{like_escaped(needle)}%"), F.lit(False))
    return test


def csv_safe(c: Column) -> Column:
    """A leading formula character is quoted."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def html_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(to))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
