"""Section headings of filings: classification, monotone acceptance, labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.  Annual report: (key, order, part tokens that must not occur,
#: alternatives; each a list of (text, first characters looked at or None)).
ANNUAL = [
    ("1", 0, "", [[("business", 20)]]),
    ("1A", 1, "parti", [[("risk", 15)]]),
    ("1B", 2, "parti", [[("unresolved", 20)]]),
    ("1C", 3, "parti", [[("cybersecurity", 30)]]),
    ("2", 4, "parti", [[("properties", 25)]]),
    ("3", 5, "parti", [[("legalproceedings", 25)]]),
    ("4", 6, "parti", [[("min", 25), ("safety", 25)], [("submission", 25)], [("executiveofficers", 25)]]),
    ("5", 7, "", [[("marketfor", 25)], [("marketprice", 25)]]),
    ("6", 8, "part", [[("selectedfinancial", 50)]]),
    ("6", 8, "partii", [[("reserved", 30)]]),
    ("7", 9, "partii", [[("management", None), ("sdiscussion", 100)]]),
    ("7A", 10, "partii", [[("quantitativeandqualitative", 40)], [("qualitativeandquantitative", 40)]]),
    ("8", 11, "partii", [[("financialstatements", 30)]]),
    ("9", 12, "partii", [[("changesinanddisagreements", 35)]]),
    ("9A", 13, "partii", [[("controlsandprocedures", 30)]]),
    ("9B", 14, "partii", [[("otherinfo", 20)]]),
    ("9C", 15, "partii", [[("disclosureregarding", 40)]]),
    ("10", 16, "", [[("directors", 50), ("executive", 50)], [("trustees", 50), ("executive", 50)]]),
    ("11", 17, "partiii", [[("executivecompensation", 35)]]),
    ("12", 18, "partiii", [[("securityownership", 30)]]),
    ("13", 19, "partiii", [[("certainrelationships", 30)]]),
    ("14", 20, "partiii", [[("principala", 25)]]),
]
#: Fixed values.  What differs when the text looked at is the next element's.
ANNUAL_NEXT = {"1C": [[("cybersecurity", 25)]], "8": [[("financialstatement", 30)]]}
ANNUAL_NEXT_PART = {"selectedfinancial": "partii"}
#: Fixed values.  Quarterly report, part I and part II.
QUARTERLY_1 = [
    ("1.1", 4, "", [[("financialstatement", 30)]]),
    ("1.2", 4, "", [[("management", None), ("sdiscussion", 40)]]),
    ("1.3", 4, "", [[("quantitativeandqualitative", 35)], [("qualitativeandquantitative", 35)]]),
    ("1.4", 4, "", [[("controlsandprocedures", 30)], [("controlsprocedures", 30)]]),
]
QUARTERLY_2 = [
    ("2.1", 5, "", [[("legalproceedings", 25)]]),
    ("2.1A", 6, "", [[("riskfactors", 20)]]),
    ("2.2", 7, "", [[("useofproceeds", 70)], [("unregisteredsales", 70)], [("repurchase", 40)]]),
    ("2.3", 8, "", [[("defaults", None)]]),
    ("2.4", 9, "", [[("submission", 20)], [("minesafety", 20)], [("reserved", 40)]]),
    ("2.5", 10, "part", [[("otherinformation", 25)]]),
    ("2.5", 10, "", [[("otheritems", 25)]]),
]
#: Fixed values.  Letters deleted before a rule looks.
DELETED = {"1.1": ["condensed", "consolidated"], "2.1A": ["legal"], "selectedfinancial": ["consolidated"]}
LINK_WORDS = ["and", "in", "within", "of", "under"]

RESULT = "struct<key:string,ord:int>"


def squash(text: Column) -> Column:
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit(""))


def is_heading(text: Column, before: Column) -> Column:
    """Whether a text can be an item heading, given the element before it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    head = F.substring(low, 1, 25)
    refers = head.contains("see ") | head.contains("“") | head.contains("”")
    first, last = F.split_part(F.trim(low), F.lit(" "), F.lit(1)), F.substring_index(F.trim(F.lower(F.coalesce(before, F.lit("")))), " ", -1)
    joined = first.isin(LINK_WORDS) | last.isin(LINK_WORDS)
    item = F.substring(F.replace(squash(text), F.lit("otheritems"), F.lit("")), 1, 10).contains("item")
    return ~refers & ~low.startswith(",") & ~low.endswith(",") & ~joined & item


def _ladder(text: Column, rules: list, change: dict | None = None, parts: dict | None = None) -> Column:
    out: Column | None = None
    for key, order, part, options in rules:
        word = options[0][0][0]
        seen = reduce(lambda t, gone: F.replace(t, F.lit(gone), F.lit("")), DELETED.get(key, DELETED.get(word, [])), text)
        part = (parts or {}).get(word, part)
        tests = [reduce(lambda a, b: a & b, [(F.substring(seen, 1, n) if n else seen).contains(w) for w, n in option]) for option in ((change or {}).get(key) or options)]
        test = reduce(lambda a, b: a | b, tests)
        test = test & ~text.contains(part) if part else test
        value = F.struct(F.lit(key).alias("key"), F.lit(order).alias("ord"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def classify_annual(text: Column, following: Column) -> Column:
    """Item of an annual report by a text, or by the element that follows; null on continuations."""
    a, b = squash(text), squash(following)
    more = F.right(a, F.lit(10)).contains("continued") | F.right(b, F.lit(10)).contains("continued")
    found = F.coalesce(_ladder(a, ANNUAL), _ladder(b, ANNUAL, ANNUAL_NEXT, ANNUAL_NEXT_PART))
    return F.when(~more, found)


def classify_quarterly(text: Column, following: Column) -> Column:
    """Item of a quarterly report: part I rules on both texts, then part II rules."""
    a, b = squash(text), squash(following)
    more = F.right(a, F.lit(10)).contains("continued") | F.right(b, F.lit(10)).contains("continued")
    return F.when(~more, F.coalesce(_ladder(a, QUARTERLY_1), _ladder(b, QUARTERLY_1), _ladder(a, QUARTERLY_2), _ladder(b, QUARTERLY_2)))


def accept(candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, pos, key, ord) whose order is no lower than any before."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return candidates.withColumn("_top", F.coalesce(F.max("ord").over(before), F.lit(0))).where("ord >= _top").drop("_top")


def starts(elements: DataFrame, form: str | Column = "10-Q") -> DataFrame:
    """(doc_id, key, pos, ord): where sections begin.  ``elements`` may carry has_toc."""
    form = F.lit(form) if isinstance(form, str) else form
    along = Window.partitionBy("doc_id").orderBy("pos")
    toc = F.col("has_toc") if "has_toc" in elements.columns else F.lit(False)
    df = elements.select("doc_id", "pos", "text", "has_links", toc.alias("toc"), form.alias("form"), F.lag("text").over(along).alias("before"), F.lead("text").over(along).alias("after"), F.coalesce(F.lead("has_links").over(along), F.lit(False)).alias("after_links"))
    allowed = ~(F.col("toc") & (F.col("has_links") | F.col("after_links")))
    found = F.when(F.col("form") == "10-K", classify_annual(F.col("text"), F.col("after"))).otherwise(classify_quarterly(F.col("text"), F.col("after")))
    df = df.where(allowed & is_heading(F.col("text"), F.col("before"))).withColumn("x", found).where("x is not null").select("doc_id", "pos", "form", "x.*")
    kept = accept(df).groupBy("doc_id", "key").agg(F.max("pos").alias("pos"), F.first("ord").alias("ord"))
    return kept.union(_fallback(elements, form, kept))


def _fallback(elements: DataFrame, form: Column, kept: DataFrame) -> DataFrame:
    """Section 1.1 of a quarterly report without its heading: the first mention of consolidated statements, spaces aside."""
    low = squash(F.col("text"))
    first = elements.where((form == "10-Q") & low.contains("consolidated") & low.contains("statements")).groupBy("doc_id").agg(F.min("pos").alias("pos"))
    return first.join(kept.where("key = '1.1'"), "doc_id", "left_anti").select("doc_id", F.lit("1.1").alias("key"), "pos", F.lit(1).alias("ord"))


def label(elements: DataFrame, found: DataFrame) -> DataFrame:
    """``elements`` with section, the last one that began at or before; heading rows have is_heading."""
    marks = found.groupBy("doc_id", "pos").agg(F.max_by("key", "ord").alias("_key"))
    along = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = elements.join(marks, ["doc_id", "pos"], "left").withColumn("section", F.last("_key", ignorenulls=True).over(along))
    return df.withColumn("is_heading", F.col("_key").isNotNull()).drop("_key")


def is_sorted(values: Column) -> Column:
    n = F.size(values)
    return F.when(n < 2, True).otherwise(F.forall(F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: a <= b), lambda x: x))
