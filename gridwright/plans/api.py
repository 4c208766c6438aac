"""The pipelines end to end, as lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, edits, prep, render, score, sections, style
from ..sources import html


def extract(filings: DataFrame, id_col: str = "doc_id", html_col: str = "html", with_sections: bool = False) -> DataFrame:
    """Clean tables (doc_id, tid, grid[, section]) of filings; documents without a table give none."""
    ready = filings.select(F.col(id_col).alias("doc_id"), prep.prepare(F.col(html_col)).alias("html"))
    tables = html.html_tables(ready, indents=True).select("doc_id", "tid", "grid").where(prep.has_value(F.col("grid")))
    cleaned = clean.clean_filing(tables)
    if not with_sections:
        return cleaned
    return cleaned.join(table_sections(filings, id_col, html_col), ["doc_id", "tid"], "left")


def table_sections(filings: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, tid, section) by the heading that stands last before each table."""
    ready = filings.select(F.col(id_col).cast("string").alias("doc_id"), prep.form_of(F.col(html_col)).alias("form"), prep.prepare(F.col(html_col)).alias("html"))
    elements = prep.skip_contents(html.html_elements(ready)).join(ready.select("doc_id", "form"), "doc_id")
    found = sections.starts(elements, F.col("form"))
    return sections.label(elements, found).where("tid is not null").select("doc_id", "tid", "section")


def to_csv(grids: DataFrame) -> DataFrame:
    return grids.select("doc_id", "tid", render.csv_text(F.col("grid")).alias("csv"))


def to_markdown(filings: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, tid, markdown) of the tables that are 2 x 2 or more."""
    tables = html.html_tables(filings, id_col, html_col).select("doc_id", "tid", "grid")
    df = clean.clean_markdown(tables)
    return df.select("doc_id", "tid", render.titled_markdown(F.col("titles"), F.col("tid"), F.col("grid")).alias("markdown"))


def to_styled(filings: DataFrame, output: str = "markdown", id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, tid, text): style-aware tables with footnotes joined, as Markdown or CSV."""
    grids = style.join_footnotes(style.styled_grids(html.html_tables(filings, id_col, html_col), output))
    text = render.markdown_text(F.col("grid")) if output == "markdown" else render.csv_text(F.col("grid"))
    return grids.select("doc_id", "tid", text.alias("text"))


replay = edits.replay
score_grids = score.grid_distances
score_trees = score.teds
