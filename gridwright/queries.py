"""Registered queries over the driver's tables, each with the SQL that must agree.

The tables hold no HTML tables, so grids are made from relational rows; what a
rule must give is then a plain expression over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as C
from .functions import rows as R
from .model import from_cells, spread, to_cells
from .operators import clean, edits, generate, prep, render, score, sections, style
from .plans import api
from .sources import files, html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def empty() -> Column:
    return F.array().cast("array<string>")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def S(name: str) -> Column:
    return F.col(name).cast("string")


# --- the flagship: rendered, parsed and cleaned tables of suppliers by nation ---


def supplier_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing a region: a table of its nations with supplier counts and balances."""
    per = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("cents"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(per, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    amount = F.format_number(F.abs(F.coalesce("cents", F.lit(0))), 0)
    line = F.array(F.col("n_name"), F.coalesce(S("n"), F.lit("0")), F.when(F.col("cents") < 0, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount))
    head = F.array(F.array(F.lit(""), F.lit("Suppliers"), F.lit("Balance")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_name", line.alias("line")))), lambda x: x["line"])
    grids = nations.groupBy("r_name").agg(F.concat(head, lines).alias("grid"))
    return grids.select(F.col("r_name").alias("doc_id"), F.concat(F.lit("<html><body><p>Report</p>"), render.table_html(generate.split_cells(F.col("grid"))), F.lit("</body></html>")).alias("html"))


SUPPLIER_SQL = """
with per as (select s_nationkey, count(*) n, sum(cast(round(s_acctbal * 100) as bigint)) cents from supplier group by 1),
lines as (select r_name, n_name, row_number() over (partition by r_name order by n_name) as r, coalesce(n, 0) n, coalesce(cents, 0) cents
          from nation join region on n_regionkey = r_regionkey left join per on n_nationkey = s_nationkey),
grid as (select r_name, cast(r as int) as row, n_name c0, cast(n as varchar) c1, case when cents < 0 then '(' || cast(-cents as varchar) || ')' else cast(cents as varchar) end c2 from lines
         union all select distinct r_name, 0, '', 'Suppliers', 'Balance' from lines)
"""


@query(SUPPLIER_SQL + """select r_name as doc_id, 1 as tid, row, 0 as col, c0 as value from grid union all select r_name, 1, row, 1, c1 from grid union all select r_name, 1, row, 2, c2 from grid""")
def flagship_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(api.extract(supplier_filings(spark, sf_dir))).select("doc_id", "tid", "row", "col", "value")


@query(SUPPLIER_SQL + """select r_name as doc_id, 1 as tid, string_agg(c0 || ',' || c1 || ',' || c2, chr(10) order by row) as csv from grid group by 1""")
def extract_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.to_csv(api.extract(supplier_filings(spark, sf_dir)))


@query(SUPPLIER_SQL + """, lined as (select r_name, row, '| ' || cast(row as varchar) || ' | ' || c0 || ' | ' || c1 || ' | ' || case when row = 0 then c2 when starts_with(c2, '(') then '(' || format('{:,}', try_cast(trim(c2, '()') as bigint)) || ')' else format('{:,}', try_cast(c2 as bigint)) end || ' |' as line from grid)
select r_name as doc_id, 1 as tid, '<markdown tid="1">' || chr(10) || '|  | 0 | 1 | 2 |' || chr(10) || '|:---|:---|:---|:---|' || chr(10) || string_agg(line, chr(10) order by row) || chr(10) || '</markdown>' as markdown from lined group by 1""")
def extract_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown keeps thousands signs."""
    return api.to_markdown(supplier_filings(spark, sf_dir))


@query(SUPPLIER_SQL + """select r_name as doc_id, '{"csv_tables":["' || string_agg(c0 || ',' || c1 || ',' || c2, '\\n' order by row) || '"],"table_map":[0,1]}' as body from grid group by 1""")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.response_json(api.extract(supplier_filings(spark, sf_dir)))


# --- rules for one cell or one row, over part ---

#: name: (rule over part's columns, the same in SQL)
PART: dict[str, tuple[Callable[[], Column], str]] = {}


def row(*cells: Column | str) -> Column:
    return F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])


def joined(cells: Column) -> Column:
    return F.array_join(cells, "|")


def even(a: str, b: str) -> Column:
    return F.when(F.col("p_partkey") % 2 == 0, a).otherwise(b)


def _sql_even(a: str, b: str) -> str:
    return f"(case when p_partkey % 2 = 0 then {a} else {b} end)"


def _cents() -> Column:
    return F.round(F.col("p_retailprice") * 100).cast("long")


CENTS = "cast(round(p_retailprice * 100) as bigint)"
PART |= {
    "strip_dollar": (lambda: C.strip_dollar(F.concat(F.lit("$ "), S("p_size"), F.lit("$"))), "' ' || cast(p_size as varchar)"),
    "strip_dot_zero": (lambda: C.strip_dot_zero(F.concat(S("p_size"), even(".0", ".05"))), f"cast(p_size as varchar) || {_sql_even(repr(''), repr('.05'))}"),
    "tighten_paren": (lambda: C.tighten_paren(F.concat(F.lit("( "), S("p_size"), F.lit(" )"))), "'(' || cast(p_size as varchar) || ' )'"),
    "thousands": (lambda: C.drop_thousands(F.concat(F.lit("("), F.format_number(_cents(), 0), even(")", ".5)"))), f"'(' || {_sql_even(f'cast({CENTS} as varchar)', f'''format('{{:,}}', {CENTS})''')} || {_sql_even(repr(')'), repr('.5)'))}"),
    "digit_commas": (lambda: C.digit_commas(F.concat(F.format_number(_cents(), 0), F.lit(", a,b"))), f"cast({CENTS} as varchar) || ', a,b'"),
    "clean_space": (lambda: C.clean_space(F.concat(F.lit("  a\n "), F.col("p_name"), F.lit(" \t"), F.col("p_brand"), F.lit("  "))), "'a ' || p_name || ' ' || p_brand"),
    "collapse_spaces": (lambda: C.collapse_spaces(F.concat(F.lit("&nbsp;&nbsp;x   "), F.col("p_brand"))), "' x ' || p_brand"),
    "shown_spaces": (lambda: C.shown_spaces(F.concat(F.lit("   "), F.col("p_brand"), F.lit("  z"))), "repeat(chr(160), 3) || p_brand || '  z'"),
    "text_transform": (lambda: C.transform_text(F.col("p_name"), even("uppercase", "none")), _sql_even("upper(p_name)", "p_name")),
    "emphasis_marks": (lambda: C.emphasise(F.col("p_brand"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0), "(case when p_size % 3 = 0 then '*' else '' end) || (case when p_size % 2 = 0 then '**' else '' end) || p_brand || (case when p_size % 2 = 0 then '**' else '' end) || (case when p_size % 3 = 0 then '*' else '' end)"),
    "bold_toggle": (lambda: C.toggle_bold(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<b>"), F.col("p_brand"), F.lit("</b>"))).otherwise(F.col("p_brand"))), "case when p_size % 2 = 0 then p_brand else '<b>' || p_brand || '</b>' end"),
    "css_lookup": (lambda: C.css_value(F.concat(F.lit("margin:1pt 2pt; text-align: "), even("right", "left"), F.lit(" ;margin-left:"), S("p_size"), F.lit("pt")), "text-align"), _sql_even("'right'", "'left'")),
    "css_points": (lambda: C.css_points(F.concat(F.lit("margin:1pt 2pt;margin-left:0 "), S("p_size"), F.lit("pt")), "margin-left").cast("int").cast("string"), "cast(p_size as varchar)"),
    "judge_comma": (lambda: C.same_cell(F.format_number(_cents(), 0), F.concat(_cents().cast("string"), even("", "1")), True).cast("string"), _sql_even("'true'", "'false'")),
    "csv_field": (lambda: C.csv_field(F.concat(F.col("p_brand"), even(', "x"', " y"))), _sql_even("'\"' || p_brand || ', \"\"x\"\"\"'", "p_brand || ' y'")),
    "range_syntax": (lambda: F.to_json(C.cell_range(F.concat(F.lit("[1:"), S("p_size"), F.lit(", 0:3]")))), "'{\"r0\":1,\"r1\":' || cast(p_size as varchar) || ',\"c0\":0,\"c1\":3}'"),
    "paragraph_indent": (lambda: F.length(prep.paragraph_indent(F.col("p_size"))).cast("string"), "cast(case when p_size < 12 then 0 else (p_size - 12) // 12 * 4 end as varchar)"),
    "division_indent": (lambda: F.length(prep.division_indent(F.col("p_size"))).cast("string"), "cast(cast(floor(p_size / 6.75) * 4 as bigint) as varchar)"),
    "glue_paren": (lambda: joined(R.glue_paren(row(F.col("p_brand"), F.concat(F.lit("("), S("p_size")), even(")", "x"), "y"))), f"p_brand || '|(' || cast(p_size as varchar) || {_sql_even(repr(')||y'), repr('|x|y'))}"),
    "glue_percent": (lambda: joined(R.glue_percent(row(F.col("p_brand"), S("p_size"), even("%", "x")))), f"p_brand || '|' || cast(p_size as varchar) || {_sql_even(repr('%|'), repr('|x'))}"),
    "footnote_glue": (lambda: joined(R.glue_footnote(row(F.col("p_brand"), even("(a)", "(ab)"), S("p_size")))), f"p_brand || {_sql_even(repr('(a)|'), repr('|(ab)'))} || '|' || cast(p_size as varchar)"),
    "enum_shift": (lambda: joined(R.shift_enumerator(row(F.col("p_brand"), even("a)", "b"), S("p_size"), "z"))), f"p_brand || {_sql_even(repr('|a) '), repr('|b|'))} || cast(p_size as varchar) || '|z' || {_sql_even(repr('|'), repr(''))}"),
    "dash_merge_row": (lambda: joined(R.merge_dash(row(F.col("p_brand"), S("p_size"), even(C.DASH, "to"), F.col("p_type")))), f"p_brand || '|' || cast(p_size as varchar) || {_sql_even(repr(' - '), repr('|to|'))} || p_type || {_sql_even(repr('||'), repr(''))}"),
    "dash_trailing": (lambda: joined(R.trailing_dash(row(F.col("p_brand"), S("p_size"), even(C.DASH, "x")))), f"p_brand || '|' || cast(p_size as varchar) || {_sql_even(repr('–|'), repr('|x'))}"),
    "row_sweep": (lambda: joined(R.sweep(row(F.col("p_brand"), "$", F.concat(F.lit("( "), F.format_number(_cents(), 0)), ")", "7.0", "%", "a)", "note", "(b)"))), f"p_brand || '||(' || cast({CENTS} as varchar) || ')||7%||a) note(b)||'"),
    "left_compact": (lambda: joined(R.left_compact(row(F.col("p_brand"), "", S("p_size"), "", "3.0"), F.lit(1))), "p_brand || '|' || cast(p_size as varchar) || '|3||'"),
    "header_spread": (lambda: joined(R.spread_header(row("", F.col("p_brand"), "", F.col("p_type"), ""), F.lit(1))), "'|' || p_brand || '|' || p_brand || '|' || p_type || '|' || p_type"),
    "emphasis_glue": (lambda: joined(R.glue_emphasis(row(F.concat(F.lit("**"), F.col("p_brand"), F.lit("**")), "**(a)**", "**5**", "**)**"))), "'**' || p_brand || '(a)**||**5)**|'"),
    "emphasis_dash": (lambda: joined(R.glue_emphasis(row(F.col("p_brand"), "1", C.DASH, S("p_size")))), "p_brand || '|||1–' || cast(p_size as varchar)"),
    "colspan_expand": (lambda: joined(R.expand_colspan(row(F.col("p_brand"), "x"), F.array(F.col("p_size") % 3, F.lit(2)))), "repeat(p_brand || '|', greatest(p_size % 3, 1)) || 'x|x'"),
    "indent_level": (lambda: F.array_join(style.indent_levels(F.array(F.lit(0.0), F.col("p_size").cast("double"), F.lit(60.0), F.lit(0.0))).cast("array<string>"), ","), "case when p_size = 60 then '0,1,1,0' when p_size > 60 then '0,2,1,0' else '0,1,2,0' end"),
    "indent_prefix": (lambda: F.concat(style.level_prefix((F.col("p_size") % 3).cast("int")), F.col("p_brand")), "repeat('&nbsp;&nbsp;', p_size % 3 * 2) || p_brand"),
    "is_sorted": (lambda: sections.is_sorted(F.array(F.lit(1), F.col("p_size"), F.lit(25))).cast("string"), "cast(p_size between 1 and 25 as varchar)"),
    "newline_html": (lambda: render.newline_html(F.concat(F.col("p_brand"), F.lit("\n\n"), S("p_size")), (F.col("p_partkey") % 3).cast("int")), "case p_partkey % 3 when 0 then p_brand || chr(10) || chr(10) || cast(p_size as varchar) when 1 then p_brand || '<br><br>' || cast(p_size as varchar) else p_brand || '<p>&nbsp;</p>' || cast(p_size as varchar) end"),
    "glue_columns": (lambda: joined(render.glue_columns(row(F.col("p_brand"), "b", "c", "d"), F.lit(2), True)), "p_brand || '|b| |c|d| '"),
    "spare_column": (lambda: F.replace(joined(render.spare_column(row(F.col("p_brand"), "b"), (F.col("p_size") % 3).cast("int"))), F.lit(C.NBSP), F.lit("_")), "case p_size % 3 when 0 then '_|' || p_brand || '|b' when 1 then p_brand || '|_|b' else p_brand || '|b|_' end"),
    "total_rule": (lambda: render.total_rule(F.concat(even("Net ", "Gross "), F.col("p_brand"))), _sql_even("'<u>Net ' || p_brand || '</u>'", "'Gross ' || p_brand")),
    "edited_name": (lambda: render.edited_name(F.concat(F.col("p_brand"), F.lit(".csv"))), "p_brand || '_edited.csv'"),
    "log_folder": (lambda: files.log_folder(F.concat(F.lit("/x/edit_log_"), S("p_size"), F.lit(".json"))), "cast(p_size as varchar)"),
    "dom_id": (lambda: prep.dom_id(F.col("p_size")), "'table-' || cast(p_size - 1 as varchar)"),
}


def _part_query(name: str, rule: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "part").select("p_partkey", rule().alias("value"))

    run.__name__ = name
    query(f"select p_partkey, {sql} as value from part")(run)


for _name, (_rule, _sql) in PART.items():
    _part_query(_name, _rule, _sql)


# --- rules for whole grids, over customer: (c_custkey, grid), compared as CSV text ---

GRID_RULES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "drop_empty_cols": (clean.drop_empty_cols, "case when c_custkey % 3 = 0 then 'h,a' || chr(10) || ',' || chr(10) || c_name || ',1' else 'h,,a' || chr(10) || ',,' || chr(10) || c_name || ',x,1' end"),
    "drop_empty_rows": (clean.drop_empty_rows, "'h,,a' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',,1' else ',x,1' end"),
    "drop_body_empty_cols": (lambda g: clean.drop_body_empty_cols(F.concat(g, F.array(row("t", "", "")))), "'h' || chr(10) || '' || chr(10) || c_name || chr(10) || 't'"),
    "size_gate": (lambda g: F.array(row(F.when(clean.big_enough(F.when(F.col("c_custkey") % 3 == 0, F.slice(g, 1, 1)).when(F.col("c_custkey") % 3 == 1, F.transform(g, lambda r: F.slice(r, 1, 1))).otherwise(g)), "kept").otherwise("gone"))), "case when c_custkey % 3 = 2 then 'kept' else 'gone' end"),
    "title_rows": (lambda g: F.array(row(clean.title_rows(F.concat(F.array(row("A title", "", ""), row(F.when(F.col("c_custkey") % 3 == 0, "Year Ended").otherwise("Second"), "", "")), g)).cast("string"))), "case when c_custkey % 3 = 0 then '1' else '2' end"),
    "data_offset": (lambda g: F.array(row(clean.data_offset(F.concat(g, F.when(F.col("c_custkey") % 3 == 0, F.array(row("", "", "9"))).when(F.col("c_custkey") % 3 == 1, F.array(row("", "", ""))).otherwise(g))).cast("string"))), "case c_custkey % 3 when 0 then '3' when 1 then '0' else '1' end"),
    "markdown_table": (lambda g: F.array(row(F.replace(render.markdown_text(g), F.lit("\n"), F.lit("/")))), "'|  | 0 | 1 | 2 |/|:---|:---|:---|:---|/| 0 | h |  | a |/| 1 |  |  |  |/| 2 | ' || c_name || case when c_custkey % 3 = 0 then ' |  | 1 |' else ' | x | 1 |' end"),
    "width_ratios": (lambda g: F.array(row(F.array_join(F.transform(render.column_widths(g), lambda w: w.cast("decimal(5,1)").cast("string")), " "))), "case when c_custkey % 3 = 0 then '47.9 4.1 47.9' else '33.3 33.3 33.3' end"),
    "bold_range": (lambda g: edits.bold_range(g, _rng(0, 1, 0, 2)), "'<b>h</b>,<b></b>,a' || chr(10) || ',,' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',,1' else ',x,1' end"),
    "indent_range": (lambda g: edits.indent_range(g, _rng(2, 3, 0, 1)), "'h,,a' || chr(10) || ',,' || chr(10) || '    ' || c_name || case when c_custkey % 3 = 0 then ',,1' else ',x,1' end"),
    "cut_range": (lambda g: edits.cut_range(g, _rng(0, 3, 1, 3)), "'h,,' || chr(10) || ',,' || chr(10) || c_name || ',,'"),
    "copy_paste_range": (lambda g: edits.paste_range(g, _rng(1, 2, 0, 3), edits.copy_range(g, _rng(0, 1, 0, 3))), "'h,,a' || chr(10) || 'h,,a' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',,1' else ',x,1' end"),
    "remove_row": (lambda g: edits.remove_rows(g, F.lit(2), F.lit(1)), "'h,,a' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',,1' else ',x,1' end"),
    "remove_col": (lambda g: edits.remove_cols(empty(), g, F.lit(1), F.lit(5))[1], "'h' || chr(10) || '' || chr(10) || c_name"),
    "add_row": (lambda g: edits.add_rows(row("", "", ""), g, F.lit(1), F.lit(1)), "',,' || chr(10) || 'h,,a' || chr(10) || ',,' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',,1' else ',x,1' end"),
    "add_col": (lambda g: edits.add_cols(empty(), g, F.lit(1), F.lit(1))[1], "'h,,,a' || chr(10) || ',,,' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',,,1' else ',,x,1' end"),
    "edit_cell": (lambda g: edits.edit_cell(empty(), g, F.lit(1), F.lit(1), F.col("c_mktsegment"))[1], "'h,' || c_mktsegment || ',a' || chr(10) || ',,' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',,1' else ',x,1' end"),
    "merge_rows": (lambda g: edits.merge_rows(g, F.lit(1)), "'h,,a' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',,1' else ',x,1' end"),
    "merge_cols": (lambda g: edits.merge_cols(empty(), g, F.lit(1))[1], "'h,a' || chr(10) || ',' || chr(10) || c_name || case when c_custkey % 3 = 0 then ',1' else ',x 1' end"),
}


def _rng(r0: int, r1: int, c0: int, c1: int) -> Column:
    return F.struct(F.lit(r0).alias("r0"), F.lit(r1).alias("r1"), F.lit(c0).alias("c0"), F.lit(c1).alias("c1"))


def customer_grid() -> Column:
    return F.array(row("h", "", "a"), row("", "", ""), row(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("x"), "1"))


def _grid_query(name: str, rule: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "customer").withColumn("grid", customer_grid())
        return df.select("c_custkey", render.csv_text(rule(F.col("grid"))).alias("csv"))

    run.__name__ = name
    query(f"select c_custkey, {sql} as csv from customer")(run)


for _name, (_grid_rule, _sql) in GRID_RULES.items():
    _grid_query(_name, _grid_rule, _sql)


@query("select n_regionkey as tid, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int) as row, unnest([0, 1]) as col, unnest([n_name, cast(n_nationkey as varchar)]) as value from nation")
def grid_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(nation_grids(spark, sf_dir))


def nation_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("n_nationkey", F.array("n_name", S("n_nationkey")).alias("line"))
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("tid")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("grid"))


NATION_CSV = "select n_regionkey as tid, string_agg(n_name || ',' || cast(n_nationkey as varchar), chr(10) order by n_nationkey) as csv from nation group by 1"


@query(NATION_CSV)
def grid_unmelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_cells(to_cells(nation_grids(spark, sf_dir)), "tid").select("tid", render.csv_text(F.col("grid")).alias("csv"))


@query(NATION_CSV)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered as CSV and parsed again as ragged strings."""
    texts = nation_grids(spark, sf_dir).select("tid", render.csv_text(F.col("grid")).alias("text"))
    return files.csv_grids(texts, "tid").select(F.col("doc_id").cast("int").alias("tid"), render.csv_text(F.col("grid")).alias("csv"))


@query("""select n_regionkey as tid, '<table style="border-collapse:collapse">' || '<caption>R' || n_regionkey || '</caption>' || string_agg(case when k = 1 then '<tr><th style="font-weight:bold">' || n_name || '</th><th style="font-weight:bold">' || n_nationkey || '</th></tr>' else '<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>' end, '' order by n_nationkey) || '</table>' as html from (select *, row_number() over (partition by n_regionkey order by n_nationkey) k from nation) group by 1""")
def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_grids(spark, sf_dir).select("tid", render.table_html(F.col("grid"), F.concat(F.lit("R"), S("tid"))).alias("html"))


@query("""with t as (select n_regionkey as tid, '<table style="border-collapse:collapse">' || string_agg(case when k = 1 then '<tr><th style="font-weight:bold">' || n_name || '</th><th style="font-weight:bold">' || n_nationkey || '</th></tr>' else '<tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>' end, '' order by n_nationkey) || '</table>' as html from (select *, row_number() over (partition by n_regionkey order by n_nationkey) k from nation) group by 1)
select case when tid % 2 = 0 then 'even' else 'odd' end as name, '<!DOCTYPE html><html><head><meta charset=''utf-8''></head><body>' || chr(10) || string_agg(html, chr(10) order by tid) || chr(10) || '</body></html>' as html from t group by 1""")
def document_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of two or three tables each."""
    name = F.when(F.col("tid") % 2 == 0, "even").otherwise("odd")
    return render.document_html(nation_grids(spark, sf_dir).select(name.alias("name"), S("tid").alias("path"), render.table_html(F.col("grid")).alias("html")), "name")


_RULED = """'<tr style="border-bottom:0.75pt solid ' || case when k % 2 = 0 then '#000' else 'transparent' end || '">'"""


@query(f"""select n_regionkey as tid, '<table style="border-collapse:collapse;white-space:pre-line">' || string_agg({_RULED} || case when k = 1 then '<th style="font-weight:bold">' || n_name || '</th><th style="font-weight:bold">a<br>&amp;b</th></tr>' else '<td>' || n_name || '</td><td>' || case when k % 2 = 0 then 'Net&lt;' else 'Network' end || '</td></tr>' end, '' order by n_nationkey) || '</table>' as html from (select *, row_number() over (partition by n_regionkey order by n_nationkey) k from nation) group by 1""")
def ruled_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with rules, black below totals; line ends as breaks; everything else escaped."""
    grid = F.transform("grid", lambda r, i: F.array(F.get(r, F.lit(0)), F.when(i == 0, "a\n&b").when(i % 2 == 1, "Net<").otherwise("Network")))
    return nation_grids(spark, sf_dir).select("tid", render.table_html(grid, lines=F.lit(1), rules=True).alias("html"))


@query("select c_custkey, c_name || ',,1200' || chr(10) || 'x,(5),' as csv from customer")
def sweep_without_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids without a dash are swept and never enter Python."""
    df = table(spark, sf_dir, "customer").withColumn("grid", F.array(row(F.col("c_name"), "$", "1,200"), row("x", "(5", ")")))
    return clean.sweep_rows(df).select("c_custkey", render.csv_text(F.col("grid")).alias("csv"))


def swept(spark: SparkSession, sf_dir: str, *rows: Column) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    up = clean.sweep_rows(parts.select("p_partkey", F.array(*rows).alias("grid")))
    return up.select("p_partkey", render.csv_text(F.col("grid")).alias("csv"))


@query("select p_partkey, ',h,,,' || chr(10) || ',' || p_brand || ',1- 2,,' || chr(10) || ',b,3- 4,,' || chr(10) || ',c,5 - 6,,' as csv from part")
def dash_merge_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dash in one row joins the two columns of the rows above as well."""
    return swept(spark, sf_dir, row("", "h", "", "", ""), row(F.lit(""), F.col("p_brand"), "1", "", "2"), row("", "b", "3", "", "4"), row("", "c", "5", C.DASH, "6"))


@query("select p_partkey, ',,x - y,,' || chr(10) || 'h,,,,' || chr(10) || p_brand || ',,1,,2' as csv from part")
def dash_row0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dash in the first row has no rows above: the others stay."""
    return swept(spark, sf_dir, row("", "", "x", C.DASH, "y"), row("h", "", "", "", ""), row(F.col("p_brand"), "", "1", "", "2"))


@query("select p_partkey, 'h,,,,' || chr(10) || p_brand || ',,1- 2,,' || chr(10) || 'b,,3 - 4,,' as csv from part")
def dash_after_dollar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row above is read as swept: a dollar sign alone leaves a gap."""
    return swept(spark, sf_dir, row("h", "", "", "", ""), row(F.col("p_brand"), "", "1", "$", "2"), row("b", "", "3", C.DASH, "4"))


@query("select p_partkey, 'h,,,,,,' || chr(10) || p_brand || ',,1- 2,,,x,4' || chr(10) || 'a,,5- 6,,- 8,,' || chr(10) || 'b,,5 - 6,, - 8,,' as csv from part")
def dash_two_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges in a row: each goes up on its own until its gap is filled."""
    return swept(spark, sf_dir, row("h", "", "", "", "", "", ""), row(F.col("p_brand"), "", "1", "", "2", "x", "4"), row("a", "", "5", "", "6", "", "8"), row("b", "", "5", C.DASH, "6", C.DASH, "8"))


# --- pages: preparation of HTML ---


@query("select page_id, regexp_replace('<ix:header>x</ix:header>' || html, '(?is)<ix:header.*?</ix:header>', '', 'g') as html from pages")
def doc_header_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", prep.drop_header_blocks(F.concat(F.lit("<ix:header>x</ix:header>"), F.col("html"))).alias("html"))


@query("select page_id, html from pages")
def doc_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", prep.unwrap_inline(F.concat(F.lit('<ix:nonnumeric id="1">'), F.col("html"), F.lit("</ix:nonNumeric>"))).alias("html"))


@query("select page_id, case when regexp_matches(html, '(?is)<html.*?</html>') then regexp_extract(html, '(?is)(<html.*?</html>)', 1) else html end as html from pages")
def doc_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", prep.clip_document(F.col("html")).alias("html"))


@query(r"select page_id, trim(regexp_replace(html, '[\s\x{00a0}\x0b]+', ' ', 'g')) as html from pages")
def doc_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.clean_space(F.col("html")).alias("html"))


#: Blocks of the pages by text replacement alone: every block tag ends a text, br is a space, other tags are nothing.
_BLOCKS_SQL = r"""with bare as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!.*?>', '', 'g'), '(?i)<br[^>]*>', ' ', 'g'), '(?i)<a [^>]*href[^>]*>', chr(3), 'g') as t from pages),
marked as (select page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<(p|div|h[1-6]|li|title|td|th|caption|pre|blockquote)( [^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(p|div|h[1-6]|li|title|td|th|caption|pre|blockquote) *>', chr(1) || chr(2), 'g'), '<[^>]*>', '', 'g') as t from bare),
parts as (select page_id, unnest(string_split(t, chr(1))) as part, generate_subscripts(string_split(t, chr(1)), 1) as n from marked),
blocks as (select page_id, n, case when contains(part, chr(2)) then split_part(part, chr(2), 1) else '' end as tag, contains(part, chr(3)) as has_links,
 trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(case when contains(part, chr(2)) then split_part(part, chr(2), 2) else part end, chr(3), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '[\s\x{00a0}]+', ' ', 'g')) as text from parts),
el as (select page_id, cast(row_number() over (partition by page_id order by n) - 1 as int) as pos, tag, text, has_links from blocks where text <> '')
"""


@query(_BLOCKS_SQL + """select cast(page_id as varchar) as doc_id, pos, 0 as page, case when tag in ('h1','h2','h3','h4','h5','h6','title') then 'Title' when tag = 'li' then 'ListItem' else 'Text' end as category, tag, text, has_links, cast(null as int) as tid from el""")
def doc_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_elements(table(spark, sf_dir, "pages"), "page_id")


@query("select page_id, case when page_id % 3 < 2 then '10-K' else '10-Q' end as form from pages")
def form_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a tag of its own, by the form that is named first, or by none."""
    k = F.col("page_id") % 3
    lead = F.when(k == 0, "<10K>").when(k == 1, "<p>FORM&nbsp;10-K</p><p>not Form 10-Q</p>").otherwise("<p>reform 10-K</p><p>Form 10-Q</p><p>Form 10-K</p>")
    return table(spark, sf_dir, "pages").select("page_id", prep.form_of(F.concat(lead, F.col("html"))).alias("form"))


@query("select page_id, case when page_id % 2 = 0 then '10-K' else '10-Q' end as form from pages")
def form_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form stands behind 30,000 characters of a header that names the other one."""
    other, own = (F.when(F.col("page_id") % 2 == k, "Form 10-K ").otherwise("Form 10-Q ") for k in (1, 0))
    text = F.concat(F.lit("<html><ix:header>"), F.repeat(other, F.lit(3000)), F.lit("</ix:header><p>"), own, F.lit("</p>"), F.repeat(F.lit("x "), F.lit(12000)), F.lit("</html>"))
    return table(spark, sf_dir, "pages").select("page_id", prep.form_of(text).alias("form"))


@query(_BLOCKS_SQL + """select cast(page_id as varchar) as doc_id, pos, 'tag' || pos as anchor, array_to_string(string_split(text, ' ')[1:10], ' ') as words from (select *, count(*) over (partition by page_id, text) as times from el) where times = 1 and pos % 6 = 0""")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.anchors(html.html_elements(table(spark, sf_dir, "pages"), "page_id"))


@query("""select n_name as doc_id, '<html><body><p id="tag0" class="a">' || n_name || ' zero</p><p>1</p><p>2</p><p>3</p><p>4</p><p>5</p><div>six and<b>more</b></div><p>7</p><p>8</p><p>9</p><p>10</p><p>11</p><p>twice</p><p>13</p><p>14</p><p>15</p><p>16</p><p>twice</p><div id="tag1"><i>a b</i></div></body></html>' as html from nation""")
def anchored_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 0, 6, 12 and 18: the first words of block 6 are cut by a tag, 12 occurs twice, 18 begins behind a tag within."""
    texts = [F.lit('<html><body><p class="a">'), F.col("n_name"), F.lit(" zero</p>" + "".join(f"<p>{k}</p>" for k in range(1, 6)) + "<div>six and<b>more</b></div>" + "".join(f"<p>{k}</p>" for k in range(7, 12)) + "<p>twice</p>" + "".join(f"<p>{k}</p>" for k in range(13, 17)) + "<p>twice</p><div><i>a b</i></div></body></html>")]
    return html.anchored(table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_id"), F.concat(*texts).alias("html")))


@query("""select page_id, 1 as tid, 'page,url,views' || chr(10) || page_id || ',' || url || ',' || page_id * 1000 || chr(10) || 'sum,,' || '(7)' as csv from pages""")
def tables_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a table at its end, its cells split as filings do."""
    grid = F.array(row("page", "url", "views"), F.array(S("page_id"), F.col("url"), F.format_number(F.col("page_id") * 1000, 0)), row("sum", "", "(7)"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.replace(F.replace("html", F.lit("</body>"), F.lit("")), F.lit("</html>"), F.lit("")), render.table_html(generate.split_cells(grid)), F.lit("</html>")).alias("html"))
    found = api.extract(pages, "page_id")
    return found.select(F.col("doc_id").cast("long").alias("page_id"), "tid", render.csv_text(F.col("grid")).alias("csv"))


@query("""select n_name as doc_id, 1 as tid, n_name || ',2020' || chr(10) || 'a,1' || chr(10) || ' b,2' || chr(10) || 'c,3' || chr(10) || ' d,4' as csv from nation""")
def extract_indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of paragraphs 24 points in, or of divisions with a text indent, keep one space of it."""
    line = "<tr><td>{}</td><td>{}</td></tr>"
    body = [("<p style='margin-left:12pt;'>a</p>", 1), ("<p style='color:red;margin-left:24pt;'>b</p>", 2), ("<div style='text-indent:6pt'>c</div>", 3), ("<div style='text-indent:13.5pt'>d</div>", 4)]
    text = F.concat(F.lit("<html><body><table><tr><td>"), F.col("n_name"), F.lit("</td><td>2020</td></tr>" + "".join(line.format(*x) for x in body) + "</table></body></html>"))
    return api.to_csv(api.extract(table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_id"), text.alias("html"))))


# --- sections, over headings made for every nation ---

HEADINGS = ["Cover page", "Item 1. Financial Statements", "consolidated balance sheets", "Item 2. Management's Discussion and Analysis", "see Item 3 below", "Item 3. Quantitative and Qualitative Disclosures", "Item 4. Controls and Procedures", "PART II", "Item 1. Legal Proceedings", "Item 1A. Risk Factors", "Item 2. Unregistered Sales of Equity", "Item 1. Financial Statements (continued)", "Item 5. Other Information", "signatures"]
ANNUAL_HEADINGS = ["Annual report", "Item 1. Business", "Item 1A. Risk Factors", "Item 1B. Unresolved Staff Comments", "Item 2. Properties", "Item 3. Legal Proceedings", "Item 5. Market for Registrant's Equity", "Item 7. Management's Discussion", "Item 7A. Quantitative and Qualitative", "Item 8. Financial Statements", "Item 9A. Controls and Procedures", "Item 10. Directors and Executive Officers", "Item 11. Executive Compensation", "Item 14. Principal Accountant Fees"]


def elements_of(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    lines = F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("pos", "text")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_id"), lines).withColumn("has_links", F.lit(False))


def _sql_lines(texts: list[str]) -> str:
    values = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(texts))
    return f"el as (select n_name as doc_id, cast(pos as int) as pos, text, coalesce(lag(text) over w, '') as bef, coalesce(lead(text) over w, '') as aft from nation, (values {values}) v(pos, text) window w as (partition by n_name order by pos))"


_GUARD_SQL = """(not (substr(lower(text), 1, 25) like '%see %' or substr(text, 1, 25) like '%“%' or substr(text, 1, 25) like '%”%')
 and not starts_with(text, ',') and not ends_with(text, ',')
 and split_part(trim(lower(text)), ' ', 1) not in ('and','in','within','of','under') and coalesce(list_extract(string_split(trim(lower(bef)), ' '), -1), '') not in ('and','in','within','of','under')
 and contains(substr(replace(replace(lower(text), ' ', ''), 'otheritems', ''), 1, 10), 'item'))"""


def _sql_ladder(text: str, rules: list, change: dict | None = None, parts: dict | None = None) -> str:
    """The ladder as a SQL case that gives key:order."""
    out = []
    for key, order, part, options in rules:
        word = options[0][0][0]
        seen = f"replace(lower({text}), ' ', '')"
        plain = seen
        for gone in sections.DELETED.get(key, sections.DELETED.get(word, [])):
            seen = f"replace({seen}, '{gone}', '')"
        part = (parts or {}).get(word, part)
        test = " or ".join("(" + " and ".join(f"contains({f'substr({seen}, 1, {n})' if n else seen}, '{w}')" for w, n in option) + ")" for option in ((change or {}).get(key) or options))
        out.append(f"when ({test})" + (f" and not contains({plain}, '{part}')" if part else "") + f" then '{key}:{order}'")
    return "(case " + " ".join(out) + " end)"


_NOT_MORE = "not (right(replace(lower(text), ' ', ''), 10) like '%continued%' or right(replace(lower(aft), ' ', ''), 10) like '%continued%')"
_QUARTERLY_SQL = f"case when {_NOT_MORE} then coalesce({_sql_ladder('text', sections.QUARTERLY_1)}, {_sql_ladder('aft', sections.QUARTERLY_1)}, {_sql_ladder('text', sections.QUARTERLY_2)}, {_sql_ladder('aft', sections.QUARTERLY_2)}) end"
_ANNUAL_SQL = f"case when {_NOT_MORE} then coalesce({_sql_ladder('text', sections.ANNUAL)}, {_sql_ladder('aft', sections.ANNUAL, sections.ANNUAL_NEXT, sections.ANNUAL_NEXT_PART)}) end"


def _around(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    return df.withColumn("bef", F.lag("text").over(w)).withColumn("aft", F.lead("text").over(w))


def _key_of(x: Column) -> Column:
    return F.concat(x["key"], F.lit(":"), x["ord"].cast("string"))


@query(f"with {_sql_lines(HEADINGS)} select doc_id, pos, {_GUARD_SQL} as ok from el")
def section_title_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(elements_of(spark, sf_dir, HEADINGS)).select("doc_id", "pos", sections.is_heading(F.col("text"), F.col("bef")).alias("ok"))


@query(f"with {_sql_lines(HEADINGS)} select doc_id, pos, {_QUARTERLY_SQL} as found from el")
def classify_10q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(elements_of(spark, sf_dir, HEADINGS)).select("doc_id", "pos", _key_of(sections.classify_quarterly(F.col("text"), F.col("aft"))).alias("found"))


@query(f"with {_sql_lines(ANNUAL_HEADINGS)} select doc_id, pos, {_ANNUAL_SQL} as found from el")
def classify_10k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(elements_of(spark, sf_dir, ANNUAL_HEADINGS)).select("doc_id", "pos", _key_of(sections.classify_annual(F.col("text"), F.col("aft"))).alias("found"))


@query("select n_name as doc_id, '1.1' as key, 1 as pos, 1 as ord from nation")
def section_fallback_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without its heading, section 1.1 begins at a title that letterspacing has pulled apart."""
    texts = ["Quarterly report", "C O N S O L I D A T E D  balance sheet  S T A T E M E N T S", "consolidated statements again"]
    return sections.starts(elements_of(spark, sf_dir, texts), "10-Q").select("doc_id", "key", "pos", "ord")


#: Every rung of the annual ladder, by a text or the one that follows, with what it must give.
RUNGS = [
    ("Item 1. Business", "", "1:0"),
    ("Item 1A. Risk Factors", "", "1A:1"),
    ("Item 1B. Unresolved Staff Comments", "", "1B:2"),
    ("Item 1C. Cybersecurity", "", "1C:3"),
    ("Item 2. Properties", "", "2:4"),
    ("Item 3. Legal Proceedings", "", "3:5"),
    ("Item 4. Mine Safety Disclosures", "", "4:6"),
    ("Item 4. Submission of Matters to a Vote", "", "4:6"),
    ("Item 4. Executive Officers of the Registrant", "", "4:6"),
    ("Item 5. Market for Registrant's Common Equity", "", "5:7"),
    ("Item 5. Market Price of Shares", "", "5:7"),
    ("Item 6. Selected Financial Data", "", "6:8"),
    ("Item 6. [Reserved]", "", "6:8"),
    ("Item 7. Management's Discussion and Analysis", "", "7:9"),
    ("Item 7A. Quantitative and Qualitative Disclosures", "", "7A:10"),
    ("Item 7A. Qualitative and Quantitative Disclosures", "", "7A:10"),
    ("Item 8. Financial Statements and Supplementary Data", "", "8:11"),
    ("Item 9. Changes in and Disagreements with Accountants", "", "9:12"),
    ("Item 9A. Controls and Procedures", "", "9A:13"),
    ("Item 9B. Other Information", "", "9B:14"),
    ("Item 9C. Disclosure Regarding Foreign Jurisdictions", "", "9C:15"),
    ("Item 10. Directors, Executive Officers and Governance", "", "10:16"),
    ("Item 10. Trustees and Executive Officers", "", "10:16"),
    ("Part II Item 10. Directors and Executive Officers", "", "10:16"),
    ("Part III Item 10. Directors and Executive Officers", "", "10:16"),
    ("Item 11. Executive Compensation", "", "11:17"),
    ("Item 12. Security Ownership", "", "12:18"),
    ("Item 13. Certain Relationships", "", "13:19"),
    ("Item 14. Principal Accountant Fees", "", "14:20"),
    ("Item 1.", "Business", "1:0"),
    ("Item 1C.", "Cybersecurity", "1C:3"),
    ("Item 6.", "Selected Consolidated Financial Data", "6:8"),
    ("Item 8.", "Financial Statements", "8:11"),
    ("Item 10.", "Directors and Executive Officers", "10:16"),
    ("Item 14.", "Principal Accountant Fees", "14:20"),
    ("Part I Item 2. Properties", "", None),
    ("Part II Item 9A. Controls and Procedures", "", None),
    ("Part III Item 11. Executive Compensation", "", None),
    ("Item 8. Financial Statements continued", "", None),
    ("Item 15. Exhibits", "Signatures", None),
]


def _rung_sql() -> str:
    values = ", ".join(f"({k}, {'null' if want is None else repr(want)})" for k, (*_, want) in enumerate(RUNGS))
    return f"select r_name as doc_id, cast(pos as int) as pos, found from region, (values {values}) v(pos, found)"


@query(_rung_sql())
def classify_10k_all_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode(F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("aft")) for a, b, _ in RUNGS])).alias("pos", "x")
    el = table(spark, sf_dir, "region").select(F.col("r_name").alias("doc_id"), lines)
    return el.select("doc_id", "pos", _key_of(sections.classify_annual(F.col("x.text"), F.col("x.aft"))).alias("found"))


#: A filing with two tables below two headings, spans, nested and dollar cells.
_FILING = (
    "<html><body><p>Form 10-K</p><p>Item 1. Business</p><table><tr><td>{0}</td><td>2020</td></tr><tr><td>a</td><td>1,000</td></tr></table>"
    "<p>Item 7. Management's Discussion and Analysis</p>"
    "<table><tr><td rowspan=2>{0}</td><td colspan=2>2021</td></tr><tr><td>$</td><td>5.0</td></tr><tr><td>b</td><td>$</td><td>( 6</td><td>)</td></tr></table></body></html>"
)


@query("""select n_name as doc_id, 1 as tid, n_name || ',2020' || chr(10) || 'a,1000' as csv, '1' as section from nation
union all select n_name, 2, n_name || ',2021,2021' || chr(10) || n_name || ',,5' || chr(10) || 'b,,(6)', '7' from nation""")
def extract_with_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, *rest = _FILING.split("{0}")
    text = F.concat(F.lit(head), *[x for part in rest for x in (F.col("n_name"), F.lit(part))])
    made = api.extract(table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_id"), text.alias("html")), with_sections=True)
    return made.select("doc_id", "tid", render.csv_text(F.col("grid")).alias("csv"), "section")


_SCAN_SQL = """, cand as (select doc_id, pos, split_part(found, ':', 1) as key, cast(split_part(found, ':', 2) as int) as ord from (select *, {found} as found from el where {guard}) where found is not null),
kept as (select * from cand a where ord >= coalesce((select max(ord) from cand b where b.doc_id = a.doc_id and b.pos < a.pos), 0)),
marks as (select doc_id, key, max(pos) as pos, min(ord) as ord from kept group by 1, 2)"""


@query(f"with {_sql_lines(ANNUAL_HEADINGS)}" + _SCAN_SQL.format(found=_ANNUAL_SQL, guard=_GUARD_SQL) + " select * from marks")
def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.starts(elements_of(spark, sf_dir, ANNUAL_HEADINGS), "10-K").select("doc_id", "key", "pos", "ord")


@query(f"with {_sql_lines(ANNUAL_HEADINGS)}" + _SCAN_SQL.format(found=_ANNUAL_SQL, guard=_GUARD_SQL) + " select el.doc_id, el.pos, (select key from marks m where m.doc_id = el.doc_id and m.pos <= el.pos order by m.pos desc, m.ord desc limit 1) as section from el")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = elements_of(spark, sf_dir, ANNUAL_HEADINGS)
    return sections.label(elements, sections.starts(elements, "10-K")).select("doc_id", "pos", "section")


@query("select n_name as doc_id, '1.1' as key, 1 as pos, 1 as ord from nation")
def section_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.starts(elements_of(spark, sf_dir, ["Cover", "Condensed Consolidated Statements of Income", "text"])).select("doc_id", "key", "pos", "ord")


@query("select n_name as doc_id, cast(9 as int) as first_pos, cast(11 as bigint) as n from nation")
def toc_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty elements on ten pages; page 4 lists an exhibit and a signature."""
    texts = [f"line {k}" for k in range(20)]
    texts[8] = "Signatures"
    texts[9] = "Exhibit index"
    df = elements_of(spark, sf_dir, texts).withColumn("page", (F.col("pos") / 2).cast("int")).withColumn("category", F.lit("Text"))
    return prep.skip_contents(df).groupBy("doc_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


# --- edits, files, scores ---


@query("select c_custkey, 'H,b_c' as head, case when c_custkey % 2 = 0 then 'X,1 2' else 'a,1 2' end || chr(10) || ',' as csv, cast(3 + (c_custkey + 1) % 2 as int) as applied, cast(1 as int) as skipped from customer")
def edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's file gets a log of four or five instructions, one of them out of range."""
    c = table(spark, sf_dir, "customer").select("c_custkey", S("c_custkey").alias("fileName"))
    targets = c.select("c_custkey", "fileName", row("H", "b", "c").alias("header"), F.array(row("a", "1", "2"), row("z", "8", "9")).alias("grid"))
    d = lambda **k: F.struct(*[F.lit(k.get(n)).cast(t).alias(n) for n, t in (("row", "long"), ("col", "long"), ("oldVal", "string"), ("newVal", "string"), ("index", "long"), ("amount", "long"), ("isRow", "boolean"))])
    e = lambda seq, action, when=None, **k: F.struct(F.lit(seq).alias("seq"), F.when(when, action).otherwise(F.lit(action) if when is None else F.lit("none")).alias("action") if when is not None else F.lit(action).alias("action"), d(**k).alias("details"))
    is_even = F.col("c_custkey") % 2 == 0
    log = c.select("fileName", F.explode(F.array(e(1, "remove_row", index=2), e(2, "merge", index=1, isRow=False), e(3, "add_row", index=9), e(4, "edit", row=77, col=0, newVal="q"), e(5, "edit", when=is_even, row=1, col=0, newVal="X"))).alias("x")).select("fileName", "x.*").where("action <> 'none'")
    done = edits.replay(targets, log)
    return done.select("c_custkey", F.array_join("header", ",").alias("head"), render.csv_text(F.col("grid")).alias("csv"), "applied", "skipped")


@query("select c_custkey, 'x,9' || chr(10) || 'y,2' as csv, 1 as applied, 0 as skipped, cast(c_custkey % 2 as int) as mismatched from customer")
def edit_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit that names another old value is applied and counted."""
    c = table(spark, sf_dir, "customer").select("c_custkey", S("c_custkey").alias("fileName"), row("h", "i").alias("header"), F.array(row("x", "1"), row("y", "2")).alias("grid"))
    old = F.when(F.col("c_custkey") % 2 == 0, "1").otherwise("7")
    details = F.struct(F.lit(1).cast("long").alias("row"), F.lit(1).cast("long").alias("col"), old.alias("oldVal"), F.lit("9").alias("newVal"), F.lit(None).cast("long").alias("index"), F.lit(None).cast("long").alias("amount"), F.lit(None).cast("boolean").alias("isRow"))
    done = edits.replay(c, c.select("fileName", F.lit("log").alias("log"), F.lit(1).alias("seq"), F.lit("edit").alias("action"), details.alias("details")))
    return done.select("c_custkey", render.csv_text(F.col("grid")).alias("csv"), "applied", "skipped", "mismatched")


@query("with b as (select distinct p_brand from part) select a.p_brand as \"fileName\", min('/d/' || f.p_brand || '_1.csv') as path from b a join b f on starts_with(f.p_brand || '_1.csv', a.p_brand) group by 1")
def file_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("fileName")).distinct()
    paths = names.select(F.explode(F.array(*[F.concat(F.lit("/d/"), F.col("fileName"), F.lit(f"_{k}.csv")) for k in (2, 1)])).alias("path"))
    return files.resolve_files(names, paths)



@query("""with recursive s as (select p_partkey, string_split(p_name, ' ') as a, string_split(p_type, ' ') as b from part),
dp(p_partkey, a, b, i, r) as (select p_partkey, a, b, 0, range(0, len(b) + 1) from s
 union all select p_partkey, a, b, i + 1, list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, least(acc[-1] + 1, r[j + 1] + 1, r[j] + case when a[i + 1] = b[j] then 0 else 1 end)), [cast(i + 1 as bigint)]) from dp where i < len(a))
select p_partkey, cast(r[-1] as int) as distance from dp where i = len(a)""")
def lev_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", R.cell_distance(F.split("p_name", " "), F.split("p_type", " ")).alias("distance"))


@query("select p_partkey, cast(1 + case when p_size = 7 then 0 else 1 end as int) as distance from part")
def lev_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids that differ by an inserted row and, but for size 7, one cell."""
    a = F.array(row("h", "x"), row("a", S("p_size")))
    b = F.array(row("h", "x"), row("new", "row"), row("a", "7"))
    pairs = table(spark, sf_dir, "part").select("p_partkey", a.alias("t1"), b.alias("t2"))
    return score.grid_distances(pairs).select("p_partkey", "distance")


@query("""select n_regionkey as tid, cast(round((1 - (sum(case when k = 2 then 1.0 * levenshtein(n_name, 'CHANGED') / greatest(length(n_name), 7) else 0 end) + case when n_regionkey % 2 = 0 then 3 else 0 end)
 / (1 + 3 * count(*) + case when n_regionkey % 2 = 0 then 3 else 0 end)) * 1000000) as bigint) as micro from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) group by 1""")
def teds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against itself with one cell changed and, in every second one, a row more."""
    g = nation_grids(spark, sf_dir)
    other = F.transform("grid", lambda r, i: F.when(i == 1, F.array(F.lit("CHANGED"), F.get(r, F.lit(1)))).otherwise(r))
    more = F.when(F.col("tid") % 2 == 0, F.array(F.array(F.lit("1234567890"), F.lit("#")))).otherwise(F.array().cast("array<array<string>>"))
    other = F.concat(other, more)
    pairs = g.select("tid", render.table_html(F.col("grid")).alias("html1"), render.table_html(other).alias("html2"))
    return score.teds(pairs).select("tid", F.round(F.col("teds") * 1000000).cast("long").alias("micro"))


@query("select n_regionkey as doc_id, min(n_nationkey) as tid, string_agg(n_name, chr(10) order by n_nationkey) as csv from (select *, sum(case when n_nationkey % 3 = 1 then 0 else 1 end) over (partition by n_regionkey order by n_nationkey) as g from (select n_nationkey, n_regionkey, case when n_nationkey % 3 = 1 then '(a) ' || n_name else n_name end as n_name from nation)) group by n_regionkey, g")
def footnote_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.col("n_nationkey") % 3 == 1
    text = F.when(note, F.concat(F.lit("(a) "), F.col("n_name"))).otherwise(F.col("n_name"))
    grids = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("tid"), F.when(note, F.array(F.array(text))).otherwise(F.array(F.array(text))).alias("grid"))
    # A footnote table has a first cell of the form (x) alone; here the sign leads the text.
    return style.join_footnotes(grids.withColumn("grid", F.col("grid"))).select("doc_id", "tid", render.csv_text(F.col("grid")).alias("csv"))


@query("select n_nationkey as doc_id, 1 as tid, '**' || n_name || '**,' || '**' || n_name || '**' || chr(10) || 'a,5' || chr(10) || '&nbsp;&nbsp;&nbsp;&nbsp;b,(6)' as csv from nation")
def style_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold spanning heading, indented label, closing parenthesis in a cell of its own."""
    body = F.concat(F.lit('<table><tr><td colspan=3><p style="font-weight:bold">'), F.col("n_name"), F.lit('</p></td></tr><tr><td><p style="margin-left:0pt">a</p></td><td><p>5</p></td><td></td></tr><tr><td><p style="margin-left:12pt">b</p></td><td><p>( 6</p></td><td><p>)</p></td></tr></table>'))
    grids = style.styled_grids(html.html_tables(table(spark, sf_dir, "nation").select("n_nationkey", body.alias("html")), "n_nationkey"))
    return grids.select(F.col("doc_id").cast("int").alias("doc_id"), "tid", render.csv_text(F.transform("grid", lambda r: F.slice(r, 1, 2))).alias("csv"))


@query("""select n_nationkey as doc_id, 1 as tid, n_name || ',' || n_name || chr(10) || 'a,5' || chr(10) || '  b,(6)' || chr(10) || '    c,7' as csv from nation""")
def styled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style-aware CSV: two spaces a level, no stars."""
    line = '<tr><td><p style="margin-left:{}pt">{}</p></td><td><p>{}</p></td><td>{}</td></tr>'
    body = F.concat(F.lit('<table><tr><td colspan=3><p style="font-weight:bold">'), F.col("n_name"), F.lit("</p></td></tr>" + line.format(0, "a", "5", "") + line.format(12, "b", "( 6", "<p>)</p>") + line.format(24, "c", "7", "") + "</table>"))
    made = api.to_styled(table(spark, sf_dir, "nation").select(S("n_nationkey").alias("doc_id"), body.alias("html")), output="csv")
    return made.select(F.col("doc_id").cast("int").alias("doc_id"), "tid", F.col("text").alias("csv"))


def _draw(n: str | int, tag: str) -> str:
    return f"(cast('0x' || substr(md5(concat_ws(':', '7', cast(seq as varchar), '{tag}')), 1, 15) as bigint) % {n})"


#: The generator's draws over tables of 8 rows and 4 columns, written out.
_EDITS_SQL = f"""with s as (select unnest(range(2500)) as seq),
t as (select seq, {_draw(25, "t")} + 1 as "tableIndex", ['edit', 'remove_row', 'remove_col', 'add_row', 'add_col', 'merge'][{_draw(6, "a")} + 1] as action,
 {_draw(7, "r")} + 1 as r, {_draw(4, "c")} as c, cast({_draw(100000, "v")} as varchar) as v, {_draw(100, "f")} as f, {_draw(3, "k")} as k, {_draw(10, "n")} as n, {_draw(2, "m")} as m,
 {_draw(7, "i")} as ir, {_draw(3, "i")} as ic, {_draw(3, "q")} + 1 as qr, {_draw(2, "q")} + 1 as qc, substr(translate(md5(cast(seq as varchar)), '0123456789', 'ghijklmnop'), 1, 6) as letters from s)
select seq, n_name as "fileName", "tableIndex", action, case when action = 'edit' then '{{"row":' || r || ',"col":' || c || case when n < 2 then '' else ',"newVal":"' || case k when 0 then v when 1 then v || '.' || f else letters end || '"' end || '}}'
 when action = 'merge' then '{{"index":' || case when m = 0 then ir else ic end || ',"isRow":' || case when m = 0 then 'true' else 'false' end || '}}'
 else '{{"index":' || case when ends_with(action, '_row') then r else c end || ',"amount":' || case when ends_with(action, '_row') then qr else qc end || '}}' end as details
from t join nation on n_nationkey + 1 = "tableIndex" """


@query(_EDITS_SQL)
def random_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("tableIndex"), F.col("n_name").alias("fileName"), F.lit(8).alias("rows"), F.lit(4).alias("cols"))
    return generate.random_edits(spark, dims, 2500, seed=7).select("seq", "fileName", "tableIndex", "action", F.to_json("details").alias("details"))


@query("select n_regionkey as tid, n_regionkey as doc_id, string_agg(n_name || ',' || n_nationkey, chr(10) order by n_nationkey) as csv from nation group by 1")
def html_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-styled HTML with glue and spare columns parses back to the grid it came from."""
    made = generate.random_html(nation_grids(spark, sf_dir).withColumn("doc_id", S("tid")), seed=3)
    back = html.html_tables(made).select(F.col("doc_id").cast("int").alias("tid"), F.col("doc_id").cast("int").alias("doc_id"), "grid")
    bare = F.transform("grid", lambda r: F.filter(F.transform(r, lambda v: F.trim(F.replace(v, F.lit(C.NBSP), F.lit(" ")))), lambda v: v != ""))
    return back.select("tid", "doc_id", render.csv_text(bare).alias("csv"))


@query("select n_nationkey as doc_id, n_regionkey as tid from nation where n_nationkey < 3")
def draw_the_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than five are left: all of them are drawn."""
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_regionkey").alias("tid"))
    return edits.draw_tables(t, t.where("doc_id >= 3"))


@query("select n_nationkey as doc_id, n_regionkey as tid from nation where n_nationkey >= 5 order by md5(concat_ws(':', n_nationkey, n_regionkey, 0)) limit 5")
def draw_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_regionkey").alias("tid"))
    return edits.draw_tables(t, t.where("doc_id < 5"))


@query("select n_nationkey, '0,3,12' as map, '<table>' || n_name || ',x' as first from nation")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialised tables: only lines that begin with a number count."""
    text = F.concat(F.lit("3,<table>"), F.col("n_name"), F.lit(",x\nnote, no table\n12,<table>y"))
    found = table(spark, sf_dir, "nation").select("n_nationkey", prep.table_lines(text).alias("t"))
    tids = prep.table_map(F.transform("t", lambda x: x["tid"]))
    return found.select("n_nationkey", F.array_join(tids.cast("array<string>"), ",").alias("map"), F.get(F.col("t"), F.lit(0))["html"].alias("first"))


@query("select n_nationkey, case when n_nationkey % 5 = 0 then 'new ' || n_name else n_name end as n_name from nation")
def csv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = old.where("n_nationkey % 5 = 0").withColumn("n_name", F.concat(F.lit("new "), F.col("n_name")))
    return render.upsert(old, new, "n_nationkey")


@query("""select n_name as "fileName", '[{"fileName":"' || n_name || '","tableIndex":1,"action":"add_row","range":null,"details":' || details || '},{"fileName":"' || n_name || '","tableIndex":1,"action":"merge","range":null,"details":' || details || '}]' as body from nation, (select '{"row":null,"col":null,"oldVal":null,"newVal":null,"index":' || 2 || ',"amount":null,"isRow":true}' as details)""")
def edits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("fileName"))
    details = "named_struct('row', cast(null as bigint), 'col', cast(null as bigint), 'oldVal', cast(null as string), 'newVal', cast(null as string), 'index', 2L, 'amount', cast(null as bigint), 'isRow', true)"
    rows = names.select("fileName", F.posexplode(F.array(F.lit("add_row"), F.lit("merge"))).alias("seq", "action"))
    return render.edits_json(rows.selectExpr("cast(seq as bigint) as seq", "fileName", "1L as tableIndex", "action", "cast(null as string) as range", f"{details} as details"))
