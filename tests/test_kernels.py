"""Rules and kernels that need no tables."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwright import queries
from gridwright.functions import rows as R
from gridwright.operators import clean, generate, score
from gridwright.sources import files, html

CELL = st.sampled_from(["", "a", "1", "(2", ")", "%", "$", "–", "3.0"])


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(now[-1] + 1, prev[j + 1] + 1, prev[j] + (x != y)))
        prev = now
    return prev[-1]


def test_parser_spans_and_unclosed():
    p = html.parse("<table><tr><td colspan=2>a<td rowspan='2'>b<tr><td>c&nbsp;d<td>e</table>")
    assert p.tables[0].grid() == [["a", "a", "b"], ["c d", "e", "b"]]


def test_parser_nested_and_hidden():
    p = html.parse("<table><tr><td>x<table><tr><td style='display:none'>y</table></table><script>'<table>'</script>")
    assert [t.grid() for t in p.tables] == [[["x y"]], [["y"]]]
    assert html.parse(None).tables == [] and html.parse("<table></table>").tables[0].grid() == []


def test_csv_ragged_and_crlf():
    assert files.parse_csv('a,b\r\r\n"x\ny",2,3\r\n\r\n') == [["a", "b"], ["x\ny", "2", "3"]]
    assert files.decode_bytes("é".encode("cp1252")) == "é" and files.decode_bytes(b"\xef\xbb\xbfa") == "a"


def swept(spark, grid):
    df = spark.createDataFrame([(grid,)], "grid array<array<string>>")
    return clean.sweep_rows(df).first().grid


def test_upward_merge(spark):
    grid = [["", "h", "", "", ""], ["", "a", "1", "", "2"], ["", "b", "3", "–", "4"]]
    assert swept(spark, grid)[1:] == [["", "a", "1- 2", "", ""], ["", "b", "3 - 4", "", ""]]


def test_upward_merge_reads_swept_rows(spark):
    grid = [["h", "", "", "", ""], ["a", "", "1", "$", "2"], ["b", "", "3", "–", "4"]]
    assert swept(spark, grid)[1] == ["a", "", "1- 2", "", ""]


def test_dash_in_the_first_row(spark):
    grid = [["", "", "x", "–", "y"], ["h", "", "", "", ""], ["a", "", "1", "", "2"]]
    assert swept(spark, grid) == [["", "", "x - y", "", ""], ["h", "", "", "", ""], ["a", "", "1", "", "2"]]


def test_sweep_is_made_once_and_stays_in_the_engine(spark):
    df = spark.createDataFrame([([["h"], ["a", "", "1"], ["b", "", "3", "–", "4"]],)], "grid array<array<string>>")
    made = clean.sweep_rows(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Union" not in plan
    assert made.first().grid == [["h"], ["a", "", "1"], ["b", "", "3 - 4", "", ""]]  # short rows above end the range


def test_sweep_passes_over_cells_without_signs(spark):
    row = spark.range(1).select(R.sweep(F.array(*[F.lit(x) for x in ("x", "a b", None, "5.0", "", "1,000")])).alias("r")).first().r
    assert row == ["x", "a b", "", "5", "", "1000"]
    assert spark.range(1).select(R.sweep(F.array(F.lit("($"), F.lit("plain"))).alias("r")).first().r == ["($", "plain"]


def test_grids_of_a_small_file_are_spread(spark, tmp_path):
    """A few rows stand for a large table, which may lie in one row group all the same."""
    spark.range(8).selectExpr("id as p_partkey", "'b' as p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("dash_merge_up", "dash_two_ranges"):
        made = queries.QUERIES[name](spark, str(tmp_path))
        assert made.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and made.count() == 8


def test_replay_sorts_few_files_a_task(spark, tmp_path):
    spark.range(8).selectExpr("id as c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("edit_replay", "edit_mismatch"):
        made = queries.QUERIES[name](spark, str(tmp_path))
        assert made.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and made.count() == 8


def test_spans_as_long_as_the_table():
    rows = "".join(f"<tr><td>{k}</td></tr>" for k in range(1200))
    grid = html.parse(f"<table><tr><td rowspan=70000>x</td><td>y</td></tr>{rows}</table>").tables[0].grid()
    assert len(grid) == 1201 and grid[-1] == ["x", "1199"]


def test_tree_distance():
    a = "<table><tr><td>1</td><td>2</td></tr></table>"
    assert score.tree_similarity(a, a) == 1
    assert score.tree_similarity(a, a.replace("2", "3")) == 0.75
    assert score.tree_similarity("", "") == 1.0


def test_sample_grid_distance(spark):
    a = [["h", "x", "", "y"], ["1", "2"], ["3"], ["4", "5"]]
    b = [["h", "x", "y"], ["1", "2"], ["4", "6"]]
    df = spark.createDataFrame([(a, b), (a, a), ([], b), (a, []), ([], [])], "t1 array<array<string>>, t2 array<array<string>>")
    got = [r.distance for r in score.grid_distances(df).collect()]
    assert got == [3, 0, 3, 4, 0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(CELL, max_size=6), st.lists(CELL, max_size=6)), min_size=1, max_size=8))
def test_cell_distance(spark, pairs):
    df = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "a array<string>, b array<string>")
    got = [r.d for r in df.select(R.cell_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [distance(a, b) for a, b in pairs]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(CELL, min_size=3, max_size=3), min_size=1, max_size=5))
def test_cleaned_grids_have_no_empty_column(spark, grid):
    df = spark.createDataFrame([("d", 1, grid)], "doc_id string, tid int, grid array<array<string>>")
    for r in clean.clean_filing(df).collect():
        assert all(any(row[c] for row in r.grid) for c in range(len(r.grid[0])))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id string, tid int, grid array<array<string>>")
    assert clean.clean_filing(df).count() == 0 and clean.clean_markdown(df).count() == 0


def test_csv_and_edit_files(spark, tmp_path):
    (tmp_path / "t_1.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "log_x.json").write_text('[{"fileName":"t","tableIndex":1,"action":"edit","range":null,"details":{"row":1,"col":0,"newVal":"9"}},{"fileName":"t","action":"paste","details":"text"}]')
    grid = files.with_header(files.read_csv(spark, str(tmp_path))).first()
    assert grid.header == ["a", "b"] and grid.grid == [["1", "2", "3"]]
    log = files.read_edits(spark, str(tmp_path)).orderBy("seq").collect()
    assert log[0].details.newVal == "9" and log[1].details_text == "text"
    found = files.resolve_files(files.read_edits(spark, str(tmp_path)), files.list_csv(spark, str(tmp_path))).collect()
    assert [r.fileName for r in found] == ["t"] and found[0].path.endswith("t_1.csv")
    assert files.count_csv(spark, str(tmp_path)) == 1


def test_form_is_read_from_the_whole_text(spark):
    from gridwright.operators import prep

    header = "<ix:header>" + "<xbrli:context>Form 10-Q</xbrli:context>" * 2000 + "</ix:header>"
    style = "<style>" + "p { margin: 0 } " * 5000 + "</style>"
    rows = [
        (1, f"<html>{header}<p>FORM 10-K</p></html>", "10-K"),
        (2, f"<html>{style}<p>Form&nbsp;<b>10-K</b></p></html>", "10-K"),
        (3, f"<html>{style}<p>FORM 10-Q</p><p>see our Form 10-K for the year</p></html>", "10-Q"),
        (4, f"<html>{style}<p>FORM 10-K</p><p>see our Form 10-Q for the quarter</p></html>", "10-K"),
        (5, "<10K>", "10-K"),
        (6, None, "10-Q"),
    ]
    df = spark.createDataFrame(rows, "id long, html string, want string")
    got = df.select("id", "want", prep.form_of(F.col("html")).alias("form")).collect()
    assert {r.id: r.form for r in got} == {r.id: r.want for r in got}


def test_tree_similarity_by_text():
    """A renamed cell costs the distance of its texts, another span a whole node."""
    one = "<table><tr><td>abcd</td><td>x</td></tr></table>"
    assert score.tree_similarity(one, one.replace("abcd", "abxd")) == 1 - 0.25 / 4
    assert score.tree_similarity(one, one.replace("<td>x", "<td colspan=2>x")) == 1 - 1 / 4
    assert score.tree_similarity(one, "") == 0 and score.tree_similarity("", "") == 1


def test_indent_markers():
    text = "<table><tr><td><p style='margin-left:36pt;'>a</p></td><td><p style='margin-left: 36pt;'>b</p></td><td><div style='text-indent:.5pt'>c</div></td></tr></table>"
    assert html.parse(text, indents=True).tables[0].grid() == [["&nbsp;" * 8 + " a", "b", "c"]]
    assert html.parse(text).tables[0].grid() == [["a", "b", "c"]]


def test_anchors_of_odd_pages():
    assert html.set_anchors(None) is None and html.set_anchors("") == "" and html.set_anchors("bare text") == "bare text"
    assert html.set_anchors("<p>a</p>") == '<p id="tag0">a</p>'


def test_elements_keep_references_without_semicolon():
    texts = [e["text"] for e in html.elements_of("<title>a&amp;&amp</title><p>&copy; &copy &am x&ampy; &#65;&#66 &</p>")]
    assert texts == ["a&&amp", "\u00a9 &copy &am x&ampy; A&#66 &"]
    assert html.elements_of(None) == [] and html.set_anchors("<p>a &amp b</p>") == '<p id="tag0">a &amp b</p>'
    assert html.parse("<table><tr><td>a&ampb</table>").tables[0].grid() == [["a&b"]]  # cells as browsers read them


def test_random_html_parses_back(spark):
    """Whatever is drawn, the values of a table are found in it again."""
    grids = spark.createDataFrame([(f"t{k}", [["h", "Total"], ["a & b", "1,000"], ["Net", "x\ny"]]) for k in range(60)], "doc_id string, grid array<array<string>>")
    made = generate.random_html(grids, seed=5).collect()
    for r in made:
        rows = html.parse(r.html).tables[0].grid()
        assert [[v for v in line if v] for line in rows] == [["h", "Total"], ["a & b", "1,000"], ["Net", "x y"]]
    drawn = [("<br>" in r.html, "colgroup" in r.html, "#000" in r.html, r.html.count(" ")) for r in made]
    assert len({d[0] for d in drawn}) == len({d[1] for d in drawn}) == 2 and len({d[3] for d in drawn}) > 2
