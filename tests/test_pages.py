"""Records of pages leave a task in bounded parts."""

import pyarrow as pa

from matchspark.plans import records
from matchspark.sources import markup, pages, text

CELLS = pa.list_(pa.struct([("attributes", pa.string()), ("stat", pa.string()), ("inner", pa.string()), ("text", pa.string())]))


def test_records_are_sent_in_bounded_parts():
    row = "<tr class='x'>" + "".join(f"<td data-stat=\"s{i}\">{i:050}</td>" for i in range(20)) + "</tr>"
    htmls = [f"<table>{row * 16}</table>", None, "", "<p>no table</p>"] * 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(htmls)], ["id", "__page"])
    fields = pa.schema([("attributes", pa.string()), ("cells", CELLS)])
    found = list(pages.parts(iter([batch]), ["id"], markup.table_grid, fields))
    assert len(found) > 10 and max(b.nbytes for b in found) < 2 * pages.PART
    table = pa.Table.from_batches(found)
    assert table.column("id").to_pylist() == [i for i in range(0, 2000, 4) for _ in range(16)]
    assert all(r == markup.table_grid(htmls[0])[0]["cells"] for r in table.column("cells").to_pylist()[::997])


def test_a_large_page_is_sent_in_parts():
    block = "Tir. 01/02 18:45\nHome\nAway\nSerie A\nH\n2,5\n"
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([block * 50_000, block])], ["id", "__page"])
    fields = pa.schema([("block", pa.int64()), ("home_team", pa.string()), ("home_odds", pa.float64()), ("over_1_5", pa.float64())])
    found = list(pages.parts(iter([batch]), ["id"], lambda page: text._labelled(page.strip().split("\n")), fields))
    assert len(found) > 1 and max(b.nbytes for b in found) < pages.PART
    table = pa.Table.from_batches(found)
    assert table.column("block").to_pylist() == [*range(1, 50_001), 1] and set(table.column("home_odds").to_pylist()) == {2.5}
    assert table.column("over_1_5").null_count == 50_001 and table.column("id").to_pylist()[-2:] == ["a", "b"]


def test_spanning_cells_and_no_keys():
    wide = "<table><tr><td colspan=1000>" + "x" * 100 + "</td></tr>" + "</table>"
    batch = pa.RecordBatch.from_arrays([pa.array([wide] * 100)], ["__page"])
    found = list(pages.parts(iter([batch]), [], markup.table_grid, pa.schema([("cells", CELLS)])))
    assert max(b.nbytes for b in found) < 2 * pages.PART and sum(len(c) for b in found for c in b.column(0).to_pylist()) == 100_000


ODD = [
    "<table><tr><td>1</td>\n <TH>a &amp; b\xa0</th></tr>\n<tr></tr><tr><td>x</td> y <td>z</td></tr></table>",
    "<table><tr><td rowspan=2>down</td><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr></table>",
    "<table><tr><td>a<table><tr><td>in</td></tr></table>b</td></tr><tr><td>c</td></tr>",
    "<tr><td>no end<tr><td>1</td></tr><td>no row</td><tr><td>1 < 2</td></tr><tr><td><b>bold</b></td><td>3</td></tr>",
    "<table><tr><td>open <tr><td>2</td></tr></td></tr></table><tr><td>after</td></tr>",
]


def test_plain_rows_are_read_as_any_other():
    """A blank in the tag keeps a row from being read at once; its cells are the same."""
    for page in ODD:
        slow = markup.table_grid(page.replace("<tr>", "<tr >"))
        fast = markup.table_grid(page)
        assert [r["cells"] for r in fast] == [r["cells"] for r in slow] and len(fast) == page.count("<tr>")


def test_statistics_take_the_texts_they_need_along(spark):
    cells = lambda n: "".join(f"<td>{i},00{i % 10}%</td>" for i in range(1, n))
    html = f"<table><tr><th>A &amp; B</th>{cells(20)}</tr><tr><th>short</th>{cells(14)}</tr><tr class='x'><th>C</th>{cells(15)}</tr></table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, page string")
    found = markup.team_statistics(df, "page", {"touches": (3, "int"), "share": (2, "double"), "last": (15, "double")}, ["id"])
    assert "cells#" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "A & B", 0, 2002.0, 15005.0), (1, "C", 0, 2002.0, 0.0)}


def test_matches_move_to_their_page_as_numbers(spark, sf_dir):
    pages_ = records.statistics_pages(spark, sf_dir, "passing")
    plan = pages_._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    assert any("<td>" in line for line in plan[:at]) and not any("<td>" in line for line in plan[at:])
