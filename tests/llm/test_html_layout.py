"""Spans, scopes, rules and bounds of the HTML rendering, on pages by hand."""

import time

import pytest

from tallgrass.llm.html_extract import ALIGN, extract_text, render


def text(html):
    return render(html)["text"]


def rows(*lines):
    return "<table>" + "".join(f"<tr>{x}</tr>" for x in lines) + "</table>"


def test_columns_that_a_cell_spans():
    assert text(rows("<td colspan=2>ab<td>c", "<td>d<td>e<td>f")) == "ab    c\nd  e  f"
    assert text(rows("<td colspan='2'>a long head<td>c", "<td>d<td>e<td>f")) == "a long head  c\nd  e         f"
    # columns that no cell starts in take no room, and spans are bounded as HTML bounds them
    assert text(rows("<td colspan=5>a<td>b", "<td colspan=5>c<td>d")) == "a  b\nc  d"
    assert text(rows("<td colspan=99999999>a<td>b", "<td colspan=1000>c<td>d")) == "a  b\nc  d"
    assert text(rows("<td colspan=0>a<td colspan=x>b", "<td colspan=-2>c<td colspan>d")) == "a  b\nc  d"


def test_rows_that_a_cell_spans():
    assert text(rows("<td rowspan=2>a<td>b", "<td>c", "<td>d<td>e")) == "a  b\n   c\nd  e"
    assert text(rows("<td>a<td rowspan=0>b<td>c", "<td>d<td>e", "<td>f<td>g")) == "a  b  c\nd     e\nf     g"
    assert text(rows("<td rowspan=2 colspan=2>a<td>b", "<td>c", "<td>d<td>e<td>f")) == "a     b\n      c\nd  e  f"


def test_end_tags_stay_in_their_cell():
    assert text("<div><table><tr><td>a</div>b</td><td>c</table>d") == "ab  c\n\nd"
    assert text("<p><table><tr><td>a</p></td><td>b</body></td><td>c</table>") == "a  b  c"
    assert text(rows("<td>a<table><tr><td>b</tr></td></table>c</td><td>d")) == "a b c  d"
    assert text("<object><div>a</object>b") == "a\nb"


def test_objects_and_dialogs():
    assert text("a <object data=x>plain</object> b") == "a plain b"
    assert text("a<dialog>b</dialog><dialog open>c</dialog>") == "a\nc"
    assert "b" not in text("a<dialog class=open>b</dialog>")


@pytest.mark.parametrize(
    ("css", "html", "want"),
    [
        (".x{display:none}", "<b class='y x'>a</b>b", "b"),
        ("#i, p.z { visibility : HIDDEN }", "<b id=i>a</b><p>b<p class=z>c", "b"),
        (".m{display:none} .m.open{display:block}", "<b class='open m'>a</b><b class=m>b</b>", "a"),
        (".m.open{display:inline} .m{display:none}", "<b class='open m'>a</b>", "a"),
        (".m{display:none}", "<b class=m style='display:inline'>a</b>", "a"),
        (".m{display:none !important}", "<b class=m style='display:inline'>a</b>", ""),
        ("@media print{.x{display:none}} @import 'a'; .y{display:none}", "<b class=x>a</b><b class=y>b</b>", "a"),
        (".x>b{display:none} .x b{display:none} b:hover{display:none}", "<i class=x><b>a</b></i>", "a"),
        ("/* .x{display:none} */ .y{color:red} }} .z{display:none", "<b class='x y z'>a</b>", "a"),
        ("aside{display:none}", "<aside>a</aside><p>b", "b"),
    ],
)
def test_style_rules(css, html, want):
    assert text(f"<head><style>{css}</style></head><body>{html}") == want


def test_sheets_for_other_media_and_places():
    hide = ".x{display:none}</style>"
    assert text(f"<style media=print>{hide}<b class=x>a</b>") == "a"
    assert text(f"<style media=screen>{hide}<b class=x>a</b>b") == "b"
    assert text(f"<template><style>{hide}</template><b class=x>a</b>") == "a"
    assert text(f"<noscript><style>{hide}</noscript><b class=x>a</b>") == "a"


def test_wide_cells_are_whole_and_cost_no_padding():
    long = "w" * 100_000
    got = text(rows(f"<td>{long}<td>z", *["<td>a<td>b"] * 5000)).split("\n")
    assert got[0] == f"{long}  z" and set(got[1:]) == {"a  b"} and len(got) == 5001
    edge = "e" * ALIGN
    assert text(rows(f"<td>{edge}<td>z", "<td>a<td>b")).split("\n")[1] == "a" + " " * (ALIGN + 1) + "b"


@pytest.mark.parametrize(
    "html",
    [
        "<p><table><td>" + "<b>" * 100_000 + "<div>" * 100_000,
        "<div><table><td>" + "<b>" * 100_000 + "</div>" * 100_000,
        "<li>" * 50_000 + "<ul>" * 20_000 + "</li>" * 50_000,
        rows(*["<td rowspan=65534>a"] * 1000 + ["<td>b"] * 20_000),
    ],
    ids=["open", "close", "items", "spans"],
)
def test_depth_costs_no_walk(html):
    start = time.monotonic()
    render(html)
    assert time.monotonic() - start < 20


def test_rows_nulls_and_clashing_columns(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<p>a", "x", 7), (1, "u", "<p>a", "y", 8), (None, None, None, None, None), (2, "", "", "z", 9)],
        "page_id int, url string, html string, text string, n_tables int",
    )
    got = sorted(map(tuple, extract_text(spark, pages).collect()), key=repr)
    assert got == sorted([(1, "u", None, "a", 1, 0, 0)] * 2 + [(None, None, None, "", 0, 0, 0), (2, "", None, "", 0, 0, 0)], key=repr)
    assert extract_text(spark, pages.limit(0)).columns == ["page_id", "url", "title", "text", "n_blocks", "n_tables", "n_items"]
    assert extract_text(spark, pages.limit(0)).count() == 0
