"""Reduction of pages: tables in their place, skipped parts with end tags left out."""

from plenum.operators.pages import read


def test_tables_stay_in_the_text():
    page = "<p>before</p><table><tr><th colspan=2>head</th></tr><tr><td>a|b<td><a href='u'>link</a><tr><td>outer <table><tr><td>inner</table> rest</table><p>after</p>"
    assert read(page).lines == ["before", "[table 2]", "| inner |", "| --- |", "[table 1]", "| head |  |", "| --- | --- |", "| a\\|b | [link](u) |", "| outer rest |  |", "after"]
    assert read(page, False).lines == ["before", "[table 2]", "inner", "[table 1]", "head", "a|b\tlink", "outer rest", "after"]
    assert read("<table><tr><td>open").lines[1:] == ["| open |", "| --- |"]


def test_skipped_parts_end():
    for part in ("<nav><ul><li>a<li>b</ul></nav>", "<footer>x<wbr>y<col><area></footer>", "<form><form><p>z</form></form>", "<img><input>"):
        assert read(f"<p>one</p>{part}<p>two</p>").lines == ["one", "two"]
