"""The data source of filing indexes: rows, pushed filters, and lines that don't parse."""

import datetime as dt

from tidemark.sources import form_index

HEAD = "Description: index\n\nForm Type   Company Name   CIK   Date Filed   File Name\n" + "-" * 60 + "\n"


def row(form, company, cik, day, path):
    return f"{form:<12}{company:<30}{cik:<12}{day:<12}{path}\n"


def test_rows_filters_and_errors(spark, tmp_path):
    for year in (2019, 2020, 2021):
        for q in (1, 2):
            day = f"{year}-0{q}-15" if q == 1 else f"{year}0415"
            text = HEAD + row("10-K", f"ACME  & SONS {year}"[:28].replace("  ", " "), 7, day, f"edgar/data/7/{year}{q}.txt") + row("10-K405", "OLD CO", 8, day, "edgar/data/8/x.txt") + row("8-K", "Z", 9, day, "p") + "broken line\n\n" + row("10-K", "BAD DAY", 1, f"{year}-13-45", "p")
            (tmp_path / f"{year}-QTR{q}.idx").write_bytes(text.encode("latin-1"))
    (tmp_path / "readme.txt").write_text("no index")
    folder = f"file://{tmp_path}"
    d = form_index.read_index(spark, folder)
    assert d.count() == 18 and [f.name for f in d.schema] == ["form", "company", "cik", "filed", "path", "year", "quarter"] and d.rdd.getNumPartitions() == 6
    some = form_index.read_index(spark, folder, ("10-K", "10-K405"), 2020, 2020)
    assert some.count() == 4 and some.rdd.getNumPartitions() == 2
    own = [("10-K", "ACME & SONS 2020", 7, dt.date(2020, 1, 15), "edgar/data/7/20201.txt", 2020, 1), ("10-K", "ACME & SONS 2020", 7, dt.date(2020, 4, 15), "edgar/data/7/20202.txt", 2020, 2)]
    assert [tuple(r) for r in some.filter("cik = 7").orderBy("quarter").collect()] == own
    # Filters of one query don't stay for the next.
    assert d.filter("year = 2020 and form = '10-K'").count() == 2 and d.filter("year = 1990").count() == 0 and d.count() == 18 and d.filter("year = 2019").union(d.filter("year = 2021")).count() == 12
    assert form_index.read_index(spark, folder, first_year=1990, last_year=1991).count() == 0
    bad = form_index.read_index(spark, folder, errors=True).collect()
    assert len(bad) == 12 and {r["text"] for r in bad if "BAD" not in r["text"]} == {"broken line"} and {r["line"] for r in bad} == {8, 10}
