"""Markup, dictionary scores, symbols, grounding, pasted holdings, events, mapping, stores and streams."""

import datetime as dt

import psutil
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import filings as FI
from tidemark.operators import names as N
from tidemark.operators import textops as T
from tidemark.sources import stores as ST
from tidemark.streaming import shadow

D = dt.date.fromisoformat


def one(spark, col, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return d.select(col).first()[0]


def test_html(spark):
    page = "<html><head><title>x</title></head><script>a<b</script><p>A &amp;&nbsp;B</p>\n<!-- c --><b>C &copy; D</b>"
    assert one(spark, T.html_to_text(F.col("h")), h=page) == "A & B C &copy; D"
    d = spark.createDataFrame([(page,), (None,)], "html string")
    assert [r["text"] for r in T.html_to_text_full(d).collect()] == ["A & B C © D", None]


def test_all_entities_in_pieces(spark, monkeypatch):
    """Pieces of any size give each row its own text: long and empty ones, nulls, a piece that ends with its batch."""
    texts = [None if k % 7 == 0 else "" if k % 5 == 0 else f"<p>{k}&copy;&nbsp;&amp;lt; &notit; &#x20AC" + "x" * (k % 11 * 9) for k in range(200)]
    want = [None if t is None else t and f"{k}\u00a9 &lt; \u00acit; \u20ac" + "x" * (k % 11 * 9) for k, t in enumerate(texts)]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, html string").repartitionByRange(3, "k")
    for size in (1, 64, 10_000, T.PIECE):
        monkeypatch.setattr(T, "PIECE", size)
        assert [r["text"] for r in T.html_to_text_full(d).orderBy("k").collect()] == want


def test_all_entities_hold_no_batch_of_results(spark):
    """Over 10,000 pages of 4 KB, which are one Arrow batch, a worker grows by less than three times their bytes."""
    workers = lambda: {p.pid for p in psutil.Process().children(recursive=True) if "python" in p.name()}
    said = lambda pid, what: next(int(x.split()[1]) >> 10 for x in open(f"/proc/{pid}/status") if x.startswith(what))
    run = lambda n: T.html_to_text_full(spark.range(0, n, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("a &copy; b "), 400)).alias("html"))).write.format("noop").mode("overwrite").save()
    run(10)
    before = {}
    for pid in workers():
        with open(f"/proc/{pid}/clear_refs", "w") as f:  # the peak starts anew
            f.write("5")
        before[pid] = said(pid, "VmRSS")
    run(10_000)
    assert max(said(pid, "VmHWM") - before.get(pid, min(before.values())) for pid in workers()) < 3 * 44


def test_keyword_counts_and_threshold(spark):
    text = "Data\n centers and a datacenter, GPUs; HPC. High-performance computing accelerator datacentre " + "w " * 900
    hits = T.count_hits(F.col("t"))
    assert one(spark, hits["compute"], t=text) == 6 and one(spark, hits["ai"], t=text) == 0
    d = spark.createDataFrame([("3674", text), ("4911", text), ("2834", text), ("3674", None)], "sic string, text string")
    rows = T.score_text(d).collect()
    assert [r["eligible_text"] for r in rows] == [True, False, False, False] and rows[3]["words"] == 0


def test_terms_that_overlap_are_counted_apart(spark):
    assert [len(T.term_patterns(t)) for t in T.DICTIONARY.values()] == [1] * 5
    assert len(T.term_patterns(("a b", "b c", "x"))) == 2 and len(T.term_patterns(("a", "a b"))) == 2 and T.may_overlap("a a", "a a")
    assert one(spark, T.count_hits(F.col("t"), {"g": ("a b", "b c", "b", "x y")})["g"], t="a b c, A  B x\ny b") == 2 + 1 + 3 + 1
    assert one(spark, T.word_count(F.col("t")), t=" a\u00a0b\n c ") == 3 and one(spark, T.word_count(F.col("t")), t=" ") == 0


def test_symbols_and_form_index(spark):
    t = 'under the symbol "ABC" and the INC Nasdaq; BRK.A New York Stock Exchange; under the symbols ABC'
    assert one(spark, T.symbols(F.col("t")), t=t) == "ABC|BRK.A"
    lines = spark.createDataFrame([("10-K        Acme Corp  Inc     123  2020-02-03  edgar/data/123/0001-20-000001.txt",), ("10-K/A      Acme     123  2020-02-03  edgar/x.txt",), ("junk",)], "value string")
    r = T.parse_form_index(lines).collect()
    assert len(r) == 1 and (r[0]["company"], r[0]["cik"], r[0]["acc"]) == ("Acme Corp  Inc", 123, "0001-20-000001")


def test_excerpts_in_pieces(spark, monkeypatch):
    texts = [None if k % 7 == 0 else f"cover {k} Item 1. Business " + f"w{k} " * (k % 5 * 60) + "Item 2. rest" for k in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartitionByRange(3, "k")
    for size in (1, 900, T.PIECE):
        monkeypatch.setattr(T, "PIECE", size)
        assert [(r["text"], r["excerpt"], r["method"]) for r in T.excerpts(d).orderBy("k").collect()] == [(t, *T.business_section(t or "")) for t in texts]


def test_excerpt_and_anonymous(spark):
    body = "word " * 150
    assert T.business_section(f"Item 1. Business 5 Item 1A. Item 1. Business {body}Item 1A. Risk")[1] == "item1"
    assert T.business_section("see Item 1. Business nothing") == ("see Item 1. Business nothing", "cover")
    toc = "Item 1. Business 3 Item 1A. Risk Factors 12 ITEM 1. BUSINESS Overview " + "sell switches " * 60 + "see \u201cItem 1A. Risk Factors,\u201d " + "we sell " * 60 + "ITEM 1A. RISK FACTORS may fall. For more see Item 1. Business. " + "text " * 900
    out, method = T.business_section(toc)
    assert method == "item1" and out.startswith("Overview sell") and out.count("we sell") == 60 and "RISK FACTORS" not in out
    assert len(T.business_section("Item 1. Business " + "w " * 3000 + "Item 2.")[0].split()) == 1500
    assert T.business_section("FORM 10-K Indicate by check mark whether yes. We sell.") == ("whether yes. We sell.", "cover")
    assert N.masked("Acme Holdings, Inc. and ACME now trade as NOW; now.", ["Acme Holdings Inc"], ["NOW"]) == "the Company and the Company now trade as the Company; now."
    assert N.name_variants(["Acme Holdings Inc /DE/"]) == ["Acme Holdings Inc", "Acme Holdings", "Acme"]
    # Expected values of the behaviour to match.
    names = ["NVIDIA CORP/CA", "Mellanox Technologies, Ltd.", "ACTIVE POWER INC (2000-07-03..2016-11-29)", None, ""]
    text = "NVIDIA Corporation and Nvidia sell GPUs. Mellanox Technologies, Ltd. and Mellanox  Technologies merged. Active Power, Inc. sells UPS. Shares trade as NVDA and MLNX. Invidia and nvidias stay; now is fine; powerful active power supplies."
    assert N.masked(text, names, ["NVDA", "MLNX", "NOW", "A", ""]) == "the Company and the Company sell GPUs. the Company. and the Company merged. the Company sells UPS. Shares trade as the Company and the Company. Invidia and nvidias stay; now is fine; powerful active power supplies."
    assert {"APPLIED MATERIALS INC", "APPLIED MATERIALS", "Corporate Office Properties", "Salesforce"} <= set(N.name_variants(["APPLIED MATERIALS INC /DE", "Corporate Office Properties, L.P.", "Salesforce, Inc."]))
    d = spark.createDataFrame([("Acme L.P. is ACME, Co.", ["Acme, L.P."], ["X"]), (None, None, None), ("Yahoo! Inc. and Yahoo", ["Yahoo! Inc"], None)], "text string, names array<string>, tickers array<string>")
    assert [r["text"] for r in N.anonymize(d).collect()] == ["the Company is the Company", "", "the Company. and Yahoo"]


def test_grounding(spark):
    say = "up 42% to $1.2T with 3 names in 2019, 41.5% or 7,000"
    known = T.numbers(F.lit("a 41.5% b 7000"))
    assert one(spark, T.ungrounded(T.numbers(F.col("t")), known), t=say) == ["$1.2T"]
    assert one(spark, T.ungrounded(T.numbers(F.col("t")), T.numbers(F.lit("9"))), t=say) == ["42%", "$1.2T", "41.5%", "7,000"]


def test_holdings_paste(spark):
    d = spark.createDataFrame([(1, "# mine\naapl, 3, $10.5\n\nMSFT,1,2 # x"), (2, "aapl, 3, 10\nAAPL, 1, 1"), (3, "x y, 1, 2\nb, -1, 2\nc, 1"), (4, None)], "id int, text string")
    rows, errors = T.parse_holdings(d)
    assert [tuple(r) for r in rows.orderBy("ticker").collect()] == [(1, "AAPL", 3.0, 10.5), (1, "MSFT", 1.0, 2.0)]
    assert [(r["id"], r["line"], r["fault"]) for r in errors.orderBy("id", "line").collect()] == [(2, 2, "duplicate"), (3, 1, "bad ticker"), (3, 2, "bad number"), (3, 3, "need ticker, shares, cost")]


def test_severe_events(spark):
    d = spark.createDataFrame([(1, ["8-K", "8-K", "10-Q", "8-K", "8-K"], ["2026-09-12", "2026-08-13", "2026-09-01", "2026-09-27", "2026-09-02"], ["4.01,9.01", "1.03", "4.02", "4.02", "9.01"])], "entity int, form array<string>, filingDate array<string>, items array<string>")
    got = lambda n: [(str(r["date"]), r["items"]) for r in T.severe_events(d, F.lit("2026-09-27").cast("date"), n).orderBy("date").collect()]
    assert got(45) == [("2026-09-12", ["4.01"])] and got(46)[0] == ("2026-08-13", ["1.03"])


def test_formats(spark):
    assert [one(spark, S.ordinal(F.col("n")), n=n) for n in (1, 2, 3, 4, 11, 12, 21, 112)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "21st", "112th"]
    assert [one(spark, S.money(F.col("v")), v=v) for v in (1.25e12, 3.4e11, 1.2e9, 9.99e6, 1234.5)] == ["$1.2T", "$340B", "$1.2B", "$10.0M", "$1,234"]
    assert [one(spark, S.signed_percent(F.col("v")), v=v) for v in (0.12, -0.034, -0.001)] == ["+12%", "-3%", "+0%"]
    assert one(spark, S.iso_week(F.col("d").cast("date")), d="2024-12-30") == "2025-W01"
    assert one(spark, S.sic_group(F.col("s")), s="3576") == "network" and one(spark, S.in_group(F.col("s")), s="n/a") is False


def test_latest_then_filter(spark):
    d = spark.createDataFrame([(2, "b", D("2014-03-01"), True, False), (2, "a", D("2014-02-01"), True, True), (3, "c", D("2015-02-01"), True, True)], "cik int, acc string, filed date, in_group boolean, eligible_text boolean")
    assert [(r["year"], r["cik"]) for r in FI.eligible(d).collect()] == [(2016, 3)]


def test_ticker_mapping(spark):
    elig = spark.createDataFrame([(2020, 1, D("2019-03-01")), (2020, 2, D("2019-03-01")), (2020, 3, D("2019-04-01")), (2020, 4, D("2019-04-01"))], "year int, cik int, filed date")
    own = spark.createDataFrame([(1, 0, "AAA"), (2, 0, "ZZZ")], "cik int, pos int, ticker string")
    stated = spark.createDataFrame([(2, 0, D("2019-03-01"), "AAA"), (3, 0, D("2019-04-01"), "OLD")], "cik int, pos int, filed date, ticker string")
    lst = spark.createDataFrame([("AAA", 1, D("2010-01-01"), D("2026-12-31"), "NYSE"), ("OLDQ", 3, D("2011-01-01"), D("2020-06-01"), "NYSE")], "ticker string, owner int, start date, end date, exchange string")
    got = {r["cik"]: (r["status"], r["ticker"], r["kept"]) for r in FI.map_tickers(elig, own, stated, lst).collect()}
    assert got == {1: ("listed", "AAA", True), 2: ("delisted", "AAA", False), 3: ("delisted", "OLDQ", True), 4: ("unmapped", None, True)}


def test_stores(spark, tmp_path):
    p = spark.createDataFrame([("A", D("2024-01-01"), 1.0), ("A", D("2024-01-02"), 2.0), ("B", D("2024-01-01"), 3.0)], "ticker string, d date, close double")
    new = spark.createDataFrame([("A", D("2024-01-02"), 9.0), ("A", D("2024-01-03"), None)], p.schema)
    assert sorted((r["ticker"], r["close"]) for r in ST.replace_history(p, new).collect()) == [("A", 9.0), ("B", 3.0)]
    ST.write_partitioned(p, f"file://{tmp_path}/p", "ticker")
    ST.write_partitioned(new.na.drop(), f"file://{tmp_path}/p", "ticker")
    assert sorted(r["close"] for r in ST.load_closes(spark, f"file://{tmp_path}/p").collect()) == [3.0, 9.0]
    snaps = spark.createDataFrame([("A", D("2026-09-20"), False), ("B", D("2026-09-20"), True), ("C", D("2026-09-20"), None), ("A", D("2026-09-26"), True), ("B", D("2026-09-26"), False), ("C", D("2026-09-26"), True)], "ticker string, date date, trend boolean")
    assert {r["ticker"]: r["change"] for r in ST.changes(snaps).collect()} == {"A": "up", "B": "down"}
    once = ST.insert_absent(snaps, snaps, ["ticker", "date"])
    assert once.count() == snaps.count()


def test_universe_first_category_wins(spark):
    u = ST.universe(spark, '[categories.a]\nname = "A"\ngroup = "x"\ntickers = ["t1", "t2"]\n[categories.b]\ntickers = ["T2", "t3"]\n[laggards]\ntickers = ["l1"]')
    assert [(r["ticker"], r["category"], r["is_laggard"]) for r in u.orderBy("pos").collect()] == [("T1", "a", False), ("T2", "a", False), ("T3", "b", False), ("L1", None, True)]


def test_shadow_stream_is_idempotent(spark, tmp_path):
    cols = "strategy string, month string, fill_date date, sells array<string>, buys array<string>, contrib double, ts timestamp"
    rows = [("s", "2026-01", D("2026-02-02"), [], ["A"], 1.0, dt.datetime(2026, 2, 2)), ("s", "2026-01", D("2026-02-02"), [], ["A"], 1.0, dt.datetime(2026, 2, 2)), ("t", "2026-01", D("2026-02-02"), [], ["B"], 1.0, dt.datetime(2026, 2, 2))]
    src = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(src)
    q = shadow.advance(spark.readStream.schema(cols).parquet(src)).writeStream.format("memory").queryName("shadow").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    spark.createDataFrame([("s", "2026-02", D("2026-03-02"), ["A"], [], 1.0, dt.datetime(2026, 3, 2)), rows[0]], cols).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert sorted((r["strategy"], r["month"]) for r in spark.table("shadow").collect()) == [("s", "2026-01"), ("s", "2026-02"), ("t", "2026-01")]
    log = spark.createDataFrame([("s", "2026-01")], "strategy string, month string")
    plans = spark.createDataFrame([(*r[:6],) for r in rows], "strategy string, month string, fill_date date, sells array<string>, buys array<string>, contrib double")
    assert [r["strategy"] for r in shadow.due(plans, log, "2026-02-03").collect()] == ["t"] and shadow.due(plans, log, "2026-02-02").count() == 0


def test_delimited_files_and_schemas(spark, tmp_path):
    from tidemark.sources import feeds

    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text("cik,filed,ok\n1,2024-02-03,true\nx,2024-02-03,true\n2,,\n")
    rows, errors = feeds.read_delimited(spark, f"file://{path}", "cik long, filed date, ok boolean")
    assert [tuple(r) for r in rows.orderBy("cik").collect()] == [(1, D("2024-02-03"), True), (2, None, None)] and [r["line"] for r in errors.collect()] == ["x,2024-02-03,true"]
    feeds.write_delimited(rows, f"file://{tmp_path}/out")
    again, bad = feeds.read_delimited(spark, f"file://{tmp_path}/out", "cik long, filed date, ok boolean")
    assert again.count() == 2 and bad.count() == 0
    h = feeds.conform(spark.createDataFrame([("A", 1, "x")], "ticker string, shares int, other string"), "holdings")
    assert h.dtypes == [("ticker", "string"), ("shares", "double"), ("cost", "double"), ("added", "date")] and tuple(h.first()) == ("A", 1.0, None, None)


def test_write_once_vendor_rows_and_symbol_lists(spark, tmp_path):
    import pytest

    d = spark.createDataFrame([("a.b", "NYSE", "Stock", "USD", "2020-01-01", "2021-01-01"), ("c", "NYSE", "ETF", "USD", "2020-01-01", "2021-01-01"), ("d", "LSE", "Stock", "USD", "2020-01-01", "2021-01-01"), ("e", "NASDAQ", "Stock", "USD", "2020-01-01", "")], "ticker string, exchange string, assetType string, priceCurrency string, startDate string, endDate string")
    assert [(r["ticker"], r["start"]) for r in ST.vendor_listings(d).collect()] == [("A.B", D("2020-01-01"))]
    ST.write_once(d, f"file://{tmp_path}/once")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        ST.write_once(d, f"file://{tmp_path}/once")
    assert one(spark, S.symbols_list(F.col("t"), ("INC",)), t="abc| brk.a||inc|") == ["ABC", "BRK-A"]


def test_plans_wait_for_a_complete_fill_day(spark):
    cols = "strategy string, month string, fill_date date, sells array<string>, buys array<string>, contrib double"
    plans = spark.createDataFrame([("a", "2026-01", D("2026-02-02"), [], ["X", "Y"], 1.0), ("b", "2026-01", D("2026-02-02"), ["Z"], ["X"], 1.0), ("c", "2025-12", D("2026-01-02"), [], ["Y"], 1.0), ("d", "2026-01", D("2026-02-02"), [], ["Q"], 1.0)], cols)
    log = spark.createDataFrame([], "strategy string, month string")
    closes = spark.createDataFrame([("X", D("2026-02-02")), ("Y", D("2026-01-30")), ("Z", D("2026-02-02"))], "ticker string, d date")
    got = lambda *c: sorted(r["strategy"] for r in shadow.due(plans, log, "2026-02-03", *c).collect())
    assert got() == ["a", "b", "c", "d"] and got(closes) == ["b", "c", "d"]  # Y trades, but its last day isn't there yet; Q has no closes at all


def test_refresh_writes_new_rows_only(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    run = lambda: shadow.refresh(spark.readStream.schema("ticker string, n int").parquet(src), out, f"file://{tmp_path}/cp")
    for k in range(3):
        spark.createDataFrame([(f"t{k}", k)], "ticker string, n int").write.mode("append").parquet(src)
        run()
        run()
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [0, 1, 2]


def test_changes_with_new_events(spark):
    snaps = spark.createDataFrame([("A", D("2026-09-20"), False), ("A", D("2026-09-26"), True), ("B", D("2026-09-26"), True)], "ticker string, date date, trend boolean")
    events = spark.createDataFrame([("B", D("2026-09-21")), ("B", D("2026-09-22")), ("A", D("2026-09-20")), ("C", D("2026-09-25"))], "ticker string, date date")
    assert sorted((r["ticker"], r["change"]) for r in ST.changes_with_events(snaps, events).collect()) == [("A", "up"), ("B", "sec")]


def test_facts_of_an_analysis(spark):
    from tidemark.operators import live

    row = (1234.5, 0.125, -0.345, 0.4512, True, False, 0.93, "NO UPTREND", None, 2.5e12, 23.44, 0.0456, (3.0, 1.0), False, [(D("2026-09-12"), ["4.01"], ["auditor change"])], [(None, None, "First"), ("2026-09-01", "Wire", ""), ("2026-09-02", "Wire", "Second")])
    cols = "price double, ret_1m double, dd_52w double, vol_252 double, above200 boolean, trend boolean, mom double, rule string, sector string, market_cap double, forward_pe double, earnings_yield double, eps_rev struct<up30:double,down30:double>, fund_pit boolean, sec_flags array<struct<date:date,items:array<string>,labels:array<string>>>, news array<struct<date:string,publisher:string,title:string>>"
    d = spark.createDataFrame([row], cols)
    assert d.select(live.analysis_facts(d.columns)).first()[0] == {
        "price": "$1,234.50", "ret_1m": "+12%", "from_52w_high": "-34%", "volatility_1y": "45%", "above_200dma": "yes", "trend_gate": "fails", "momentum_pct": "93rd percentile", "rule_status": live.RULE_STATUS["NO UPTREND"],
        "market_cap": "$2.5T", "forward_pe": "23.4x", "earnings_yield": "4.6%", "eps_revisions_30d": "3 up / 1 down", "fundamentals_source": "Yahoo, not point-in-time", "sec_8k_last_45d": "2026-09-12 Item 4.01 auditor change",
        "news_1": "undated · unknown · First", "news_2": "2026-09-02 · Wire · Second"}
    assert [one(spark, S.fixed(F.col("v")), v=v) for v in (0.125, 2.0)] == ["0.12", "2.00"] and one(spark, S.grouped(F.col("v"), 0), v=1234567.0) == "1,234,567"
    assert one(spark, S.dashed(F.col("t")), t=" brk.b ") == "BRK-B" and one(spark, S.config_name(*(F.lit(x) for x in ("W2", "G1", "S2", "Nvar"))), t="") == "W2-G1-S2-Nvar"
    assert one(spark, S.percent(F.lit(None).cast("double")), t="") == S.MISSING


def test_index_page_ranks(spark):
    """Own block before others whatever their order, first annual form, else the largest readable document; null pages."""
    from tidemark.operators import filing_scan as FS

    line = lambda *cells: "<TR class='x'>" + "".join(f'<td scope="row">{c}</td>' for c in cells) + "</TR>"
    doc = lambda href, kind, size: line(1, "d", f'<a href="{href}">f</a>', kind, size)
    other, own = '<div class="companyInfo">CIK=0000000009 SIC=6770</div>', '<div class="companyInfo">CIK=0000000007 SIC</acronym>: <b> <i>3674</b></div>'
    rest = doc("/a/ex.htm", "EX-99", "9,999") + doc("/a/p.htm", "", "120") + doc("/a/q.TXT", "cover", "12 0") + doc("/a/0000000001-20-000001.txt", "", 99999) + line(1, 2, 3) + "<tr><td>1</td><td>no link</td><td></td><td>10-K</td><td>5</td></tr>"
    pages = [
        other + own + rest + doc("/ix?doc=/a/main.htm", "<b>10-k405</b>", 3) + doc("/a/second.htm", "10-K", 9), own + rest, other + "<div class=\"companyInfo\">CIK=0000000007</div>", rest.replace("/a/p.htm", "/a/p.pdf").replace("q.TXT", "q.jpg"), "", None]
    d = spark.createDataFrame(list(enumerate(pages)), "i int, page string").select("i", FS.index_page(F.col("page"), F.lit(7)).alias("x")).select("i", "x.*").orderBy("i")
    at = "https://www.sec.gov/a/"
    assert [tuple(r)[1:] for r in d.collect()] == [(3674, at + "main.htm"), (3674, at + "q.TXT"), (6770, None), (None, None), (None, None), (None, None)]
