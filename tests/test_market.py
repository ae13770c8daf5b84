import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import display as Y
from tickerloom.functions import text as X
from tickerloom.functions.guards import clip, ensure_columns, nan_to_null, ratio
from tickerloom.operators import dialogue as G
from tickerloom.operators import portfolio as P
from tickerloom.operators import snapshot as M


def column(spark, kind, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[1] for r in df.select("k", make(F.col("x"))).orderBy("k").collect()]


def test_amount_texts(spark):
    money = column(spark, "double", [2.5e12, 1e9, 3.456e6, 999.0, 12345.6], lambda x: Y.abbrev_money(x))
    assert money == ["$2.50T", "$1.00B", "$3.46M", "$999", "$12,346"]
    assert column(spark, "double", [3.456e6], lambda x: Y.abbrev_money(x, ("T", "B"))) == ["$3,456,000"]
    assert column(spark, "double", [65000.125, 580.0, 0.52], Y.tiered_price_text) == ["$65,000.13", "$580.0000", "$0.520000"]
    assert column(spark, "double", [1.234, -0.001, None, 0.0], Y.signed_pct_text) == ["+1.23%", "-0.00%", "+0.00%", "+0.00%"]


def test_bands_votes_and_words(spark):
    assert column(spark, "int", [20, 21, 60, 80, 81, None], Y.sentiment_band) == [
        "Extreme Fear", "Fear", "Neutral", "Greed", "Extreme Greed", None
    ]
    assert column(spark, "int", [1, 0, None], lambda x: Y.vote_sentiment(x, F.lit(0))) == ["bullish", "neutral", "neutral"]
    assert column(spark, "int", [2, 3, None], Y.hot_flag) == [False, True, False]
    assert column(spark, "string", ["UP", "DOWN", "NEUTRAL", "?"], Y.signal_text) == ["BUY", "SELL", "HOLD", None]


def test_fixed_places_are_those_of_the_double_itself(spark):
    """2.275 is a little less than 2.275, which its shortest decimal form does not show; real ties go to the even digit."""
    draw = random.Random(3)
    near = [k / 1000 for k in range(5, 4000, 10)] + [10**k * draw.random() for k in range(-12, 9) for _ in range(40)]
    values = [*near, *[k / 10**7 for k in range(5, 2000, 10)], 1e9 / 3, 0.125, 0.375, 2.275, 0.0, 999.995, 0.9999995]
    for places in (1, 2, 4, 6):
        assert column(spark, "double", values, lambda x, p=places: Y.fixed(x, p)) == [f"{v:.{places}f}" for v in values]
    assert column(spark, "double", [2.275e6, 6.805e9], lambda x: Y.abbrev_money(x)) == ["$2.27M", "$6.80B"]
    odd = [None, float("nan"), float("inf"), -2.275]
    assert column(spark, "double", odd, lambda x: Y.fixed(x, 2)) == ["null", "NaN", "Infinity", "-2.27"]


def test_ages(spark):
    now = F.lit("2024-01-02 00:00:00")
    texts = ["2024-01-01T23:59:30Z", "2024-01-01T23:50:00+00:00", "2024-01-01T20:30:00Z", "2023-12-01T00:00:00Z", "", None, "not a date at all"]
    assert column(spark, "string", texts, lambda x: X.humanize_age(x, now)) == ["30s ago", "10m ago", "3h ago", "32d ago", "", "", "not a date"]


def test_texts(spark):
    assert column(spark, "string", ["btc-usdt", " eth USDT"], X.clean_ticker) == ["BTC", "ETH"]
    page = "<p>" + "a" * 900 + "<br\n/>b</p>"
    assert column(spark, "string", [page], X.strip_html) == ["a" * 900 + "b"]
    assert column(spark, "string", [page], X.description) == ["a" * 800]
    lookup = lambda x: X.containment_lookup(x, ["DeFi", "Market Analysis"], "Education")
    assert column(spark, "string", ["what is defi?", "market", "zzz"], lookup) == ["DeFi", "Market Analysis", "Education"]
    docs = spark.createDataFrame([(1, "x\n" * 60 + "é"), (2, ""), (3, "Word")], "doc_id int, text string")
    parts = X.chunk_text(docs, "text").orderBy("doc_id", "chunk_no").collect()
    assert "".join(r.chunk for r in parts if r.doc_id == 1) == "x\n" * 60 + "é"
    assert [len(r.chunk) for r in parts] == [50, 50, 21, 4]
    assert [r.doc_id for r in X.keyword_filter(docs, "text", "wORD").collect()] == [3]


def test_guards(spark):
    assert column(spark, "double", [-9.0, 0.1, 9.0, None], lambda x: clip(x, -0.5, 5.0)) == [-0.5, 0.1, 5.0, None]
    assert column(spark, "double", [0.0, 2.0, None], lambda x: ratio(F.lit(1.0), x)) == [0.0, 0.5, 0.0]
    assert column(spark, "double", [float("nan"), 1.0], nan_to_null) == [None, 1.0]
    df = ensure_columns(spark.createDataFrame([(1,)], "a int"), {"a": 9, "b": 2.0})
    assert df.first().asDict() == {"a": 1, "b": 2.0}


def replay(log):
    """The statements applied one after another."""
    table = {}
    for seq, op, key, coin, qty, price in sorted(log):
        if op == "add":
            table[key] = [coin, qty, price]
        elif op == "update" and key in table:
            table[key][1:] = [qty, price]
        elif op == "delete":
            table.pop(key, None)
        elif op == "clear":
            table.clear()
    return {k: tuple(v) for k, v in table.items()}


@pytest.mark.parametrize("seed", range(4))
def test_positions_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    log, added = [], 0
    for seq in range(300):
        op = rng.choices(["add", "update", "delete", "clear"], [5, 4, 3, 0.1])[0]
        if op == "add":
            added += 1
            log.append((seq, op, added, f"C{added % 5}", rng.random(), rng.random()))
        elif op == "clear":
            log.append((seq, op, None, None, None, None))
        else:
            values = (rng.random(), rng.random()) if op == "update" else (None, None)
            log.append((seq, op, rng.randint(1, added + 5), None, *values))
    schema = "seq long, op string, id long, coin string, qty double, buy_price double"
    df = spark.createDataFrame(log, schema).withColumn("added_at", F.lit(None).cast("timestamp")).repartition(3)
    got = {r.id: (r.coin, r.qty, r.buy_price) for r in P.positions_current(df).collect()}
    assert got == replay(log)
    assert P.position_count(df).first()[0] == len(got)


def test_valuation(spark):
    positions = spark.createDataFrame([(1, "A", 2.0, 10.0), (2, "A", 1.0, 0.0), (3, "Z", 1.0, 5.0)], "id long, coin string, qty double, buy_price double")
    prices = spark.createDataFrame([("A", 12.0)], "symbol string, price_usd double")
    marked = P.mark_to_market(positions, prices)
    rows = {r.id: r for r in marked.collect()}
    assert (rows[1].cost, rows[1].value, rows[1].pnl, rows[1].pnl_pct) == (20.0, 24.0, 4.0, 20.0)
    assert rows[2].pnl_pct is None and rows[3].value is None
    totals = P.portfolio_totals(marked).first()
    assert (totals.invested, totals.current_value, totals.pnl, totals.n_positions) == (25.0, 36.0, 16.0, 3)
    assert {r.coin: r.share for r in P.allocation(marked).collect()} == {"A": 1.0, "Z": None}
    nothing = P.portfolio_totals(marked.filter("id > 9")).first()
    assert (nothing.invested, nothing.pnl_pct, nothing.n_positions) == (0.0, 0.0, 0)


def listing(spark, n):
    rows = [(f"S{k:02d}", dt.date(2020, 1, 1), 10.0 + k, float(100 - k), 5.0, None if k == 3 else float(k - 4)) for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, price_usd double, market_cap double, volume_24h double, change_24h double")


def test_listing_reports(spark):
    table = listing(spark, 40)
    assert [r.rank for r in M.market_topn(table, 3).collect()] == [1, 2, 3]
    assert [M.market_topn(listing(spark, 450), n).count() for n in (3, 300, 400)] == [3, 300, 400]
    moved = M.top_bottom_movers(table, 2).orderBy("side", "place").collect()
    assert [(r.side, r.symbol) for r in moved] == [("gainer", "S39"), ("gainer", "S38"), ("loser", "S00"), ("loser", "S01")]
    heat = M.heatmap_table(table, 5).collect()
    assert [r.label for r in heat] == ["S00<br>-4.00%", "S01<br>-3.00%", "S02<br>-2.00%", "S04<br>+0.00%", "S05<br>+1.00%"]
    ticker = M.latest_by_ticker(table, F.lower(F.substring("symbol", 1, 2)), [-F.col("market_cap")]).collect()
    assert {(r.ticker, r.symbol) for r in ticker} == {("S0", "S09"), ("S1", "S19"), ("S2", "S29"), ("S3", "S39")}


def test_per_source_limit_is_applied_before_the_shuffle(spark):
    rows = [("hot", k) for k in range(500)] + [("cold", k) for k in range(3)]
    kept = M.limit_per_source(spark.createDataFrame(rows, "source string, n int"), [F.asc("n")])
    assert sorted((r.source, r.n) for r in kept.collect()) == [("cold", k) for k in range(3)] + [("hot", k) for k in range(8)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_context_text(spark):
    index = spark.createDataFrame([(31, "Fear")], "value int, label string")
    text = M.context_block(listing(spark, 30), index, "2024-01-01 00:00 UTC").first()[0].split("\n")
    assert text[0] == "[LIVE MARKET CONTEXT — 2024-01-01 00:00 UTC]" and text[1] == "Fear & Greed Index: 31/100 — Fear"
    assert text[4] == "BTC Dominance: 0.0%" and text[6] == "Live Coin Prices:" and len(text) == 7 + 25
    assert text[7] == "  S00 (S00) = $10.0000 (-4.00% 24h)"
    empty = M.context_block(listing(spark, 1).filter("false"), index, "x").first()[0]
    assert empty == "No market data."


def test_verdicts(spark):
    rows = [(1.0, 0.2, 1.0), (-1.0, -0.2, 1.0), (-1.0, -0.2, 9.0), (0.0, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "s double, r double, v double")
    verdict = M.analyst_verdict(F.col("s"), F.col("r"), F.col("v"), F.lit(30))
    assert [r[0] for r in df.select(verdict).collect()] == ["Bullish", "Contrarian Buy", "Bearish", "Watch"]


def test_dialogue(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "user", "price?")],
        "conv_id long, turn long, role string, text string",
    )
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in G.prompt_assembly(turns, F.lit("CTX")).collect()}
    assert got == {
        (1, 0): ("model", "be kind"),
        (1, 1): ("user", "hi"),
        (1, 2): ("user", "CTX\n\nUser question: hello"),
        (2, 0): ("user", "CTX\n\nUser question: price?"),
    }
    content = G.content_json(G.prompt_assembly(turns.filter("conv_id = 2"), F.lit("C"))).first().content
    assert content == '{"role":"user","parts":[{"text":"C\\n\\nUser question: price?"}]}'


def test_responses(spark):
    payloads = [
        '{"candidates":[{"content":{"parts":[{"text":" a"},{"text":"b "}]}}]}',
        '{"candidates":[]}',
        '{}',
        '{"candidates":[{"content":{"parts":[]},"finishReason":"SAFETY"}]}',
        '{"candidates":[{"finishReason":"MAX"}]}',
    ]
    got = column(spark, "string", payloads, G.response_extract)
    assert got == ["ab", G.NO_CANDIDATES, G.NO_CANDIDATES, G.EMPTY_TEXT % "SAFETY", G.EMPTY_TEXT % "MAX"]
