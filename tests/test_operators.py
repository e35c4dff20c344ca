"""Joins, order, trades, text measures and streams on small tables."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from bidsmith.functions import sequences
from bidsmith.functions import text as X
from bidsmith.operators import joins, rows, trades
from bidsmith.streaming import state

D = dt.date


def test_asof_both_ways(spark):
    left = spark.createDataFrame([(1, 7, D(2024, 1, 10)), (2, 7, D(2024, 3, 1)), (3, 8, D(2024, 1, 1))], "i int, k int, d date")
    right = spark.createDataFrame([(7, D(2024, 1, 10), "a"), (7, D(2024, 1, 12), "b"), (7, D(2024, 2, 1), "c")], "k int, w date, t string")
    ahead = {r.i: r.w for r in joins.forward_asof(left, right, "k", "d", "w", 30, ["w", "t"]).collect()}
    assert ahead == {1: D(2024, 1, 10), 2: None, 3: None}
    back = {r.i: (r.w, r.t) for r in joins.backward_asof(left, right, "k", "d", "w", None, ["w", "t"]).collect()}
    assert back == {1: (D(2024, 1, 10), "a"), 2: (D(2024, 2, 1), "c"), 3: (None, None)}


def test_keep_first_and_consecutive(spark):
    df = spark.createDataFrame([("T", "1", 5), ("T", "1", 9), ("U", "1", 1), ("T", "", 1), ("T", "", 2), ("T", None, 3)], "g string, i string, a int")
    assert sorted((r.g, r.i or "", r.a) for r in rows.keep_first(df, "g", "i", [F.desc("a")]).collect()) == [("T", "", 1), ("T", "", 2), ("T", "", 3), ("T", "1", 9), ("U", "1", 1)]
    lines = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "A")], "s int, n int, x string")
    assert [r.x for r in rows.consecutive(lines, "s", ["n"], "x").orderBy("n").collect()] == ["A", "B", "A"]


def bars(*days):
    return [(D(2024, 1, 1) + dt.timedelta(i), *map(float, d)) for i, d in enumerate(days)]


def test_bracket(spark):
    flat = (10, 10, 10, 10)
    cases = [bars(flat, (10, 13, 10, 12)), bars(flat, (10, 13, 9, 10)), bars(flat, flat, (10, 10, 10, 11)), bars(flat), bars((0, 0, 0, 0), flat)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, bars array<struct<trade_date: date, open: double, high: double, low: double, close: double>>")
    got = {r.i: (r.outcome, r.exit_day, r.pnl_pct) for r in trades.simulated(df, 0.2, 0.06, 3).collect()}
    assert got == {0: ("TP", 1, 20.0), 1: ("SL", 1, -6.0), 2: ("TIME", 2, 10.0)}


def test_summary_and_drawdown(spark):
    gains = [0.0, -6.0, 3.0, 1.0, -6.0, 1.0, 0.88]
    df = spark.createDataFrame([(1, i, g, "TIME") for i, g in enumerate(gains)], "k int, i int, pnl_pct double, outcome string")
    s = trades.summary(df).first()
    assert (s.n_trades, s.n_wins, s.win_rate, s.total_pnl) == (7, 4, 57.14, -6.12)
    assert trades.drawdowns(df, "k", ["i"]).agg(F.min("drawdown")).first()[0] == -8.0


def test_sizing(spark):
    df = spark.createDataFrame([(200.0, 1.0), (200.01, 1.0), (66.0, 1.0), (0.5, 1.0), (0.0, 50.0), (0.0, 0.0)], "ask double, bid double")
    assert [(r.price, r.qty) for r in trades.sized(df).collect()] == [(200.0, 1), (66.0, 3), (0.5, 400), (50.0, 4)]


def test_positions(spark):
    held = spark.createDataFrame([(1, "open", D(2024, 1, 1), 10.0, 2), (2, "open", D(2024, 1, 2), 10.0, 2), (3, "open", D(2024, 1, 3), 10.0, 2), (4, "closed_time", D(2024, 1, 1), 10.0, 2), (5, "open", D(2024, 1, 1), 10.0, 1)], "position_id int, status string, exit_by date, entry double, qty int")
    fills = spark.createDataFrame([(1, 1, "new", 9.0, 9.0), (1, 2, "filled", 11.0, 11.0), (5, 1, "filled", 9.0, 9.0)], "position_id int, leg int, status string, fill_price double, limit_price double")
    got = {r.position_id: (r.status, r.reason, r.pnl) for r in trades.stepped(held, fills, F.to_date(F.lit("2024-01-02"))).collect()}
    assert got == {1: ("closed_auto", "take_profit", 2.0), 2: ("closed_time", "auto_closed_unknown", 0.0), 3: ("open", None, None), 4: ("closed_time", None, None), 5: ("closed_auto", "stop_loss", -1.0)}


def test_text_measures(spark):
    df = spark.createDataFrame([("the cat sat", "the cat ran"), ("", ""), ("a", "b")], "x string, y string").select(X.words(F.col("x")).alias("a"), X.words(F.col("y")).alias("b"))
    got = df.select(X.token_f1(F.col("a"), F.col("b")), X.jaccard(F.col("a"), F.col("b")), X.bleu(F.col("a"), F.col("b")), sequences.rouge_l("a", "b")).collect()
    assert [round(v, 4) for v in got[0]] == [0.6667, 0.5, round(math.sqrt(2 / 3 * 1 / 2), 4), 0.6667]
    assert list(got[1]) == [1.0, 0.0, 0.0, 1.0]
    assert list(got[2]) == [0.0, 0.0, 0.0, 0.0]
    assert sequences.greedy_clusters([0, 1, 0b1111, 0b11111]) == [0, 0, 1, 1]
    assert (sequences.knee([1, 5, 6, 6, 6]), sequences.knee([1, 1, 1]), sequences.knee([1, 2]), sequences.knee([1, 2, 3])) == (2, 1, None, None)


def test_tags():
    html = "<x-a>1<y>2</y></x-a> \x00 t <Custom k='v'>2</Custom><section><x-a>in</x-a><memo/></section><open><p>"
    marked, blocks = sequences.set_aside(html)
    assert list(blocks.values()) == ["<x-a>1<y>2</y></x-a>", "<Custom k='v'>2</Custom>", "<memo/>"]
    assert sequences.put_back(marked, blocks) == html
    assert sequences.put_back("lost", blocks) == "\n".join(["lost", *blocks.values()])
    marked, blocks = sequences.set_aside("a <x>b</x> <p>c</p>", whole=False)
    assert (list(blocks.values()), sequences.put_back(marked, blocks)) == (["<x>", "</x>"], "a <x>b</x> <p>c</p>")
    assert sequences.set_aside("<a>" * 3) == ("<a>" * 3, {})


def test_longest_common_subsequence():
    import random

    def by_hand(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    draw = random.Random(5)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(90))] for _ in "ab")
        assert sequences.lcs(a, b) == by_hand(a, b)


def test_simhash_by_hand(spark):
    import hashlib

    def by_hand(text):
        grams = [text.lower()[i : i + 4] for i in range(max(1, len(text) - 3))]
        sums = [0] * 64
        for g in grams:
            h = int(hashlib.md5(g.encode()).hexdigest()[:16], 16)
            for k in range(64):
                sums[k] += 1 if h >> k & 1 else -1
        return sum(1 << k for k in range(64) if sums[k] > 0)

    texts = ["The quick brown fox", "abc", "", "abcdabcd"]
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.simhash(F.col("t"))).collect()]
    assert got == [by_hand(t) for t in texts]


def test_simhash_clusters_by_hand(spark, tmp_path):
    """Copies that aren't adjacent share a cluster (A B A C B)."""
    from bidsmith import catalog

    said = [("a quick brown fox", 0), ("nothing of the kind", 1), ("A quick brown fox", 0), ("12345678", 2), ("nothing of the kind", 1)]
    spark.createDataFrame([(1, i, t) for i, (t, _) in enumerate(said)] + [(2, 0, said[1][0])], "conv_id bigint, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = catalog.QUERIES["simhash_clusters"](spark, str(tmp_path)).orderBy("conv_id", "turn").collect()
    assert [r.cluster for r in rows] == [*(c for _, c in said), 0]
    assert sequences.greedy_clusters([-1, 2**63, -2, 2**63 + 1]) == [0, 1, 0, 1]


def test_optimal_k_by_hand(spark, tmp_path):
    """Groups of 9 to 200 turns, with k worked out by hand."""
    import random

    from bidsmith import catalog

    draw = random.Random(3)
    line = lambda n: " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))
    varied = [line(12) for _ in range(200)]
    cases = {
        1: (varied[:8], 8),  # a few: all
        2: (varied, 200),  # no knee, diversity 1: all
        3: ([varied[0].upper() if i % 2 else varied[0] for i in range(9)], 3),  # one cluster, two texts
        4: ([t for t in varied[:20] for _ in range(2)], 25),  # no knee, diversity 0.5: int(40 * (0.3 + 0.7 * 0.5)), which floats put just under 26
        5: ([line(60), *(line(6) for _ in range(19))], 20),  # diversity 1: the floor is all
    }
    rows = [(c, i, t) for c, (ts, _) in cases.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n, r.k) for r in catalog.QUERIES["optimal_k"](spark, str(tmp_path)).collect()}
    assert got == {c: (len(ts), k) for c, (ts, k) in cases.items()}
    far = [i * 0x0F0F0F0F0F0F0F for i in range(1, 13)]
    short = [f"{chr(97 + i)} {chr(98 + i)}" for i in range(12)]  # under 200 bytes: no check by compression
    assert sequences.best_size(short, far, bias=0.5) == 6
    assert sequences.best_size(short, far, most=5) == 5


def test_cache_expiry(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 11.0), ("c", None)], "key string, expires_at double")
    assert {r.key for r in state.live(df, 10.0).collect()} == {"b", "c"}
    assert {r.key for r in state.expired(df, 10.0).collect()} == {"a"}


def test_consensus_and_budget(spark):
    paths = spark.createDataFrame([(1, 1, "a", "T"), (1, 2, "b", "T"), (1, 1, "c", "U"), (2, 2, "a", "V"), (3, 3, "a", None)], "i int, tier int, path string, ticker string")
    assert {r.i: (r.ticker, r.confidence, r.trail) for r in joins.consensus(paths, "i").collect()} == {1: ("T", "very_high", "a>b"), 2: ("V", "medium", "a")}
    df = spark.createDataFrame([([("a", 60), ("b", 50), ("c", 40)],)], "x array<struct<n: string, cost: bigint>>")
    assert [r.n for r in df.select(X.fitting(F.col("x"), 100).alias("k")).first().k] == ["a", "c"]


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    stamp = lambda m: dt.datetime(2024, 1, 1, 0, m)
    kind = "u int, ts timestamp, e string, v double"
    spark.createDataFrame([(1, stamp(0), "buy", 10.0), (1, stamp(1), "buy", 10.0), (1, stamp(2), "see", 12.0), (2, stamp(0), "buy", 5.0)], kind).coalesce(1).write.parquet(path)
    stream = lambda: state.table_stream(spark, path)
    assert state.drained(state.first_seen(stream().select("u", "e"), ["u", "e"]), "t1").count() == 3
    assert {(r.u, r.e) for r in state.drained(state.changes(stream(), "u", ["ts"], "e"), "t2").collect()} == {(1, "buy"), (1, "see"), (2, "buy")}
    done = state.drained(state.positions(stream(), "u", "ts", "e", "v", "buy", "see", 4), "t3").collect()
    assert [(r.u, r.status, r.pnl) for r in done] == [(1, "closed_auto", 2.0)]
    quiet = spark.createDataFrame([(1, stamp(0), "buy", 10.0), (2, dt.datetime(2024, 1, 9), "see", 1.0)], kind)
    quiet.coalesce(1).write.parquet(str(tmp_path / "quiet"))
    done = state.drained(state.positions(state.table_stream(spark, str(tmp_path / "quiet")), "u", "ts", "e", "v", "buy", "see", 4, "1 day"), "t7").collect()
    assert [(r.u, r.closed, r.status, r.pnl) for r in done] == [(1, dt.datetime(2024, 1, 5), "closed_time", 0.0)]
    memo = state.drained(state.cached(stream().select("u", "ts", "v"), "u", "ts", "v", 1), "t4").orderBy("u", "ts").collect()
    assert [(r.hit, r.given) for r in memo] == [(False, 10.0), (True, 10.0), (True, 10.0), (False, 5.0)]
    zero = state.drained(state.cached(stream().select("u", "ts", "v"), "u", "ts", "v", 0), "t5").collect()
    assert not any(r.hit for r in zero)
    empty = str(tmp_path / "none")
    spark.createDataFrame([], kind).write.parquet(empty)
    assert state.drained(state.first_seen(state.table_stream(spark, empty).select("u", "e"), ["u", "e"]), "t6").count() == 0


def test_eviction_merge_and_recall(spark):
    from bidsmith.operators import memory

    df = spark.createDataFrame([("g", i, i) for i in range(13)], "g string, t int, i int")
    assert sorted(r.i for r in memory.evicted(df, "g", "t", "i", 10).collect()) == [0, 1, 2]
    assert memory.evicted(df, "g", "t", "i", 13).count() == 0
    rows = [(1, 0, "a b c d e f g", 0.1, 7, ["q"]), (1, 1, "a b c d e f g", 0.9, 2, ["p", "q"]), (1, 2, "x", 0.5, 1, None), (1, 3, None, 0.2, 1, []), (1, 4, "", 0.2, 1, [])]
    notes = spark.createDataFrame(rows, "u int, n int, t string, w double, c bigint, e array<string>")
    got = memory.merged(notes, "u", "n", "t", "w", "c", "e").orderBy("n").collect()
    assert [(r.n, r.w, r.c, r.e, r.n_merged) for r in got] == [(1, 0.9, 7, ["p", "q"], 2), (2, 0.5, 1, [], 1), (3, 0.2, 1, [], 1), (4, 0.2, 1, [], 1)]
    got = spark.createDataFrame([("The Cat", ["cat", "dog"]), (None, [])], "t string, f array<string>").select(memory.recalled(F.col("t"), F.col("f"))).collect()
    assert [r[0] for r in got] == [0.5, 1.0]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_of_long_texts(spark):
    """Shared n-grams are counted, not looked for one by one: time grows with a text's length, not its square."""
    from collections import Counter

    draw = random.Random(3)
    rows = [([draw.choice("abcdefg") + draw.choice(["x", "y", ""]) for _ in range(draw.choice([0, 1, 2, 3, 5, 900]))], [draw.choice("abcdef") for _ in range(draw.choice([0, 1, 3, 700]))]) for _ in range(600)] + [(None, ["a"]), (["a"], None)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    got = df.select("a", "b", sequences.shared_grams(4)("a", "b").alias("n"), X.clipped(F.col("a"), F.col("b")).alias("c")).collect()
    grams = lambda x, n: Counter(zip(*(x[k:] for k in range(n)), strict=False))
    for r in got:
        want = None if r.a is None or r.b is None else [(grams(r.a, n) & grams(r.b, n)).total() for n in range(1, 5)]
        assert (r.n, r.c) == (want, want and want[0])
    assert "ArrowEvalPython" in planned(df.select(X.bleu(F.col("a"), F.col("b"))))


def test_matched_terms_of_long_texts(spark):
    """A document is split into tokens once, not once a term."""
    rows = [("to be or not to be identifier", "to be identifier to the"), ("x", "y"), ("", ""), (None, "a"), ("wörld 1234 " * 3000, "1234 w rld")]
    df = spark.createDataFrame(rows, "x string, y string").coalesce(1)
    scored = df.select(X.single_bm25(X.tokens(F.col("x")), X.tokens(F.col("y"))).alias("s"))
    part = lambda f, q: math.log(2) * f * 2.5 / (f + 1.5) * q
    want = [((2 * part(2, 1) + part(2, 1) + part(1, 1)) / 10 + 0.3, 3), (0.0, 0), (0.0, 0), (0.0, 0), (3 * part(3000, 1) / 10, 3)]
    for r, (bm25, matched) in zip(scored.collect(), want, strict=True):
        assert (round(r.s.bm25, 9), r.s.matched) == (round(min(1.0, bm25), 9), matched)
    assert "ArrowEvalPython" in planned(scored)


def test_simhash_of_many_grams(spark, monkeypatch):
    """Each different gram is hashed once for many texts; long texts are counted a part at a time."""
    import hashlib

    def by_hand(text):
        grams = [text[i : i + 4] for i in range(max(1, len(text) - 3))]
        ones = [int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big") for g in grams]
        v = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in ones) > len(grams))
        return v - 2**64 if v >= 2**63 else v

    draw = random.Random(9)
    texts = ["", "a", "abc", "abcd", "😀é中文" * 3] + ["".join(draw.choices("abc dé😀", k=draw.randint(0, 300))) for _ in range(60)] + ["ab" * 4000]
    monkeypatch.setattr(sequences, "CHARS", 1000)
    assert sequences.simhash(texts) == [by_hand(t) for t in texts]
    wide = ["".join(map(chr, range(0x4E00, 0x9FFF))) + "".join(map(chr, range(0x20000, 0x2A000))) + "".join(map(chr, range(0xAC00, 0xD7A3)))]
    assert sequences.simhash(wide) == [by_hand(wide[0])]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(1).select(X.simhash(F.col("t")))
    assert [r[0] for r in df.collect()] == [by_hand(t.lower()) for t in [*texts, ""]]
    assert "ArrowEvalPython" in planned(df)


def test_optimal_k_hashes_in_batches(spark, sf_dir):
    """The turns' SimHashes come from Arrow batches before conversations are brought together."""
    from bidsmith import catalog

    assert "ArrowEvalPython" in planned(catalog.QUERIES["optimal_k"](spark, sf_dir))
