import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsmill.operators import admission, dedup, entities as en, joins, ordered


def hot_rows(n=400, seed=1):
    """A third of the rows and more belong to one key."""
    rnd = random.Random(seed)
    return [(i, "hot" if i % 3 else f"k{i % 7}", rnd.randint(0, 50), rnd.choice([None, "a", "b"])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, key string, v int, h string").repartition(7)


def test_ordered_operators_against_plain_loops(spark):
    rows = hot_rows()
    df = frame(spark, rows)
    total, last, back = {}, {}, {}
    want_sum, want_last, want_back = {}, {}, {}
    for i, k, v, h in rows:
        total[k] = total.get(k, 0) + v
        want_sum[i] = total[k]
        last[k] = h or last.get(k)
        want_last[i] = last[k] or "none"
        want_back[i] = back.get(k, [])[-3:]
        back.setdefault(k, []).append(v)
    sums = ordered.running_totals(df, ["key"], ["id"], {"s": F.col("v")}, count=13)
    assert {r.id: r.s for r in sums.collect()} == want_sum
    carried = ordered.carry_forward(df, ["key"], ["id"], F.col("h"), "c", "none")
    assert {r.id: r.c for r in carried.collect()} == want_last
    looked = ordered.lookback(df, ["key"], ["id"], F.col("v"), 3, "b")
    assert {r.id: r.b for r in looked.collect()} == want_back


def test_islands_and_missing_days(spark):
    df = spark.createDataFrame([(n,) for n in (3, 4, 5, 9, 11, 12)], "n int")
    assert sorted(tuple(r) for r in ordered.islands(df, [], "n").collect()) == [(3, 5, 3), (9, 9, 1), (11, 12, 2)]


def test_recent_calls(spark):
    base = datetime(2024, 1, 1)
    secs = [0, 0, 10, 59, 60, 61, 120, 121, 500]
    df = spark.createDataFrame([("a", base + timedelta(seconds=s)) for s in secs], "k string, ts timestamp")
    got = {(r.ts - base).seconds: r.recent for r in ordered.calls_in_last(df, ["k"], "ts").collect()}
    assert got == {s: sum(1 for x in secs if s - 60 <= x <= s) for s in secs}


def test_keep_first_plan_limits_before_the_shuffle(spark):
    df = frame(spark, hot_rows())
    plan = dedup.keep_first(df, ["key"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    missing = df.withColumn("key", F.when(F.col("v") > 10, F.col("key")))
    kept = dedup.keep_first(missing, ["key"], ["id"], keep_null_keys=True)
    nulls = missing.where("key is null").count()
    assert kept.count() == nulls + missing.where("key is not null").select("key").distinct().count()


def test_append_then_append_adds_nothing(spark):
    items = frame(spark, hot_rows()).withColumnRenamed("key", "url")
    assert joins.new_rows(items, items).count() == 0


def test_skew_join_salted_equals_plain(spark):
    df = frame(spark, hot_rows())
    names = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, w int")
    for how in ("inner", "left"):
        plain = sorted(map(str, joins.skew_join(df, names, "key", how).select("id", "w").collect()))
        salted = joins.skew_join(df, names, "key", how, salts=4, force_salt=True).select("id", "w")
        assert sorted(map(str, salted.collect())) == plain


def test_contains_join_is_exact(spark):
    rnd = random.Random(3)
    word = lambda a, b: "".join(rnd.choice("abc ") for _ in range(rnd.randint(a, b))).strip() or "a"
    needles, hays = {word(1, 5) for _ in range(60)}, {word(3, 30) for _ in range(80)}
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    h = spark.createDataFrame([(x,) for x in hays], "h string")
    out = joins.contains_join(n, h, "n", "h", short_needles=True)
    assert {tuple(r) for r in out.collect()} == {(a, b) for a in needles for b in hays if a in b}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_redirect_chains_and_cycles(spark):
    hops = [(f"u{i}", f"u{i + 1}") for i in range(40)]
    hops += [("x", "y"), ("y", "x"), ("into", "x"), ("self", "self")]
    red = spark.createDataFrame(hops, "url string, target string")
    items = spark.createDataFrame([(u,) for u in ("u0", "u7", "x", "into", "self", "other")], "url string")
    got = {r.url: r.final_url for r in joins.resolve_redirects(items, red).collect()}
    assert got == {"u0": "u40", "u7": "u40", "x": "x", "into": "into", "self": "self", "other": "other"}


def test_term_counts(spark):
    docs = spark.createDataFrame(
        [(1, "Ha ha ha ha HA. New York, new york; C++ and c++ $SOL sol"), (2, "haha newyork"), (3, "été Été ete")], "doc_id int, text string"
    )
    long = "été un deux trois quatre cinq six sept huit neuf"
    docs = docs.unionByName(spark.createDataFrame([(4, f"-- {long.upper()} --"), (5, "a##b ##")], "doc_id int, text string"))
    terms = spark.createDataFrame([(x,) for x in ("ha ha", "New York", "SOL", "C++", "été", long, "##")], "term string")
    got = {(r.doc_id, r.term): r.n for r in joins.term_counts(docs, terms).collect()}
    assert got == {(1, "ha ha"): 2, (1, "New York"): 2, (1, "SOL"): 2, (3, "été"): 2, (4, "été"): 1, (4, long): 1, (5, "##"): 1}


def test_first_pattern_by_order_then_pattern(spark):
    rows = frame(spark, hot_rows()).withColumn("text", F.concat("key", F.lit("-x"), F.col("v").cast("string")))
    pats = spark.createDataFrame([("x1", 2, "p1"), ("HOT-x1", 1, "p0"), ("k", 9, "p9")], "pattern string, priority int, name string")
    pats = pats.unionByName(spark.createDataFrame([("x", None, "last"), ("hot-X1", 1, "p1b"), ("", 0, "none")], pats.schema))
    known = [("hot-x1", "p0"), ("x1", "p1"), ("k", "p9"), ("x", "last")]
    for r in joins.first_pattern(rows, "text", pats, values=["name"]).collect():
        assert r.name == next((n for p, n in known if p in r.text.lower()), None)


def test_updates_do_not_multiply_rows(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 3)], "k int, v string, at int")
    assert sorted(map(tuple, joins.update_columns(target, new, "k", ["v"], "at").collect())) == [(1, "x"), (2, "b")]
    assert sorted(map(tuple, joins.update_columns(target, new, "k", ["v"]).collect())) == [(1, "y"), (2, "b")]


def test_entity_order_and_types(spark):
    cat = spark.createDataFrame(
        [("1", "asset", "Solana", "a chain", "SOL"), ("2", "profile", "Solana", "a chain", ""), ("3", "product", "Solana Pay", "pay", ""), ("4", "entity", "Sol", "Solana Labs office", "")],
        "entity_id string, type string, name string, description string, ticker string",
    )
    items = spark.createDataFrame([(7, "Solana Pay opens", "for Solana users"), (8, "nothing here", "")], "k int, title string, description string")
    found = en.match_entities(items, cat, ["k"])
    s = en.match_summary(found, ["k"]).collect()
    assert len(s) == 1 and s[0].grid_subjects.startswith("Solana Pay") and s[0].grid_profile_id == "2"
    assert s[0].grid_asset_id == "" and s[0].grid_product_name == "Solana Pay"


def admission_rows():
    rnd = random.Random(5)
    rows, t = [], datetime(2024, 1, 30, 22, 0)
    for i in range(1500):
        t += timedelta(seconds=rnd.choice([0, 1, 3, 5, 9, 20, 200 if i % 50 == 0 else 2]))
        rows.append((i, t, rnd.choice(["gemini-2.5-pro", "gemini-2.0-flash", "other"]), rnd.choice(["hot", "hot", "cold"]), rnd.choice([0.001, 0.004])))
    return rows


def expected(rows, limits):
    limits = {**admission.fixed.DEFAULT_LIMITS, **limits}
    table = {"gemini-2.5-pro": (5, 50), "gemini-2.0-flash": (10, 1000), "other": (5, 100)}
    gates, out = {}, {}
    for i, t, model, tenant, cost in sorted(rows, key=lambda r: (r[1], r[0])):
        gate = gates.setdefault(tenant, admission.Gate(limits))
        out[i] = gate.decide((t - datetime(1970, 1, 1)).total_seconds(), f"{t:%Y-%m-%d}", f"{t:%Y-%m}", cost, *table[model])
    return out


def test_admission_equals_one_pass(spark):
    rows = admission_rows()
    df = spark.createDataFrame(rows, "call_id int, ts timestamp, model string, task_id string, cost double").repartition(5)
    for limits in ({"monthly_budget_usd": 1.0}, {"monthly_budget_usd": 0.5, "daily_max_calls": 120}, {"monthly_budget_usd": 9.0, "monthly_max_calls": 150}, {}):
        got = {r.call_id: r.decision for r in admission.admit(df, limits).collect()}
        assert got == expected(rows, limits)


def test_chunks_follow_the_input(spark, sf, monkeypatch):
    """A tenth of the bytes a chunk, ten times the chunks; results are the same."""
    from newsmill import session

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit(1).alias("k"), "doc_id", "n_chars")
    few = session.partitions(docs)
    plain = {r.doc_id: r.s for r in ordered.running_totals(docs, ["k"], ["doc_id"], {"s": F.col("n_chars")}).collect()}
    monkeypatch.setattr(session, "CHUNK_BYTES", session.stored_bytes(docs) // 40)
    assert session.partitions(docs) >= 40 > few
    assert session.partitions(spark.createDataFrame([(1,)], "a int")) >= few
    assert {r.doc_id: r.s for r in ordered.running_totals(docs, ["k"], ["doc_id"], {"s": F.col("n_chars")}).collect()} == plain
