from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import relational as rel
from sparkloom.operators import ring_sums, rings
from sparkloom.plans import contracts
from sparkloom.plans.dag import Dag, Node
from sparkloom.sources.folders import Files, Versions
from sparkloom.sources.log import Consumer, Log, LogConfig
from sparkloom.sources.readers import TRANSACTION, decoded, random_transactions
from sparkloom.streaming import jobs

CASES = [
    ("A>B B>C C>A", [["A", "B", "C"]]),
    ("A>B B>A X>Y Y>Z Z>X", [["A", "B"], ["X", "Y", "Z"]]),
    ("A>B B>A B>C C>B", [["A", "B"], ["B", "C"]]),
    ("A>B B>C C>B", [["B", "C"]]),
    ("A>A A>B B>C", []),
    ("A>B B>C C>A B>C C>A", [["A", "B", "C"]]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_rings(spark, text, want):
    pairs = [tuple(e.split(">")) for e in text.split()]
    assert rings.rings_of(pairs) == want
    df = spark.createDataFrame(pairs, "senderAccount string, receiverAccount string")
    for graph in (rings.edges(df), rings.trimmed(rings.edges(df))):
        assert sorted(r["ring"] for r in rings.find_rings(graph).collect()) == want


def test_rings_of_random_graphs_agree(spark):
    import random

    r = random.Random(5)
    pairs = [(f"n{r.randrange(8)}", f"n{r.randrange(8)}") for _ in range(20)]
    df = spark.createDataFrame(pairs, "senderAccount string, receiverAccount string")
    assert sorted(x["ring"] for x in rings.find_rings(rings.edges(df)).collect()) == sorted(rings.rings_of(pairs, 10_000))


def every_ring(pairs):
    """Rings by plain search, without a bound."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = []

    def walk(path):
        for n in out.get(path[-1], ()):
            if n == path[0]:
                found.append(path)
            elif n > path[0] and n not in path:
                walk([*path, n])

    for start in out:
        walk([start])
    return sorted(p for p in found if len(p) > 1)


def test_rings_of_any_length(spark):
    import random

    r = random.Random(6)
    long = [(f"n{k:02}", f"n{(k + 1) % 40:02}") for k in range(40)]
    graphs = [long, [*long, ("n20", "n00")], *([(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(3 * n)] for n in (4, 6, 9, 10))]
    for pairs in graphs:
        assert list(rings.simple_rings(pairs)) == every_ring(pairs)
    df = spark.createDataFrame([(w, *pair) for w, pairs in enumerate(graphs) for pair in pairs], "h int, s string, t string")
    got = rings.find_rings(rings.edges(df, "h", "s", "t")).collect()
    assert sorted((x["w"], x["ring"]) for x in got) == [(w, ring) for w, pairs in enumerate(graphs) for ring in every_ring(pairs)]


def test_ring_queries_keep_long_rings(spark):
    from sparkloom import queries as q

    data, windows = "/root/testdata/sf0.01", {}
    for x in rings.edges(q.tx(spark, data), "w", "sender", "receiver").collect():
        windows.setdefault(x["w"], []).append((x["src"], x["dst"]))
    want = {w: found for w, pairs in windows.items() if (found := every_ring(pairs))}
    assert max(len(ring) for found in want.values() for ring in found) == 20
    assert sorted((x["w"], x["ring"]) for x in q.ring_search(spark, data).collect()) == sorted((w, ",".join(map(str, ring))) for w, found in want.items() for ring in found)
    assert sorted(tuple(x) for x in q.ring_counts(spark, data).collect()) == sorted((w, len(found), max(map(len, found))) for w, found in want.items())
    assert q.ring_display_edges(spark, data).count() == sum(len(ring) - 1 for found in want.values() for ring in found)


def test_null_and_nan_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("b", None), (None, 5.0), ("b", math.nan)], "k string, value double")
    assert {r["k"]: r["value"] for r in rel.group_by(df, "k", "sum").collect()} == {"a": 1.0, "b": 0.0}
    assert {r["k"]: r["count"] for r in rel.group_by(df, "k", "count").collect()} == {"a": 2, "b": 2}
    assert [r["k"] for r in rel.order_by(df.select("k").distinct(), "k", ascending=False).collect()] == ["b", "a", None]
    assert rel.filter_rows(df, "value", ">", "0").count() == 2
    with pytest.raises(ValueError):
        rel.filter_rows(df, "value", ">=", 1)
    with pytest.raises(ValueError):
        rel.group_by(df, "k", "median")


@pytest.mark.parametrize(("n", "k"), [(10, 3), (2, 3), (9, 3), (0, 3), (1, 1)])
def test_blocks(spark, n, k):
    got = [r["block"] for r in rel.blocks(spark.range(n), "id", k).orderBy("id").collect()]
    want = [b + 1 for b in range(k) for _ in range(n // k + (b < n % k))]
    assert got == want


def test_gapless_and_difference(spark):
    assert rel.is_gapless(spark.range(5), "id").first()[0]
    assert not rel.is_gapless(spark.range(1, 5), "id").first()[0]
    assert [r[0] for r in rel.difference(spark.range(5), spark.range(3), ["id"]).orderBy("id").collect()] == [3, 4]


def spec(**over):
    raw = {"dataset": "orders", "owner": "team", "stream": {"topic": "orders", "partitions": 3, "retention_hours": 24}, "table": {"name": "shop.orders", "partition_by": ["day(at)", "bucket(8, id)"]},
           "schema": {"version": 1, "fields": [{"name": "id", "type": "long", "required": True}, {"name": "at", "type": "timestamp"}]}}
    return raw | over


def test_contract_parsing_collects_problems():
    good, none = contracts.parse_spec(spec())
    assert good is not None and none == []
    bad, found = contracts.parse_spec(spec(dataset="Bad Name", extra=1, stream=None, table={"name": "x", "partition_by": ["week(at)", "day(no)"]}, schema={"version": True, "fields": [{"name": "a", "type": "decimal(40,2)"}, {"name": "a", "type": "int", "required": "yes"}]}))
    assert bad is None and len(found) == 9
    assert contracts.parse_spec([])[0] is None
    assert contracts.parse_spec(spec(stream=None, table=None))[0] is None


def test_contract_verdicts(spark):
    field = contracts.Field
    one = contracts.Schema(1, (field("a", "int"),))
    for new, verdict in [(contracts.Schema(2, (field("a", "long"),)), 0), (contracts.Schema(1, (field("a", "long"),)), 1), (contracts.Schema(2, ()), 2), (contracts.Schema(0, (field("a", "int"),)), 1), (one, 0)]:
        assert contracts.compatibility(spark, one, new)[2] == verdict
    assert contracts.compatibility(spark, one, contracts.Schema(2, ()), allow_breaking=True)[2] == 0


def test_shadow_swap(spark, tmp_path):
    df = spark.range(20).withColumn("p", F.col("id") % 3)
    first = contracts.shadow_swap(spark, df, str(tmp_path), "p", ["id"])
    second = contracts.shadow_swap(spark, df, str(tmp_path), "p", ["id"])
    assert first != second and contracts.current_copy(spark, str(tmp_path)) == second
    assert spark.read.parquet(second).count() == 20 and not Files(spark, first).exists()


@pytest.mark.parametrize("over", [
    {"dataset": "d" * 64}, {"description": 5}, {"owner": " "}, {"state": "gone"}, {"stream": {"topic": "t", "partitions": 3}}, {"stream": {"topic": "t" * 250, "partitions": 3, "retention_hours": 1}},
    {"table": {"name": "a.b.c"}}, {"table": {"name": "shop.orders", "partition_by": ["day(no)"]}}, {"schema": {"version": 1, "fields": [{"name": "f" * 64, "type": "int"}]}},
    {"schema": {"version": 1, "fields": [{"name": "a", "type": " decimal(8,2)"}]}},
])
def test_contract_limits(over):
    assert contracts.parse_spec(spec())[0] is not None
    raw = spec(**over) | ({"table": None} if "schema" in over else {})
    assert contracts.parse_spec(raw)[0] is None and len(contracts.parse_spec(raw)[1]) == 1


def test_contract_files(spark, tmp_path):
    import yaml

    (tmp_path / "b.yaml").write_text(yaml.safe_dump(spec(dataset="b")))
    (tmp_path / "a.yml").write_text("x: [")
    (tmp_path / "c.txt").write_text("no")
    loaded = contracts.load_specs(str(tmp_path))
    assert [f for f, _, _ in loaded] == ["a.yml", "b.yaml"] and loaded[0][1] is None and loaded[1][1].dataset == "b"
    assert [r["source"] for r in contracts.problems_table(spark, loaded).collect()] == ["a.yml"]


def test_decimals_are_compared_as_types(spark):
    field = contracts.Field
    one, two = contracts.Schema(1, (field("a", "decimal(8,2)"),)), contracts.Schema(1, (field("a", "decimal(8, 2)"),))
    assert contracts.compatibility(spark, one, two)[2] == 0
    wider = contracts.schema_changes(contracts.fields_table(spark, two), contracts.fields_table(spark, contracts.Schema(2, (field("a", "decimal(9,  2)"),)))).collect()
    assert [tuple(r) for r in wider] == [("a", "widened decimal(8,2) -> decimal(9,2)", False)]


def test_dag():
    d = Dag()
    for n in (Node("h", "head", {"label": "nightly", "tags": "a, b", "default_args": {"retries": "2", "email": "x@y"}}), Node("1", "bash", {"label": "get", "bash_command": "true"}), Node("2", "http", {"label": "post", "headers": '{"a": 1}'})):
        d.add(n)
    d.connect("h", "1")
    d.connect("1", "2")
    made = d.to_dict()["nightly"]
    assert made["tasks"]["post"]["dependencies"] == ["get"] and "dependencies" not in made["tasks"]["get"]
    assert made["default_args"] == {"retries": 2, "email": ["x@y"]} and made["tags"] == ["a", "b"]
    assert "headers: {a: 1}" in d.to_yaml()
    d.delete("1")
    assert d.edges == []


def records(spark, a, b):
    return spark.range(a, b).select("id", F.concat(F.lit("record-"), "id").alias("payload"))


def test_log_and_consumers(spark, tmp_path):
    log = Log(spark, str(tmp_path), LogConfig(segment_bytes=6 * 24))
    assert log.append(records(spark, 0, 6), "id") == 0 and log.append(records(spark, 6, 10), "id") == 6
    assert log.next_offset() == 10 and log.read(7) == b"record-7" and log.read(99) is None
    c = Consumer(log, "g")
    assert [o for o, _ in c.poll(4)] == [0, 1, 2, 3] and Consumer(log, "g").position == 0
    c.commit()
    again = Consumer(log, "g")
    assert again.position == 4 and again.lag() == 6 and [o for o, _ in again.poll(100)] == list(range(4, 10)) and again.poll(5) == []
    assert Consumer(log, "other").position == 0
    assert log.delete_up_to(6) == 1 and log.first_offset() == 6 and Consumer(log, "g").position == 6
    assert log.delete_up_to(100) == 0
    with pytest.raises(ValueError):
        log.read_from(0, 1)
    with pytest.raises(ValueError):
        log.append(records(spark, 0, 0), "id")


def test_damaged_commits_start_over_or_fall_back(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.append(records(spark, 0, 9), "id")
    c = Consumer(log, "g")
    for limit in (2, 3):
        c.poll(limit)
        c.commit()
    newest = sorted((tmp_path / "groups/g").glob("v*"))[-1]
    for crc in (tmp_path / "groups/g").glob(".*crc"):
        crc.unlink()
    newest.write_text("1\n")  # torn: the version before holds
    assert Consumer(log, "g").position == 2
    for file in (tmp_path / "groups/g").glob("v*"):
        file.write_text("3\nabc")
    assert Consumer(log, "g").position == 0


def test_appends_of_one_record_and_rolls(spark, tmp_path):
    log = Log(spark, str(tmp_path), LogConfig(segment_bytes=50))
    assert [log.append(records(spark, k, k + 1), "id") for k in range(3)] == [0, 1, 2]
    assert log.append(records(spark, 3, 9), "id") == 3
    again = Log(spark, str(tmp_path), LogConfig(segment_bytes=50))
    # 24 bytes a record: a segment holds 50 or more after its third.
    assert [(r["offset"], r["segment_base"], bytes(r["payload"])) for r in again.rows().orderBy("offset").collect()] == [(k, k // 3 * 3, f"record-{k}".encode()) for k in range(9)]
    assert again.delete_up_to(5) == 1 and again.first_offset() == 3 and [r["offset"] for r in again.read_from(4, 3).collect()] == [4, 5, 6]
    assert again.delete_up_to(9) == 1 and again.first_offset() == 6 and again.next_offset() == 9
    assert again.rows().count() == 3


def test_torn_appends_are_invisible(spark, tmp_path, monkeypatch):
    log = Log(spark, str(tmp_path))
    log.append(records(spark, 0, 4), "id")

    def fail(*_):
        raise OSError("disk")

    monkeypatch.setattr(log._commits, "write", fail)
    with pytest.raises(OSError):
        log.append(records(spark, 4, 6), "id")
    assert log.next_offset() == 4 and log.rows().count() == 4 and len(list((tmp_path / "records").glob("batch*"))) == 2
    with pytest.raises(RuntimeError):
        log.append(records(spark, 4, 6), "id")
    again = Log(spark, str(tmp_path))
    assert again.append(records(spark, 4, 6), "id") == 4 and again.rows().count() == 6 and len(list((tmp_path / "records").glob("batch*"))) == 2
    with pytest.raises(FileExistsError):  # another writer at the same place
        Log(spark, str(tmp_path))._commits.write(f"{4:020d}", b"{}")


def test_counts_survive_every_crash(spark, tmp_path, monkeypatch):
    log = Log(spark, str(tmp_path / "log"))
    log.append(spark.range(200).select("id", F.concat(F.lit("k"), F.col("id") % 7).alias("payload")), "id")
    path, want, turn = str(tmp_path / "counts"), {f"k{k}": len(range(k, 200, 7)) for k in range(7)}, 0
    save = Versions.save
    while jobs.counted(spark, path)[1] < 200:
        turn += 1

        def dies(self, data, turn=turn):
            if turn % 3 == 1:
                raise OSError("killed before the commit")
            save(self, data)
            if turn % 3 == 2:
                raise OSError("killed after the commit")

        monkeypatch.setattr(Versions, "save", dies)
        try:
            jobs.count_next(log, path, 64)
        except OSError:
            pass
    monkeypatch.setattr(Versions, "save", save)
    assert jobs.count_next(log, path, 64) == 0 and turn > 4
    assert {r["key"]: r["count"] for r in jobs.counted(spark, path)[0].collect()} == want


def test_keyed_and_file_sinks(spark, tmp_path):
    rows = random_transactions(spark, 300, seed=9).withColumn("n", F.lit(1))
    sent = jobs.by_key(rows, "senderAccount", 4).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    kept = {}
    for r in sent.orderBy("at").collect():
        kept.setdefault(r["senderAccount"], []).append((r["part"], r["timestamp"]))
    assert all(len({p for p, _ in own}) == 1 and [t for _, t in own] == sorted(t for _, t in own) for own in kept.values())
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run adds nothing
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = jobs.to_files(stream, str(tmp_path / "out"), str(tmp_path / "c"), once=True)
        query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_of_many_wide_rows(spark, adaptive):
    """Millions of rows, several columns, in no order: every rank and block is right, whatever columns are read."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 3_000_000
        wide = spark.range(n, numPartitions=16).select(F.xxhash64("id").alias("hash"), (F.col("id") * 7919 % n).alias("k"), F.repeat(F.lit("x"), 20).alias("pad"))
        ranked = rel.with_rank(wide, "k")
        assert ranked.where("rank <> k").count() == 0 and ranked.agg(F.bit_xor("hash"), F.max("pad"), F.count_if(F.col("rank") != F.col("k"))).first()[2] == 0
        got = rel.blocks(wide, "k", 3).groupBy("block").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"), F.max("pad")).orderBy("block").collect()
        assert [(r["n"], r["a"], r["b"]) for r in got] == [(n // 3, i * n // 3, (i + 1) * n // 3 - 1) for i in range(3)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_ranks_of_odd_values(spark):
    texts = [(f"t{k % 977:03}-{k}",) for k in range(3000)] + [(None,)]
    df = spark.createDataFrame(texts, "v string")
    got = {r["v"]: r["rank"] for r in rel.with_rank(df, "v").collect()}
    assert got == {v: i for i, v in enumerate([None, *sorted(t for (t,) in texts if t)])}
    totals = rel.running_total(spark.range(1, 500), "id", F.col("id"), "before").collect()
    assert all(r["before"] == r["id"] * (r["id"] - 1) // 2 for r in totals)
    assert rel.with_rank(spark.range(0), "id").count() == 0


def test_decoding_drops_malformed(spark):
    good = ['{"transactionId":"t","senderAccount":"A","receiverAccount":"B","amount":1,"timestamp":0}', '{"senderAccount":"A","amount":2}', '{"transactionId":null}', "{}"]
    df = spark.createDataFrame([(x,) for x in [*good, "{no", "[]", "7", '"x"', "", None]], "value string")
    got = decoded(df, TRANSACTION)
    assert got.columns == TRANSACTION.fieldNames() and got.count() == len(good)
    assert got.where("transactionId is null and senderAccount = 'A' and amount = 2").count() == 1


def test_naive_split_counts_twice(spark):
    df = spark.range(1000).select(F.col("id").alias("offset"), F.lit("k").alias("payload"))
    assert jobs.naive_counts(df, crash_at=730).first()["count"] == 1500


def test_streams_agree_with_batch(spark, tmp_path):
    rows = random_transactions(spark, 200, seed=3)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = jobs.ring_alerts(spark.read.parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.ring_alerts(stream, delay=None).writeStream.format("memory").queryName("alerts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["start"], sorted(map(tuple, r["rings"]))) for r in df.collect())
    assert key(spark.table("alerts")) == key(batch) and batch.count() > 0
    assert jobs.ring_messages(batch).count() == batch.agg(F.sum(F.size("rings"))).first()[0]


def test_alerts_by_arrival(spark):
    """Without event time all rows of a batch arrive at once: one window, no watermark."""
    rows = spark.createDataFrame([("A", "B", 0), ("B", "C", 900_000), ("C", "A", 5_000_000), ("A", "A", 1)], "senderAccount string, receiverAccount string, timestamp long")
    assert jobs.ring_alerts(rows).count() == 0
    got = jobs.ring_alerts(rows, "1 day", event_time=False).collect()
    assert [r["rings"] for r in got] == [[["A", "B", "C"]]]


def test_sorted_values_of_a_table_that_sorts_by_a_sample(spark, tmp_path):
    """More rows than the sort's sample has: each run of it may cut its partitions elsewhere."""
    from sparkloom import queries as q

    value = F.when(F.col("id") % 1000 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)) / 100)
    spark.range(300_000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), value.alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in q.sorted_values(spark, str(tmp_path)).select("place", "value", "id").collect()]
    got.sort()
    assert [r[0] for r in got] == list(range(300_000))
    order = [(r[1] is None, r[1] or 0.0, r[2]) for r in got]
    assert order == sorted(order)
    assert rel.with_places(spark.range(0).orderBy("id")).count() == 0


def test_rings_over_runs_without_branches():
    """Each run is one step of the search, however long; rings are whole, with their least node first."""
    import random

    for seed in range(60):
        r = random.Random(seed)
        pairs = [(r.randrange(7), r.randrange(7)) for _ in range(12)]
        names = r.sample(range(100, 1000), 60)
        runs = [[a, *[names.pop() for _ in range(r.randrange(5))], b] for a, b in pairs if a != b]
        r.shuffle(relabel := list(range(1000)))
        links = [(relabel[x], relabel[y]) for run in runs for x, y in zip(run, run[1:])]
        assert sorted(rings.long_rings(links)) == sorted(every_ring(links))
    circle = [(k, (k + 1) % 500) for k in range(500)]
    short, chains = rings.contracted([*circle, (250, 0)])
    assert len(short) < 6 and sorted(map(len, chains.values())) == [249, 249]
    assert sorted(map(len, rings.long_rings([*circle, (250, 0)]))) == [251, 500]


@pytest.mark.parametrize("most", [1, 2, 1000])
def test_ring_edges_where_rings_are_found(spark, monkeypatch, most):
    """Edges as drawn come out of the search itself, in batches of any size: the same as those of its rings."""
    monkeypatch.setattr(rings, "NODES_PER_BATCH", most * 30)
    r = random.Random(most)
    links = []
    for w in range(6):
        # Runs of accounts between a few hubs; their least account stands anywhere in them.
        names = r.sample(range(10, 99), 40)
        for k in range(0, 36, 4):
            links += [(w, a, b) for a, b in zip(names[k : k + 4], names[k + 1 : k + 5], strict=True)]
        links += [(w, names[r.randrange(40)], names[4 * r.randrange(9)]) for _ in range(6)]
    for kind, given in (("bigint", links), ("string", [(w, f"a{a}", f"a{b}") for w, a, b in links])):
        graph = rings.edges(spark.createDataFrame(given, f"h int, s {kind}, t {kind}"), "h", "s", "t")
        want = [(w, k + 1, *ring[k : k + 2]) for w in range(6) for ring in every_ring([x[1:] for x in given if x[0] == w]) for k in range(len(ring) - 1)]
        assert len(want) > 50
        got = rings.find_ring_edges(graph)
        assert got.dtypes == [("w", "int"), ("step", "int"), ("src", kind), ("dst", kind)]
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert sorted(map(tuple, rings.ring_edges(rings.find_rings(graph)).select("w", "step", "src", "dst").collect())) == sorted(want)


def layers(n):
    """Two accounts a layer, each linked to both of the next: 2**n rings go round once, and 2**(n - 1) twice."""
    return [(2 * k + a, (2 * k + 2) % (2 * n) + b) for k in range(n) for a in (0, 1) for b in (0, 1)]


def test_rings_are_counted_without_a_search(spark):
    """A search over these rings would not end."""
    links = [(w, a, b) for w, n in enumerate((3, 40)) for a, b in layers(n)] + [(2, 1, 2), (2, 2, 3), (3, 1, 1), (3, None, 1), (3, 1, None), (None, 1, 2), (None, 2, 1)]
    graph = rings.edges(spark.createDataFrame(links, "h int, s long, t long"), "h", "s", "t")
    got = rings.count_rings(graph)
    assert got.dtypes == [("w", "int"), ("n_rings", "bigint"), ("longest", "int")]
    assert sorted(map(tuple, got.collect())) == [(0, len(every_ring(layers(3))), 6), (1, 3 * 2**39, 80)]
    assert ring_sums.ring_sums(layers(90)) == (3 * 2**89, 180)


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_ring_sums_equal_the_rings_found(monkeypatch, most):
    monkeypatch.setattr(ring_sums, "MOST_STATES", most)
    for seed in range(80):
        r = random.Random(seed)
        n = r.randrange(2, 9)
        links = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(1, 4 * n))]
        links += [(a + n, b + n) for a, b in links[:n]] + [(0, n), (None, 0)]
        found = every_ring([(a, b) for a, b in links if a is not None and a != b])
        assert ring_sums.ring_sums(links) == (len(found), max(map(len, found), default=0))


@pytest.mark.parametrize("name", ["ring_counts", "ring_display_edges", "ring_search"])
def test_rings_need_no_joins(spark, name):
    """Edges off all rings are dropped in the task of their window, which has them all."""
    from sparkloom import queries as q

    plan = q.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("most", [1, 40, 1_000_000])
def test_ring_texts_are_those_of_the_rings(spark, monkeypatch, most):
    """Texts are joined from runs; each begins with its least account, which may stand anywhere in a run."""
    monkeypatch.setattr(rings, "NODES_PER_BATCH", most)
    for seed in range(40):
        r = random.Random(seed)
        names = r.sample(range(1, 2000), 60)
        links = [*zip(names[:40], names[1:41], strict=True), *((names[r.randrange(40)], names[r.randrange(40)]) for _ in range(6))]
        found = every_ring({(a, b) for a, b in links if a != b})
        assert sorted(x for some in rings.ring_texts(links, ",") for x in some) == sorted(",".join(map(str, ring)) for ring in found)
    links = [("a", "b"), ("b", "ä"), ("ä", "a"), ("b", "a"), ("x", "y"), ("y", None)]
    graph = rings.edges(spark.createDataFrame([(0, *x) for x in links], "h int, s string, t string"), "h", "s", "t")
    assert sorted(map(tuple, rings.find_ring_texts(graph, ">").collect())) == [(0, "a>b"), (0, "a>b>ä")]
    with pytest.raises(TypeError, match="double"):
        rings.find_ring_texts(graph.select("w", graph["src"].cast("double"), graph["dst"].cast("double")))
