"""Streams that are stopped and go on, the log-structured table, the hash tree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import robust
from tidemark.operators import merkle, series
from tidemark.operators.log_table import LogTable
from tidemark.plans import streams
from tidemark.sources import harvest
from tidemark.streaming import flows, online

SCHEMA = flows.Store.SCHEMA


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_drained_results_stay_after_a_run_without_new_files(spark, tmp_path):
    ev = "ts timestamp, event_type string"
    put = lambda n: spark.sql(f"SELECT timestamp'2024-01-01' + make_interval(0,0,0,id,0,0,0) AS ts, 'a' AS event_type FROM range({n})").write.mode("append").parquet(str(tmp_path / "in"))
    put(3)
    counts = lambda: {str(r.start)[:10]: r.n for r in flows.drain(flows.tumbling_counts(flows.landing(spark, str(tmp_path / "in"), ev)), str(tmp_path / "out"), "complete").collect()}
    first = counts()
    assert counts() == first and sum(first.values()) == 3
    put(2)
    assert sum(counts().values()) == 5 and sum(counts().values()) == 5


def test_log_table_by_a_dictionary(spark, tmp_path):
    rng, want, log = random.Random(7), {}, []
    t = LogTable(spark, str(tmp_path / "t"), first={"unit": "string"}, buckets=4, fan=2)
    assert t.read().count() == 0 and t.log().count() == 0
    for version in range(7):
        batch = {}
        for _ in range(rng.randrange(0, 25)):
            batch[rng.choice("abcde"), rng.randrange(6)] = (rng.choice([1.0, 2.0, None]), rng.random())
        rows = [(s, x, v, u, f"u{version}") for (s, x), (v, u) in batch.items()]
        df = spark.createDataFrame(rows, "series_id string, x int, value double, uncertainty double, unit string")
        for _ in range(2):  # a commit that comes again changes nothing
            t.commit(df, version)
        for key, (v, u) in batch.items():
            if key in want and want[key][0] is not None and v is not None and want[key][0] != v:
                log.append((*key, want[key][0], v, version))
            want[key] = (v, u, want[key][2] if key in want else f"u{version}")
        assert {(r.series_id, r.x): (r.value, r.uncertainty, r.unit) for r in t.read().collect()} == want
    assert sorted((r.series_id, r.x, r.old_value, r.new_value, r.version) for r in t.log().collect()) == sorted(log)
    assert {(r.series_id, r.x): r.value for r in LogTable(spark, str(tmp_path / "t"), first={"unit": "string"}, buckets=4, fan=2).read().collect()} == {k: v[0] for k, v in want.items()}


def test_a_commit_writes_what_it_brings(spark, tmp_path):
    t = LogTable(spark, str(tmp_path / "t"), buckets=8, fan=4)
    base = spark.range(5000).select(F.col("id").cast("string").alias("series_id"), F.lit(1).alias("x"), F.lit(1.0).alias("value"), F.lit(0.1).alias("uncertainty"), F.lit("u").alias("unit"), F.lit("2024-01-01").cast("timestamp").alias("created"))
    t.commit(base, 0)
    for version in range(1, 10):
        t.commit(base.filter(F.col("series_id") == str(version % 3)).withColumn("value", F.lit(float(version))), version)
    small = spark.read.parquet(*[str(p) for p in (tmp_path / "t" / "runs").glob("*/*") if p.parent.name != "0-0"])
    runs = [r for r in t.manifest() if r["run"] == "0-0"]
    assert small.count() < 60 and len(runs) == 8  # no bucket of the first commit was written again
    assert t.read().filter("value > 1").count() == 3 and t.read().count() == 5000


def test_online_verdicts_with_late_and_repeated_points(spark, tmp_path):
    rng = random.Random(5)
    truth = {s: [10 + 0.2 * x + rng.gauss(0, 1) + (jump if x > 30 else 0) for x in range(40)] for s, jump in (("a", 0), ("b", 40), ("c", -40))}
    order = [(s, x) for s in truth for x in range(40)]
    rng.shuffle(order)
    drops = [[(s, float(x), truth[s][x] + (500 if (x + k) % 5 == 0 and k < 2 else 0), k) for s, x in order[k::3]] for k in range(3)]
    drops.append([(s, float(x), truth[s][x], 5) for s, x in order])  # all again, corrected
    drops.append([(s, float(x), truth[s][x] + 900, 1) for s, x in order])  # seen before what is known: changes nothing
    schema, seen = "series_id string, x double, y double, seen long", {}
    for k, rows in enumerate(drops):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(1 + k % 2):  # some runs find nothing new
            changes = online.verdict_changes(flows.landing(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), {"series_id": "string"})
        for s, x, y, at in rows:
            if (s, x) not in seen or (seen[s, x][1], seen[s, x][0]) < (at, y):
                seen[s, x] = (y, at)
        want = {}
        for s in truth:
            pts = sorted((x, y) for (t, x), (y, _) in seen.items() if t == s)
            v = robust.verdict(np.array([p[0] for p in pts]), np.array([p[1] for p in pts]))
            want[s] = (v["fired"], v["sustained"], v["dissolving"])
        assert {r.series_id: tuple(r)[1:] for r in online.standing(changes, ["series_id"]).collect()} == want
    batch = series.detect(spark.createDataFrame([(s, float(x), y) for s, ys in truth.items() for x, y in enumerate(ys)], "series_id string, x double, y double"), ["series_id"])
    assert {r.series_id: (r.fired, r.sustained, r.dissolving) for r in batch.collect()} == want and want["b"][0] and want["c"][2]
    numbers = {}
    for r in changes.orderBy("change").collect():
        numbers.setdefault(r.series_id, []).append(r.change)
    assert all(n == list(range(1, len(n) + 1)) for n in numbers.values())


def test_harvest_goes_on_after_a_kill(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i % 7}", "en", "ab"[i % 2]) for i in range(200)], "doc_id long, text string, lang string, source string")
    land = str(tmp_path / "landed")
    streams.landed_pages(docs, land, size=20)
    seen = []

    def stop_in_third(batch, n):
        seen.append(n)
        if n == 2:
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"rows/{n}"))

    def run(f):
        q = harvest.harvested(spark, land, pages=2).writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(f).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="killed"):
        run(stop_in_third)
    run(lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"rows/{n}")))
    got = spark.read.parquet(str(tmp_path / "rows/*"))
    want = {str(i) for i in range(200) if i % 17}
    assert {r.external_id for r in harvest.papers(got).collect()} == want and harvest.papers(got).count() == len(want)
    twice = got.groupBy("set", "external_id").count().filter("count > 1")
    # Only what came before the token expired comes twice: two pages of the set that was begun anew.
    assert {r.set for r in twice.collect()} == {"b"} and twice.count() == len([i for i in range(40) if i % 2 and i % 17])
    assert got.groupBy("set", "page", "external_id").count().filter("count > 1").isEmpty()
    # A page that answers another token than the one that is due waits.
    (tmp_path / "landed/set=a/page=11").mkdir()
    (tmp_path / "landed/set=a/page=11/x").write_text('<OAI-PMH><request resumptionToken="other"/><ListRecords/></OAI-PMH>')
    reader = harvest.HarvestReader(land, 100)
    assert reader.latestOffset()["a"] == {"page": 10, "token": "", "done": True} and reader.latestOffset()["b"]["page"] == 13


def test_harvest_of_many_pages_takes_few_files_batches_and_tasks(tmp_path):
    def page(n, last):
        token = "" if n == 1 else f"t{n}"
        after = "" if n == last else f"t{n + 1}"
        rows = "".join(f"<record><header><datestamp>2020-01-01</datestamp></header><metadata><id>{n}-{k}</id></metadata></record>" for k in range(2))
        return f'<?xml version="1.0"?>\n<OAI-PMH><request resumptionToken="{token}"/>\n<ListRecords>{rows}</ListRecords><resumptionToken>{after}</resumptionToken></OAI-PMH>\n'

    # Folders of 300, 1 and 299 answers; the last one was broken off.
    for first, end in ((1, 301), (301, 302), (302, 601)):
        (tmp_path / f"set=a/page={first}").mkdir(parents=True)
        (tmp_path / f"set=a/page={first}/x").write_text("".join(page(n, 601) for n in range(first, end)))
    reader, at, batches, got = harvest.HarvestReader(str(tmp_path), 10), {}, 0, []
    while (new := reader.latestOffset()) != at:
        parts = reader.partitions(at, new)
        assert all(p.last - p.first < harvest.TASK for p in parts)
        got += [(r[1], r[2]) for p in parts for r in reader.read(p)]
        at, batches = new, batches + 1
    assert batches <= 6 and got == [(n, f"{n}-{k}") for n in range(1, 601) for k in range(2)]
    assert at["a"] == {"page": 600, "token": "t601", "done": False}
    (tmp_path / "set=a/page=601").mkdir()
    (tmp_path / "set=a/page=601/x").write_text(page(601, 601))
    again = harvest.HarvestReader(str(tmp_path), 10)
    again.partitions({}, at)  # after a restart
    assert again.latestOffset()["a"] == {"page": 601, "token": "", "done": True}


def test_hash_tree(spark):
    rows = spark.range(300).select("id", (F.col("id") * 3).alias("v"))
    node = lambda d: merkle.tree(d, "id", flows.cut)
    a = node(rows)
    seal = merkle.seal(a).first()
    assert seal == merkle.seal(node(rows.repartition(7).select("v", "id"))).first() and seal.n == 300
    proof = merkle.proofs(rows, "id", a, rows.filter("id % 60 = 0"))
    assert [r.s for r in proof.select(merkle.proven(proof).alias("s")).collect()] == [seal.seal] * 5
    forged = proof.withColumn("hash", F.sha2("hash", 256))
    assert all(r.s != seal.seal for r in forged.select(merkle.proven(forged).alias("s")).collect())
    other = rows.filter("id <> 5").withColumn("v", F.when(F.col("id") == 9, 0).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(1000, 1)], "id long, v long"))
    leaves = merkle.differing(a, node(other), flows.cut)
    assert leaves.count() <= 3
    assert {(r.id, r.change) for r in merkle.changes(rows, other, "id", leaves).collect()} == {(5, "removed"), (9, "changed"), (1000, "added")}
    assert merkle.differing(a, node(rows.repartition(3)), flows.cut).isEmpty()
    empty = merkle.seal(node(rows.limit(0))).first()
    assert empty.n == 0 and merkle.differing(a, node(rows.limit(0)), flows.cut).count() > 200


def test_proofs_move_no_siblings_of_each_row(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 7).alias("v"))
    nodes = merkle.tree(rows, "id", flows.cut, 2)
    proof = merkle.proofs(rows, "id", nodes, rows.filter("id % 100 = 3"), 2)
    # Nothing is grouped or joined by what a row has got already, which is up to 256 hashes a level.
    plan = proof._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "path" in line]
    got = {r.id: r for r in proof.collect()}
    assert set(got) == {i for i in range(2000) if i % 100 == 3}
    hashes, top = {}, {r.prefix: r.hash for r in nodes.filter("level = 1").collect()}
    for r in merkle.hashed(rows, "id").collect():
        hashes.setdefault(r.place[:4], []).append((r.place, r.hash))
    below = {r.prefix: r.hash for r in nodes.filter("level = 2").collect()}
    for r in got.values():
        leaf = sorted(hashes[r.place[:4]])
        assert r.path[0].others == [h for p, h in leaf if p != r.place] and r.path[0].before == [p for p, _ in leaf].index(r.place)
        for step, (start, table) in zip(r.path[1:], ((2, below), (0, top))):
            own, near = r.place[start : start + 2], {p[start:]: h for p, h in table.items() if p[:start] == r.place[:start]}
            assert step.others == [b + near[b] for b in sorted(near) if b != own] and step.before == sorted(near).index(own)
