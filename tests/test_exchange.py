"""Change feed pages and requests as data sources: partitions, pushed filters, limits, streams, and commits that survive failed tasks."""

import json

import pytest
from pyspark.sql import functions as F

from loomdoc.plans.errors import QueryError
from loomdoc.sources import exchange, protocol


@pytest.fixture(autouse=True)
def formats(spark):
    exchange.register(spark)


def page(*seqs, **more):
    rows = [{"seq": s, "id": f"d{exchange.number_of(s) % 7}", "changes": [{"rev": "1-x"}, {"rev": "1-a"}], **({"deleted": True} if exchange.number_of(s) % 5 == 0 else {})} for s in seqs]
    return json.dumps({"results": rows, "last_seq": seqs[-1] if seqs else 0}, **more)


@pytest.fixture
def pages(tmp_path):
    """Five files: one page, an indented one, two pages on lines, an overlapping pair; one is empty."""
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.json").write_text(page(*range(1, 11)))
    (folder / "b.json").write_text(page(*range(11, 21), indent=1))
    (folder / "c.json").write_text(page(*range(21, 26)) + "\n" + page(*[f"{x}-tail" for x in range(26, 31)]) + "\n")
    (folder / "d.json").write_text(page(*range(31, 41)))
    (folder / "e.json").write_text(page(*range(38, 46)))
    (folder / "f.json").write_text(page())
    (folder / "_hidden.json").write_text("not a page")
    return str(folder)


def numbers(df):
    return sorted(r.number for r in df.collect())


def test_clusters_are_partitions(spark, pages):
    read = spark.read.format("loomdoc_changes").option("partition_bytes", 1).load(pages)
    assert numbers(read) == list(range(1, 46))
    assert read.rdd.getNumPartitions() == 4
    assert spark.read.format("loomdoc_changes").option("since", "20-x").option("partition_bytes", 1).load(pages).rdd.getNumPartitions() == 2
    row = read.where("number = 26").first()
    assert (row.seq, row["_id"], list(row.revids), row.deleted) == ("26-tail", "d5", ["1-x", "1-a"], False)


def test_filters_reach_the_source(spark, pages):
    read = spark.read.format("loomdoc_changes").load(pages)
    for condition, holds in {
        "number > 12 AND number <= 33": lambda n: 12 < n <= 33, "number >= 12 AND number < 14": lambda n: 12 <= n < 14, "number = 40": lambda n: n == 40, "number > 100": lambda n: False, "_id = 'd3'": lambda n: n % 7 == 3,
        "_id IN ('d3', 'd4') AND number > 20 AND deleted": lambda n: n % 7 in (3, 4) and n > 20 and n % 5 == 0, "NOT deleted AND seq = '40'": lambda n: False, "_id = 'd3' AND _id = 'd4'": lambda n: False, "number > 5 OR deleted": lambda n: n >= 5,
    }.items():
        assert numbers(read.where(condition)) == [n for n in range(1, 46) if holds(n)], condition
    reader = exchange.ChangesReader(exchange.Pages(pages), 0, None)
    assert list(reader.pushFilters([exchange.GreaterThan(("number",), 30), exchange.EqualTo(("seq",), "x")])) == [exchange.EqualTo(("seq",), "x")]
    assert {n for p in reader.partitions() for n in p.names} == {"d.json", "e.json"}


def test_limits(spark, pages):
    for since, limit in ((0, 1), (0, 10), (3, 12), (25, 14), (36, 4), (0, 100), (45, 5)):
        read = spark.read.format("loomdoc_changes").option("since", since).option("limit", limit).load(pages)
        assert numbers(read) == list(range(1, 46))[since : since + limit]
        assert numbers(read.where("deleted")) == [n for n in range(1, 46)[since : since + limit] if n % 5 == 0]  # filters come after a limit


def test_the_index_spares_reading(spark, pages, monkeypatch):
    assert exchange.index_pages(spark, pages) == 6 == exchange.index_pages(spark, pages)
    opened, read = [], exchange._read
    monkeypatch.setattr(exchange, "_read", lambda path: opened.append(path.rpartition("/")[2]) or read(path))
    stream = exchange.ChangesStream(exchange.Pages(pages), 0, None)
    assert stream.latestOffset() == {"seq": 45} and set(opened) == {exchange.INDEX}
    limited = exchange.ChangesStream(exchange.Pages(pages), 0, 25)
    assert limited.latestOffset() == {"seq": 25} and set(opened) == {exchange.INDEX, "c.json"}
    with open(f"{pages}/a.json", "w") as out:
        out.write(page(1, 2))  # a file that changed is looked at again
    assert [p.count for p in exchange.Pages(pages).all() if p.name == "a.json"] == [2]


def test_streams_go_on_where_they_stopped(spark, pages, tmp_path):
    def run(**options):
        stream = spark.readStream.format("loomdoc_changes").options(**options).load(pages)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return numbers(spark.read.parquet(str(tmp_path / "out")))

    assert run(limit=20) == list(range(1, 46))
    with open(f"{pages}/g.json", "w") as out:
        out.write(page(44, 45, 46, 47))
    assert run() == list(range(1, 48))


def test_selected_documents(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"d{k % 3}", ["1-a"], k == 4, None if k == 5 else json.dumps({"n": k})) for k in range(1, 8)], "seq bigint, _id string, revids array<string>, deleted boolean, json string")
    protocol.change_pages(rows, 2).write.text(path := str(tmp_path / "made"))
    read = spark.read.format("loomdoc_changes").load(path)
    assert numbers(read) == list(range(1, 8)) and read.where("number = 4").first().deleted
    assert numbers(exchange.selected(read, {"n": {"$gt": 2}}, ["d0", "d1"])) == [3, 4, 6, 7]


def lines(folder):
    return {x.value for x in folder.collect()}


@pytest.mark.parametrize("size", [1, 3])
def test_requests_are_written_and_read(spark, tmp_path, size):
    path = str(tmp_path / "requests")
    docs = spark.range(20).select(F.format_string('{"_id":"d%d","note":"a\\\\nb"}', "id").alias("value")).repartition(3)
    docs.write.format("loomdoc_requests").option("kind", "bulk").option("size", size).mode("append").save(path)
    back = [json.loads(x) for x in lines(spark.read.format("loomdoc_requests").load(path))]
    assert sorted(d["_id"] for x in back for d in x["docs"]) == sorted(f"d{i}" for i in range(20)) and all(len(x["docs"]) <= size and x["new_edits"] is False for x in back)
    diffs = spark.createDataFrame([('{"a":["1-x"]}',), ('{"b":["1-y"]}',), ('{"a":["2-x"]}',), (None,)], "value string").coalesce(1)
    diffs.write.format("loomdoc_requests").option("kind", "diff").mode("append").save(path)
    assert [json.loads(x) for x in lines(spark.read.format("loomdoc_requests").option("kind", "diff").load(path))] == [{"a": ["1-x", "2-x"], "b": ["1-y"]}]
    spark.createDataFrame([(protocol.checkpoint_document("abc", 7),)], "value string").write.format("loomdoc_requests").option("kind", "checkpoint").mode("append").save(path)
    assert [json.loads(x)["lastSequence"] for x in lines(spark.read.format("loomdoc_requests").option("kind", "checkpoint").load(path))] == [7]
    diffs.write.format("loomdoc_requests").option("kind", "diff").mode("overwrite").save(path)
    assert spark.read.format("loomdoc_requests").load(path).select("kind").distinct().count() == 1
    assert spark.read.format("loomdoc_requests").load(str(tmp_path / "none")).count() == 0
    for bad in ({"kind": "other"}, {"size": 0}):
        with pytest.raises(Exception, match="kinds of requests|at least one"):
            diffs.write.format("loomdoc_requests").options(**bad).mode("append").save(path)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "requests"
    bad = spark.range(8).repartition(4).select(F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit('{"_id":"x"}')).cast("string").alias("value"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("loomdoc_requests").mode("append").save(str(path))
    assert exchange.committed(str(path)) == [] and spark.read.format("loomdoc_requests").load(str(path)).count() == 0


def test_attempts_and_batches_that_run_twice(tmp_path):
    """Only the attempts in the messages count; a batch has one commit."""
    path = str(tmp_path)
    writer = exchange.RequestsWriter(path, "bulk", 2, 0, False)
    lost, good, none = writer.write(iter([("1",), ("2",), ("3",)])), writer.write(iter([("1",), ("2",), ("3",)])), writer.write(iter([]))
    assert none.name is None and lost.name != good.name
    writer.commit([good, none, None], 4)
    assert exchange.committed(path) == [(good.name, 2, "bulk")]
    again = exchange.RequestsWriter(path, "bulk", 2, 0, False)
    second = again.write(iter([("1",), ("2",), ("3",)]))
    again.commit([second], 4)
    assert exchange.committed(path) == [(good.name, 2, "bulk")] and not (tmp_path / second.name).exists()
    writer.abort([lost, None], 5)
    assert not (tmp_path / lost.name).exists()


def test_a_stream_of_requests(spark, pages, tmp_path):
    path, state = str(tmp_path / "requests"), str(tmp_path / "state")
    for _ in range(2):
        rows = spark.readStream.format("loomdoc_changes").option("limit", 20).load(pages)
        query = rows.select(F.to_json(F.create_map("_id", "revids")).alias("value")).writeStream.format("loomdoc_requests").option("kind", "diff").option("path", path).option("checkpointLocation", state).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    asked = [json.loads(x) for x in lines(spark.read.format("loomdoc_requests").load(path))]
    assert {k for x in asked for k in x} == {f"d{i}" for i in range(7)} and all(v == ["1-a", "1-x"] for x in asked for v in x.values())


def test_objects_of_a_file():
    assert list(exchange.objects(' {"a":\n{"b": 1}}\n{"c": 2} {"d": 3}\n')) == [{"a": {"b": 1}}, {"c": 2}, {"d": 3}] and list(exchange.objects(" \n")) == []
    with pytest.raises(QueryError):
        exchange.RequestsSource({"path": "x", "kind": "z"})._writer(type("S", (), {"names": ["value"]})(), False)


def test_stretches_of_large_files(spark, tmp_path, monkeypatch):
    """Pages of one file are found and read stretch by stretch, in whatever order and spacing they stand."""
    folder = tmp_path / "large"
    folder.mkdir()
    rows = [page(*range(10 * k + 1, 10 * k + 11)) for k in range(60)]
    rows[7] = rows[7].replace("d1", "é中" * 400)  # a page larger than a stretch, of signs of several bytes
    (folder / "a.json").write_text(" \n" + "\n".join(rows[:20]) + "\n\n" + page() + "".join(reversed(rows[20:40])) + "\n")
    (folder / "b.json").write_text("\n".join([*rows[40:], page(595, 601, indent=1)]))
    monkeypatch.setattr(exchange, "STRETCH_BYTES", 2000)
    stretches = {name: exchange.pages_of(str(folder), name, (folder / name).stat().st_size) for name in ("a.json", "b.json")}
    for name, own in stretches.items():
        assert "".join("".join(p.text(str(folder)) for p in own).split()) == "".join((folder / name).read_text().split()) and sum(p.count for p in own) == {"a.json": 400, "b.json": 202}[name]
        assert len(own) > 10 and all(p.bytes <= 2000 or p.count == 10 for p in own)
    pages = exchange.Pages(str(folder), 1)
    parts = exchange.ChangesReader(pages, 0, None).partitions()
    assert len(parts) > 30 and max(len(x) for p in parts for x in p.clusters) == 2
    assert [n for p in parts for n, _ in exchange.read_cluster(str(folder), p)] == list(range(1, 602))
    assert exchange.index_pages(spark, str(folder)) == 2
    read = spark.read.format("loomdoc_changes").load(str(folder))
    assert numbers(read) == list(range(1, 602)) and numbers(read.where("number > 195 AND number <= 204")) == list(range(196, 205))
