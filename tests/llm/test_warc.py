import gzip
import hashlib

import duckdb
import pytest

from loomdoc.llm import queries, shared, warc

from .conftest import same

SCHEMA = "page_id bigint, url string, html string"


def page_rows():
    big, other = "<p>é</p>" * 200, "<b>x</b>" * 130
    rows = [(i, f"https://www.Example{i % 7}.org:8080/a/{i % 5}?q={i}#f", f"<html>{i}</html>" * (i % 4 * 40)) for i in range(40)]
    rows += [(100 + i, "http://same.net/", big) for i in range(6)] + [(90, None, other), (95, "", other), (95, "", other), (96, None, None), (None, "x", big), (None, None, None)]
    rows += [(200, "http://[bad", "short"), (201, "short.example/line\nbreak", "short"), (105, "http://other.net", other)]
    return rows


def brute_force(rows):
    raw = [(r[2] or "").encode() for r in rows]
    last = {}
    for r, x in zip(rows, raw, strict=True):
        if len(x) >= 1000 and r[0] is not None:
            last[x] = max(r[0], last.get(x, r[0]))
    out = []
    for r, x in zip(rows, raw, strict=True):
        revisit = r[0] is not None and last.get(x, r[0]) != r[0]
        out.append((r[0], len(x), hashlib.sha1(x).hexdigest(), "revisit" if revisit else "response", last[x] if revisit else None))
    return out


def test_digest_equals_brute_force(spark):
    rows = page_rows()
    want = brute_force(rows)
    assert sum(w[3] == "revisit" for w in want) > 6
    same([tuple(r) for r in warc.digest(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as refers_to")).collect()], want)


def test_small_archives_blocks_and_parts(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    lines = shared.written(warc.write(warc.referred(pages), archive_bytes=3000), "records")
    assert lines.select("archive").distinct().count() > 3
    parts = warc.index(lines, part_lines=9, block_lines=2)
    assert parts.count() > 3
    wanted = ["net,same)/", "org,example3:8080)/a/3?q=3", "zz,none)/", "-"]
    found = warc.lookup(spark, parts, spark.createDataFrame([(x,) for x in [*wanted, wanted[0]]], "key string"))
    by_key = {k: sorted(r.page_id or -1 for r in found.collect() if r.key == k) for k in wanted}
    assert by_key == {wanted[0]: [100, 101, 102, 103, 104, 105], wanted[1]: [3], wanted[2]: [], "-": [-1, 90, 95, 95, 96]}
    records = warc.fetch(found).collect()
    html = {(r[0], r[2] or "") for r in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in records)
    assert all(r.payload is None or (r.page_id, bytes(r.payload).decode()) in html for r in records)


def test_sql_equals_brute_force():
    rows, db = page_rows(), duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    same(db.execute(queries.oracle_sql()["op4_warc"]).fetchall(), brute_force(rows))


def test_archives_are_plain_gzip_members():
    members = [warc.make_record(i, f"http://a/{i}", b"x" * i, None) for i in range(4)]
    raw = gzip.decompress(b"".join(members))
    assert raw.count(b"WARC/1.1\r\n") == 4
    assert warc.read_record(members[3])["payload"] == b"xxx"


def test_revisits_name_their_response(spark):
    pages = spark.createDataFrame(page_rows(), SCHEMA).repartition(3)
    lines = shared.written(warc.write(warc.referred(pages), archive_bytes=3000), "records")
    records = warc.fetch(lines).collect()
    answers = {r.record_id: r for r in records if r.record_type == "response"}
    revisits = [r for r in records if r.record_type == "revisit"]
    assert len(revisits) > 6 and all(answers[r.refers_id].page_id == r.refers_to and answers[r.refers_id].payload_digest == r.payload_digest and r.payload_bytes is None for r in revisits)
    name = lines.first().archive
    raw = gzip.decompress(shared.get(name))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and raw.count(b"WARC-Type: warcinfo") == 1
    with pytest.raises(Exception, match="a revisit without its response"):
        lost = lines.where("page_id <> 105")
        monkey = pytest.MonkeyPatch()
        monkey.setattr(warc, "write", lambda _: lost)
        try:
            warc.digest(pages).collect()
        finally:
            monkey.undo()


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        warc.digest(spark.createDataFrame([("a", "u", "x")], "page_id string, url string, html string"))


def test_keys():
    assert warc.url_key("HTTPS://User@www.Example.COM:443/A?b=C#d") == "com,example)/A?b=C"
    assert warc.url_key("example.com:81") == "com,example:81)/"
    assert warc.url_key(None) == warc.url_key("") == "-"


def test_malformed_urls_with_line_breaks_are_found(spark):
    urls = ["http://[x]/a\nb", "http://a:99999/c\nd", "http://a:80x/\x00e\n\nf", "http://[x]/a", "b", "http://ok.net/g"]
    rows = [(i, x, f"<p>{i}</p>") for i, x in enumerate(urls)]
    assert not any("\n" in warc.url_key(x) or "\0" in warc.url_key(x) for x in urls)
    same([tuple(r) for r in warc.digest(spark.createDataFrame(rows, SCHEMA)).collect()], brute_force(rows))


def test_empty_table(spark):
    assert warc.digest(spark.createDataFrame([], SCHEMA)).count() == 0
