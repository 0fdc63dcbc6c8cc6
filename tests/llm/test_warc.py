import hashlib

import pytest

from wakeline.llm import warc as W


def pages():
    long = "<p>" + "é" * 100
    return [(5, "http://a/x y", long), (3, "http://b", long), (9, None, long), (1, "http://c", "short"), (2, "http://d", "short"), (4, "u", None), (6, "u", ""), (7, "u", "a\r\n\r\nb\n\rWARC/1.0\r\n\n\n" + "z" * 100), (8, "u", "\n" * 150), (None, "u", long), (10, "ü\n", "filedesc://x 1 2 3 4\n" + "y" * 100)]


def brute(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = i is not None and len(body) >= 100 and i > min(same)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    df = spark.createDataFrame([(*r, 1) for r in pages()], "page_id long, url string, html string, digest int")
    out = W.through_archives(df, version)
    assert sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(pages())
    ids = [r.record_id for r in out.collect()]
    assert len(set(ids)) == len(ids) and all(r.date == "2024-01-01T00:00:00Z" for r in out.collect())


def test_arc_records(spark, tmp_path):
    path = W.write_arc(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1), str(tmp_path / "arc"), 2)
    got = {r.page_id: r for r in W.read_arc(spark, path).collect()}
    assert got[5].url == "http://a/x%20y" and got[5].version == 2 and got[5].content_type == "text/html" and got[7].bytes == len(pages()[7][2])


def lines(text):
    import pyarrow as pa

    own = text.encode().split(b"\n")
    return [pa.RecordBatch.from_arrays([pa.array(["f"] * len(own)), pa.array(own, pa.binary())], ["file", "value"])]


HEAD = "1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"


def test_broken_archives():
    head = f"filedesc://a 0 20240101000000 text/plain {len(HEAD)}\n{HEAD}\n"
    assert [r["block"] for r in W.arc_records(lines(head + "http://a 0 20240101000000 t 3\nabc\n"))] == [b"abc"]
    for bad in (head + "http://a 0 20240101000000 t 9\nabc", head + "http://a 0 t 3\nabc\n", "http://a 0 20240101000000 t 3\nabc\n", head.replace("1 0 x", "3 0 x"), head + "http://a 0 20240101000000 t 1\nabc\n"):
        with pytest.raises(ValueError):
            list(W.arc_records(lines(bad)))


def test_edges(spark):
    assert W.through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    twice = spark.createDataFrame([(1, "u", "a" * 200)] * 2 + [(2, "u", "a" * 200)] * 2, "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in W.through_archives(twice).collect()) == [(1, "response"), (1, "response"), (2, "revisit"), (2, "revisit")]
