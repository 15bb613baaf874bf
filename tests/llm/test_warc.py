import gzip
import random
import zlib

import pytest

from tidemark.llm import warc


def pages(rng):
    htmls = ["", None, "é" * 5, "x" * 100_000, "a\r\n\r\nWARC/1.0\r\n\r\n", "<p>\r\n</p>"] + ["".join(rng.choice("ab<>\n") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    rows = [(i, rng.choice([None, "http://x/é", "u\r\nX: y"]), rng.choice(htmls), "z") for i in rng.sample(range(1000), 150)]
    return rows + [(None, "u", "only", "z"), (None, "u", "only", "z"), rows[0]]


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    rows = pages(random.Random(6))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(3)
    for least in (0, 6):
        got = warc.archive_pages(df, least).collect()
        assert len(got) == len(rows)
        first = {}
        for p, _, h, _ in rows:
            b = (h or "").encode()
            if p is not None:
                first[b] = min(first.get(b, p), p)
        want = sorted((str(p), len(b := (h or "").encode()), warc.digest(b)) for p, _, h, _ in rows)
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
        by = {warc.digest(b): b for b in {(h or "").encode() for _, _, h, _ in rows}}
        heads = {}
        for r in got:
            b = by[r.payload_digest]
            if r.record_type == "response":
                assert r.payload == b and r.refers_to is None
                heads[b] = heads.get(b, 0) + 1
                if len(b) >= least:
                    assert r.page_id == first.get(b)
            else:
                assert len(b) >= least and r.refers_to == first.get(b) and r.payload is None
        assert all(n == 1 for b, n in heads.items() if len(b) >= least)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_members_stand_alone(tmp_path):
    data = [warc.response(i, i, f"http://{i}", bytes([i]) * i * 40, "2020-01-01T00:00:00Z") for i in range(30)]
    source, target = f"file://{tmp_path}/a.gz", f"file://{tmp_path}/b.gz"
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(data)))
    assert warc.rewrite(source, target, {}) == 30
    assert gzip.decompress((tmp_path / "b.gz").read_bytes()) == b"".join(data)
    d = zlib.decompressobj(31)
    assert d.decompress((tmp_path / "b.gz").read_bytes()) == data[0]
    got = list(warc.read_indexed(target))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == [bytes([i]) * i * 40 for i in range(30)]
    with pytest.raises(ValueError):
        list(warc.records([data[5][:-60]]))
