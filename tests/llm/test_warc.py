import hashlib

import pytest

from pulsegrid.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, digest string, n int"
LONG = "<p>" + "long enough to be a revisit " * 8 + "é</p>"


def pages():
    rows = [(i, f"http://x/{i}", f"<html>page {i} " + "word " * (i % 40) + "</html>") for i in range(60)]
    rows += [(200, "u", LONG), (150, "u", LONG), (300, None, LONG), (None, "u\r\nX: y", LONG), (150, "again", LONG)]
    return rows + [(400, "u", None), (401, "u", ""), (402, "u", "short"), (403, "u", "short"), (None, "v", "z" * 200), (None, "w", "z" * 200)]


def expected(rows):
    out, groups = [], {}
    for i, _, h in rows:
        p = (h or "").encode()
        groups.setdefault(p, []).append(i)
    for i, _, h in rows:
        p = (h or "").encode()
        ids = [x for x in groups[p] if x is not None]
        again = len(p) >= 100 and ids and len(groups[p]) > 1 and i != min(ids)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=repr)


def test_written_and_read_back(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)
    manifest = W.archive(df, str(tmp_path / "w")).persist()
    got = [tuple(r) for r in W.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == expected(rows)
    payloads = {r.page_id: bytes(r.payload) for r in W.read(manifest).where("record_type = 'response'").collect()}
    assert payloads[150] == LONG.encode() and payloads[7].startswith(b"<html>page 7")
    assert sum(r.n_records for r in manifest.collect()) == len(rows)


def test_every_record_is_a_frame_after_the_dictionary(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<html>{i} " + "common words of all pages " * 30) for i in range(200)], "page_id bigint, url string, html string")
    rows = W.archived(df)
    made = W.dictionary(df)
    assert made and len(made) > 1000
    archive = W.write(rows.coalesce(1), str(tmp_path / "w"), made).first()
    data = open(archive.archive, "rb").read()
    assert int.from_bytes(data[:4], "little") == W.DICTIONARY_MAGIC
    assert data[8 : 8 + int.from_bytes(data[4:8], "little")] == made
    plain = W.write(rows.coalesce(1), str(tmp_path / "p"), None).first()
    assert archive.n_bytes - len(made) < 0.7 * plain.n_bytes
    assert len(list(W.frames(archive.archive, chunk=100))) == len(list(W.frames(plain.archive))) == 200


def test_a_cut_archive_is_an_error(tmp_path):
    import zstandard

    whole = zstandard.compress(W.record(1, "u", b"payload" * 50, "d", None, False))
    (tmp_path / "x").write_bytes(whole[:-5])
    with pytest.raises(EOFError):
        list(W.frames(str(tmp_path / "x")))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert W.read(W.archive(df, str(tmp_path / "w"))).count() == 0
