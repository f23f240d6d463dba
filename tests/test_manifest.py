import bz2
import gzip
import hashlib
import os

import pytest

from fiscalis.functions import md5
from fiscalis.sources import files as fi


@pytest.fixture
def small_splits(spark, monkeypatch):
    monkeypatch.setattr(fi, "PIECE_BYTES", 64)
    monkeypatch.setattr(fi, "SEGMENT_BYTES", 4096, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def digests(spark, folder):
    rows = fi.manifest(spark, str(folder)).collect()
    got = {r.path.split(f"{folder.name}/")[1]: (r.bytes, r.md5) for r in rows}
    assert len(got) == len(rows)
    return got


def written(folder, bodies):
    folder.mkdir()
    for name, body in bodies.items():
        (folder / name).write_bytes(body)
    return {name: (len(body), hashlib.md5(body).hexdigest()) for name, body in bodies.items() if body}


def test_no_task_reads_a_whole_file(spark, tmp_path, small_splits, monkeypatch):
    want = written(tmp_path / "lake", {"a.csv": b"".join(b"%d;%d\n" % (i, i * i) for i in range(6000))})
    seen, kind = tmp_path / "seen", type(spark.range(1))
    seen.mkdir()
    folder, plain = str(seen), kind.mapInArrow

    def counting(self, function, schema, *rest, **named):
        def counted(batches):
            total = 0

            def passed():
                nonlocal total
                for batch in batches:
                    values = batch.column("piece" if "piece" in batch.schema.names else "line").to_pylist()
                    total += sum(len(v) for v in values)
                    yield batch
            yield from function(passed())
            with open(os.path.join(folder, f"{os.urandom(8).hex()}-{total}"), "w"):
                pass
        return plain(self, counted, schema, *rest, **named)
    monkeypatch.setattr(kind, "mapInArrow", counting)
    assert digests(spark, tmp_path / "lake") == want
    assert want["a.csv"][0] > 60_000
    assert max(int(name.split("-")[1]) for name in os.listdir(folder)) < 4096 + 1500 + 64


def test_digests_over_segments(spark, tmp_path, small_splits):
    bodies = {"long.txt": b"z" * 30_000 + b"\n\n\n" + b"y" * 9_000, "b.bin": bytes(range(256)) * 80, "empty.txt": b"", "one.txt": b"\n"}
    bodies |= {f"n{n}.txt": (b"abc\n" * 5000)[:n] for n in (1, 55, 56, 63, 64, 65, 1499, 1500, 4095, 4096, 4097, 8192, 12_287)}
    want = written(tmp_path / "lake", bodies)
    assert digests(spark, tmp_path / "lake") == want


def test_bytes_a_text_reader_would_change(spark, tmp_path, small_splits):
    text = b"x;y\n1;2\n" * 900
    bodies = {"mark.csv": b"\xef\xbb\xbf" + text, "mark_no_end.csv": b"\xef\xbb\xbf" + text[:-1], "mark.txt": b"\xef\xbb\xbf", "two.txt": b"\xef\xbb\xbf" * 2,
              "a.csv.gz": gzip.compress(text), "a.csv.bz2": bz2.compress(text), "not.gz": b"", "A.GZ": gzip.compress(text), "b.gzip": gzip.compress(text), "plain.zstd": text, "crlf.txt": b"a\r\nb\rc\r\n"}
    want = written(tmp_path / "lake", bodies)
    assert digests(spark, tmp_path / "lake") == want


def test_no_file(spark, tmp_path):
    (tmp_path / "lake").mkdir()
    (tmp_path / "lake" / "empty.txt").write_bytes(b"")
    assert digests(spark, tmp_path / "lake") == {}


@pytest.mark.parametrize("blocks", [md5.plain_blocks, md5.block_function()])
def test_md5_goes_on_from_a_state(blocks):
    for size in (0, 1, 55, 56, 63, 64, 65, 119, 120, 1000):
        data = bytes(i * 7 % 256 for i in range(size))
        state, at = md5.START, 0
        while len(data) - at >= md5.BLOCK:
            state, at = blocks(state, data[at:at + md5.BLOCK]), at + md5.BLOCK
        assert md5.finish(blocks, state, data[at:], size) == hashlib.md5(data).hexdigest()
