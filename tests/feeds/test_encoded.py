"""Files in any encoding, cut at any place, against Python's own decoding; digests as streams."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sluice import queries
from sluice.errors import ContractError
from sluice.plans.contract import ColumnSpec, FeedContract
from sluice.sources import encoded

#: Characters whose bytes hold a line feed's, alone or with a neighbour.
TRAPS = "ਅ一Ċ　ऊ਀Āaਊ\u000a一਀\u000a\n"
POOLS = {
    "utf-8": "aé日😀\n", "utf-8-sig": "aé日\n", "ascii": "ab\n", "latin-1": "aéÿ\x85\n", "cp1252": "a€é\n", "cp437": "a█é\n", "koi8-r": "aЖ\n", "cp037": "abé\n", "mac_roman": "a∑\n",
    "utf-16": TRAPS, "utf-16-le": TRAPS, "utf-16-be": TRAPS, "utf-32": TRAPS + "😀", "utf-32-le": TRAPS, "utf-32-be": TRAPS + "😀", "gbk": "a一丁\n", "gb18030": "aé😀丂\n", "shift_jis": "aソ表\n", "big5": "a功\n", "euc_kr": "a가\n",
}


def contract(encoding):
    return FeedContract(client="c", feed_name="f", format="csv", columns=(ColumnSpec("a", "trade_id"),), header_rows=1, trailer_rows=1, skip_blank_lines=True, encoding=encoding)


@pytest.mark.parametrize("split", ["23", "128m"])
@pytest.mark.parametrize("encoding", sorted(POOLS))
def test_any_split(spark, tmp_path, encoding, split):
    r = random.Random(encoding)
    texts = {f"f{k}.txt": "top\n" + "".join(r.choice(POOLS[encoding]) for _ in range(60)) + "\nend" + r.choice(["", "\n"]) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = encoded.encoded_lines(spark, str(tmp_path), contract(encoding)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        want = [x for x in text.splitlines() if x.strip()][1:-1]
        assert sorted((x.idx, x.line) for x in got if x.sample == name) == list(enumerate(want)), name


def test_places_are_alike_in_every_pass(spark, tmp_path):
    """Adaptive plans merge partitions by what else is in a stage: the pass that counts and the one that reads have to agree all the same."""
    r = random.Random(7)
    held = {"spark.sql.files.maxPartitionBytes": "60k", "spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = {k: spark.conf.get(k, None) for k in held}
    texts, lines = {}, None
    for encoding in ("utf-16", "utf-16-le", "utf-32-be"):
        (tmp_path / encoding).mkdir()
        for k in range(2):
            name = f"{encoding}-{k}"
            texts[name] = "t\n" + "".join("".join(r.choices("abcé日", k=r.randint(0, 200))) + r.choice(["\n", "\n", "Ċ\n", "ਊ\u0a00一"]) + f"{i}\n" for i in range(1500)) + "e"
            (tmp_path / encoding / name).write_bytes(texts[name].encode(encoding))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for encoding in ("utf-16", "utf-16-le", "utf-32-be"):
            one = encoded.encoded_lines(spark, str(tmp_path / encoding), contract(encoding))
            lines = one if lines is None else lines.unionByName(one)
        got = lines.collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name, text in texts.items():
        want = [x for x in text.splitlines() if x.strip()][1:-1]
        assert sorted((x.idx, x.line) for x in got if x.sample == name) == list(enumerate(want)), name


def test_both_marks_in_one_feed(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\xfe\xff" + "t\n﻿x\ne".encode("utf-16-be"))
    (tmp_path / "b").write_bytes("t\ny\ne".encode("utf-16"))
    (tmp_path / "c").write_bytes("t\nz\ne".encode("utf-16-le"))
    got = encoded.encoded_lines(spark, str(tmp_path), contract("UTF-16")).collect()
    assert sorted((r.sample, r.line) for r in got) == [("a", "﻿x"), ("b", "y"), ("c", "z")]


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"t\n\x81\ne\n")
    for name in ("no-such", "iso2022_jp", "utf-7", "rot13", "punycode"):
        with pytest.raises(ContractError):
            encoded.encoded_lines(spark, str(tmp_path), contract(name))
    for name in ("cp1252", "utf-8", "gbk"):
        with pytest.raises(PySparkException):
            encoded.encoded_lines(spark, str(tmp_path), contract(name)).collect()


def test_digests(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"")  # Spark lists no empty files
    contents = {"b": b"x", "c": b"\n", "d": b"x\n", "e": b"\r\n\x00\xff" * 5000 + b"\n\n", "f": bytes(range(256)) * 300}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        for large in (0, 1, 1000, 1 << 30):
            got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in encoded.digests(spark, str(tmp_path), large).collect()}
            assert got == {n: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in contents.items()}, large
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_take_no_more_than_the_texts(spark, monkeypatch):
    """The query's files of 1, 2 and 4 bytes a character never lie there all at once, and none is left."""
    sf, held = "/root/testdata/sf0.001", []
    texts = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    top = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(top.glob("encoded-*"))
    read = encoded.encoded_lines

    def measured(*args):
        held.append(sum(p.stat().st_size for d in set(top.glob("encoded-*")) - before for p in d.glob("part-*")))
        return read(*args)

    monkeypatch.setattr(encoded, "encoded_lines", measured)
    assert queries.encoded_documents(spark, sf).count() == 3 * spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").count()
    assert 0 < max(held) < 2 * texts
    assert set(top.glob("encoded-*")) == before
