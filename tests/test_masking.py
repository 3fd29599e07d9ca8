import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumberline.functions import masking
from lumberline.functions.masking import MaskConfig, classify_token, mask_line, mask_token, masked, masked_token

LINES = [
    ("peer 172.20.3.9 left", "peer <IP> left"),
    ("dial 203.0.113.77:5432 refused", "dial <IP> refused"),
    ("from 2001:db8::ff00:42 hop", "from <IPV6> hop"),
    ("txn 7d444840-9dc0-11d1-b245-5ffdce74fad2 open", "txn <UUID> open"),
    ("blob 9f86d081884c7d65 stored", "blob <HEX> stored"),
    ("POST http://shop.example/cart?id=7 503", "POST <URL> <NUM>"),
    ("mount /opt/data/vol1 lost", "mount <PATH> lost"),
    ("load D:\\Games\\save.dat", "load <PATH>"),
    ("mail ops-team@corp.example queued", "mail <EMAIL> queued"),
    ('body {"k":[1,2]} sent', "body <JSON> sent"),
    ("woke 23:59:01 again", "woke <TIME> again"),
    ("slept 1.5h then", "slept <TIME> then"),
    ("page 7 of 88", "page <NUM> of <NUM>"),
    ("lag 0.25s", "lag <TIME>"),
    ("reply code=404 sent", "reply code=<NUM> sent"),
    ("file=/srv/www/x gone", "file=<PATH> gone"),
    ("shard-7 job_77ab01cd2 node-4:9200", "shard-<NUM> job_<HEX> node-<NUM>:<NUM>"),
    ("two  spaces   stay", "two  spaces   stay"),
    ("x=y=2 z=", "x=y=2 z="),
    ("/srv / //", "/srv / <PATH>"),
    ("ñ-34 über", "ñ-<NUM> über"),
    ("", ""),
]


@pytest.mark.parametrize("line,want", LINES)
def test_lines(line, want):
    assert mask_line(line) == want


def test_native_form_agrees(spark):
    tokens = sorted({t for line, _ in LINES for t in line.split()} | {"+5", "-.5", "1.2.3", "deadbeef", "12:30", "1h2m", "...s", "\\\\srv\\share", "[\"a\"]", "x@y.zz", "@ab.c", "abc@d"})
    df = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", masked_token(F.col("t")).alias("m"))
    assert {r["t"]: r["m"] for r in df.collect()} == {t: mask_token(t) or t for t in tokens}
    lines = spark.createDataFrame([(line,) for line, _ in LINES], "t string").select("t", masked(F.col("t")).alias("m"))
    assert {r["t"]: r["m"] for r in lines.collect()} == dict(LINES)


def test_header_and_switches():
    assert mask_line("MyApp[12345:1] web-prod up", (None, "<HEX>")) == "MyApp[<NUM>:<NUM>] <HEX> up"
    assert mask_line("MyApp[1:2] x", ("<NUM>",)) == "MyApp[<NUM>:<NUM>] x"
    # without times a clock has the shape of an IPv6 address
    assert mask_line("up 07:08:09 5", config=MaskConfig(times=False, nums=False)) == "up <IPV6> 5"
    assert mask_line("up 07:08:09 5", config=MaskConfig(times=False, nums=False, ips=False)) == "up 07:08:09 5"
    assert classify_token("MyApp[12345:1]") == "<NUM>"
    assert classify_token("ERROR") is None


def test_lines_of_a_batch_are_masked_like_one():
    rng = random.Random(8)
    pieces = ["user=42", "10.0.0.1", "/a/b.c", "x", "id_7", "4a5b6c7d8e", "{a:1}", "é9", "\x1cq", "12:30", "a-7-b", ""]
    gaps = [" ", "  ", "\t", "\u3000", "\x85", "\x1d"]
    lines = ["".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(rng.randrange(9))) for _ in range(500)] + ["", " ", None, "7", " 7 x"]
    for header in ((), ("<NUM>", None, "<HEX>"), (None, None, None, "<TIME>")):
        for config in (masking.MaskConfig(), masking.MaskConfig(nums=False, paths=False)):
            got = masking.mask_lines(pa.array(lines, pa.string()), header, config).to_pylist()
            assert got == [None if x is None else masking.mask_line(x, header, config) for x in lines]
    assert masking.mask_lines(pa.array([], pa.string())).to_pylist() == []
    assert masking.mask_lines(pa.array(["a 1", "b"], pa.string()).slice(1)).to_pylist() == ["b"]


def test_plain_words_are_not_tried_one_by_one(monkeypatch):
    tried = []
    monkeypatch.setattr(masking, "mask_token", lambda t, config: tried.append(t) or mask_token(t, config))
    assert masking.mask_lines(pa.array(["plain words, and others.", "a-b (c) user_id v=w", "at 7"])).to_pylist()[2] == "at <NUM>"
    assert tried == ["7"]


def test_maskable_has_all_tokens_that_change():
    rng, maskable = random.Random(5), pa.compute.match_substring_regex
    bits = ["a", "F", "deadbeef", "-", "dead", "m", "s", ".", "=", ":", "/", "\\", "@", "{", "[", "]", "}", '"', "7", "x.y", "+", "://", "é", "(", "٣"]
    tokens = sorted({"".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(30_000)} | {"abcdefab-abcd-abcd-abcd-abcdefabcdef", "..s", "k=.m", "k=m."})
    for token, likely in zip(tokens, maskable(pa.array(tokens), masking.MASKABLE).to_pylist()):
        assert likely or mask_token(token) is None, token
    assert mask_token("k=.m") and mask_token("abcdefab-abcd-abcd-abcd-abcdefabcdef")
