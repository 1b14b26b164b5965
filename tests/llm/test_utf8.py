"""The UTF-8 machine against Python's decoder, and the encoding query's digests on a table."""

import random

from . import brute

SF = "/root/testdata/sf0.001"


def test_any_bytes_in_any_pieces():
    from tessellum.llm.byte_bpe import Utf8Stream

    r = random.Random(9)
    bits = [b"a", b"\xc3\xa9", b"\xe6\x97\xa5", b"\xf0\x9f\x99\x82", b"\x80", b"\xbf", b"\xc0", b"\xc3", b"\xe0\x80", b"\xed\xa0\x80", b"\xf0\x9f", b"\xf4\x90\x80\x80", b"\xf5", b"\xff", b"\xe6\x97", b" "]
    for _ in range(3000):
        data = b"".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        s, at, out = Utf8Stream(), 0, []
        while at < len(data):
            k = r.randint(1, 4)
            out.append(s.feed(data[at : at + k]))
            assert len(s.held) <= 3 and data[: at + k].endswith(s.held)
            at += k
        assert "".join([*out, s.end()]) == data.decode("utf-8", "replace")


def test_every_character():
    from tessellum.llm.byte_bpe import Utf8Stream

    text = "".join(map(chr, [*range(0x20, 0xD800, 7), *range(0xE000, 0x110000, 331)]))
    raw, s = text.encode(), Utf8Stream()
    assert "".join([*(s.feed(raw[i : i + 5]) for i in range(0, len(raw), 5)), s.end()]) == text


def test_digests_on_table(spark):
    import base64

    import public_tokenizers as public
    import tiktoken

    from tessellum.llm.byte_bpe import encode_digests
    from tessellum.llm.queries import op2_byte_bpe

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [(x.doc_id, len(i := e.encode_ordinary(x.text)), brute.sha(",".join(map(str, i)).encode()), brute.sha(x.text.encode())) for x in docs.collect()]
    assert sorted(map(tuple, op2_byte_bpe(spark, SF).collect())) == sorted(want)
    assert encode_digests(docs.limit(0), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == 0
