import base64
import gzip
import hashlib
import random
import struct

import pytest
import sentencepiece

from monthmill.llm import sentencepieces, warc
from monthmill.llm.common import folder
from tests.llm.data import by_id, corpus, documents

PAGES = "page_id long, url string, html string"


def pages(spark):
    rng = random.Random(6)
    bodies = ["<p>one</p>", "", None, "é" * 40, "<b>" + "x" * 50000]
    rows = [(i, f"http://www.h{i % 4}.example.com:80/p/{i % 9}?q={i % 3}#f", rng.choice(bodies)) for i in range(120)]
    rows += [(500, None, "<p>one</p>"), (501, "http://[bad", "alone"), (502, "http://h1.example.com/ a\tb\n", "alone too"),
             (None, "http://n.example/", "no id"), (None, "http://n.example/", "<p>one</p>"), (119, rows[119][1], rows[119][2])]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", key int")


def reference(rows, least=0):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = best.get(h or "")
        again = first is not None and first != i and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 11])
def test_archives_round_trip(spark, least):
    rows, df = pages(spark)
    index, target, captures = warc.archive(df, least)
    found = warc.lookup(index, captures.select("key"))
    assert sorted(map(str, found.collect())) == sorted(map(str, captures.select(found.columns).collect()))
    out = warc.read_records(found, target).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    assert got == reference(rows, least)
    html = {i: h or "" for i, _, h in rows if i is not None}
    assert all(r.payload == html[r.page_id] for r in out if r.record_type == "response" and r.page_id is not None)


def test_lookup_spans_blocks_and_shards(spark):
    rows = [(f"com,a)/{i % 3}", i, "x", i, 1) for i in range(500)] + [("com,b)/", 900, "x", 1, 1)]
    captures = spark.createDataFrame(rows, warc.CAPTURE).repartition(4)
    index = warc.write_index(captures, folder(spark, "index"), lines=7)
    assert len(index.shards) > 1
    asked = spark.createDataFrame([("com,a)/1",), ("com,b)/",), ("com,missing)/",), ("",), ("zz",), ("com,a)/1",)], "key string")
    got = sorted((r.key, r.page_id) for r in warc.lookup(index, asked).collect())
    assert got == sorted((k, i) for k, i, *_ in rows if k in ("com,a)/1", "com,b)/"))


def test_records_are_plain_gzip_members():
    digest = warc.sha1(b"abc")
    both = warc.record("response", 1, "http://a/", b"abc", 3, digest, None) + warc.record("revisit", 0, "http://a/", None, 3, digest, 1)
    raw = gzip.decompress(both)
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.endswith(b"\r\n\r\n") and raw.count(b"abc") == 1


@pytest.mark.parametrize("url,key", [
    ("http://www.Foo.example.com:80/A?b=1#c", "com,example,foo)/A?b=1"), ("https://u:p@foo.org:8443", "org,foo:8443)/"), (None, ""),
    ("http://[bad", "http://[bad"), ("mailto:x@y", "mailto:x@y"), ("http://a.b/ x\n", "b,a)/%20x%0A"),
])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_no_pages(spark):
    index, target, captures = warc.archive(spark.createDataFrame([], PAGES))
    assert captures.count() == 0 and warc.lookup(index, captures.select("key")).count() == 0


TEXTS = ["", " ", "  ", "a", " a", "a ", "  two  blanks ", "line\nbreak\n\n", "tab\tx", "日本語 🙂 é", "<s> </s> <unk> <0x0A>", "aaaa aaaaa    aa",
         "nul\x00x", "é", "x" * 3000, "Mixed CASE, punctuation... (yes)!", "▁mark▁er", "123456 7890.55"]


def test_parity_and_round_trip(spark):
    rows = list(enumerate(TEXTS)) + corpus()[:70] + [(None, "a b"), (3, "a")]
    checker = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    out = sentencepieces.encode(documents(spark, rows))
    got = by_id(out, "ids", "n_tokens", "parity", "round_trip")
    want = sorted(((i, checker.encode(t or ""), len(checker.encode(t or "")), True, "▁" not in (t or "")) for i, t in rows), key=str)
    assert got == want
    back = sentencepieces.decode(out)
    assert by_id(back, "text") == sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=str)
    assert sentencepieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()[0].text is None
    assert sentencepieces.encode(documents(spark, [])).collect() == []


def test_small_cache_and_many_texts():
    with open(sentencepieces.MODEL, "rb") as f:
        encoder = sentencepieces.Encoder(f.read(), cache=20)
    for part in (TEXTS, [t for _, t in corpus() if t], TEXTS[::-1]):
        flat, ends, same, _ = encoder.encode(part)
        starts = [0, *ends[:-1]]
        assert [flat[a:b].tolist() for a, b in zip(starts, ends)] == encoder.checker.encode(part) and all(same)


def test_ids_and_texts_are_those_of_the_rebuilt_tokenizer():
    """Where the checking library says otherwise, the ids stay and parity is false."""
    with open(sentencepieces.MODEL, "rb") as f:
        encoder = sentencepieces.Encoder(f.read())
    want = encoder.checker.encode(["one odd word", "same"])

    class Other:
        def encode(self, parts, num_threads):
            return [[7] if p == "odd" else ids for p, ids in zip(parts, own.encode(parts))]

        def __getattr__(self, name):
            return getattr(own, name)

    own, encoder.checker = encoder.checker, Other()
    flat, ends, same, back = encoder.encode(["one odd word", "same"])
    assert [flat[:ends[0]].tolist(), flat[ends[0]:].tolist()] == want
    assert same.tolist() == [False, True] and back.tolist() == [True, True]
    assert encoder.decode(want) == ["one odd word", "same"]


def message(*fields):
    """A protobuf message from (number, value) pairs."""
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in fields:
        if isinstance(v, float):
            out += number(k << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += number(k << 3) + number(v)
        else:
            v = v if isinstance(v, bytes) else v.encode()
            out += number(k << 3 | 2) + number(len(v)) + v
    return out


def test_unigram_model():
    """A small unigram model with byte fallback, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -4.0), ("b", -4.1), ("▁a", -3.5), ("ab", -3.2), ("▁ab", -5.0), ("ba", -3.3), ("aba", -6.9))]
    data = message(*[(1, message((1, p), (2, s), (3, k))) for p, s, k in pieces],
                   (2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2))), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    encoder = sentencepieces.Encoder(data)
    assert not encoder.model.bpe and encoder.model.byte_fallback
    rng = random.Random(1)
    batch = ["".join(rng.choice("aab b é") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    flat, ends, same, back = encoder.encode(batch)
    assert all(same) and all(back)
    assert [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == encoder.checker.encode(batch)
