import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from weftline.llm import token_scan as S

PATH = P.path("word_bpe_49k.json")


def slow(stream, sep):
    out, start = [], 0
    for i, x in enumerate(stream):
        if x == sep:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(stream):
        out.append((len(out), start, len(stream) - start, False))
    return out


def blocks_of(spark, streams, size):
    rows = [(f, k, np.array(s[i : i + size], "<u2").tobytes()) for f, s in streams.items() for k, i in enumerate(range(0, len(s), size))]
    return spark.createDataFrame([(f, k, bytearray(b)) for f, k, b in rows], S.BLOCKS).repartition(3)


def test_scan_equals_a_plain_loop(spark):
    rnd = random.Random(1)
    streams = {1: [9] * 7, 2: [1, 2, 3], 3: [9], 5: [1] * 40 + [9] + [2] * 33, 8: [], 4: [rnd.choice([1, 2, 3, 9]) for _ in range(200)]}
    streams[6] = [rnd.choice([1] * 30 + [9]) for _ in range(500)]
    for size, run in ((4, 3), (7, 2), (1000, 4096)):
        got = S.count_tokens(blocks_of(spark, streams, size), separator=9, run=run).collect()
        want = {(f, *r) for f, s in streams.items() for r in slow(s, 9)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_documents_round_trip(spark):
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choice(["the", "lorem", "ipsum,"]) for _ in range(rnd.randrange(0, 300))) for i in range(120)} | {500: None, 501: "", 502: "a <|endoftext|> b", 503: "x " * 70_000}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, "null id", 1), (500, "twice", 1)], "doc_id long, text string, file_id int").repartition(4)
    got = S.document_token_counts(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    want = sorted([n(x) for x in texts.values()] + [n("null id"), n("twice")])
    assert sorted(r.n_tokens for r in got) == want
    assert all(r.n_tokens == n(texts[r.doc_id]) for r in got if r.doc_id not in (None, 500))
    assert S.document_token_counts(df.limit(0), PATH).collect() == []


def test_raw_files(spark, tmp_path):
    streams = [[1, 2, 9, 3, 9], [9, 9, 4]]
    for i, s in enumerate(streams):
        (tmp_path / f"{i}.bin").write_bytes(np.array(s, "<u4").tobytes())
    got = S.count_tokens(S.read_token_files(spark, str(tmp_path), 4, 2), separator=9, width=4).collect()
    assert sorted((r.doc_index, r.start_token, r.n_tokens, r.terminated) for r in got) == sorted(x for s in streams for x in slow(s, 9))


def test_large_files_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RANGE_BLOCKS", 3)
    rnd = random.Random(3)
    streams = [[rnd.choice([1, 2, 3, 9]) for _ in range(n)] for n in (0, 3, 50, 48, 401)]
    for i, s in enumerate(streams):
        (tmp_path / f"{i}.bin").write_bytes(np.array(s, "<u2").tobytes())
    whole, ranges = (S.read_token_files(spark, str(tmp_path), 2, 4, whole_bytes=n) for n in (1 << 20, 8))
    rows = lambda df: sorted((r.file_id, r.block, bytes(r.ids)) for r in df.collect())
    assert rows(ranges) == rows(whole)
    got = S.count_tokens(ranges, separator=9).collect()
    assert sorted((r.doc_index, r.start_token, r.n_tokens, r.terminated) for r in got) == sorted(x for s in streams for x in slow(s, 9))
