import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.packing import fill, pack_documents
from weftline.llm.tokens import encoder

PATH = P.path("word_bpe_49k.json")
HARD = [
    "", "   ", "a<|endoftext|>B  x", "Straße ÉCOLE's don't İstanbul ΣΑΣ ﬁ ² ½ x²y ª", "\x1c \x85a\xa0b", "emoji 😀 日本語 テスト", "1234 12,5 ... --'s !!'ll", "Á é Å", "ÀÉÎ ÿ µ __init__ a_b\t\r\n\x0b\x0cc",
    "x" * 5000, "the " * 3000, "<|STARTOFTEXT|>", "I'LL 'Sam' ''s", "퟿",
]


def whole(texts, plain=False):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ids(texts, plain=False, cache=50):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder(PATH, cache, plain)(texts)]


def test_encoder_equals_tokenizer():
    assert ids(HARD) == whole(HARD)
    assert ids(HARD, True) == whole(HARD, True)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F, blacklist_categories=["Cs"]), st.sampled_from("abcdefghijklmnopqrst   ,.'")), max_size=60))
def test_encoder_equals_tokenizer_on_latin(text):
    assert ids([text]) == whole([text])


def test_vocabulary_words_and_random_words():
    rnd = random.Random(5)
    parts = ["th", "tion", "er", "an", "ouch", "heit", "lich", "ción", "ñas", "é", "bb", "zq", "x", "ing"]
    words = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 7))) for _ in range(20_000)]
    words += [w.replace("</w>", "") for w in Tokenizer.from_file(PATH).get_vocab() if w.isascii()]
    assert ids(words, cache=100_000) == whole(words)


def brute(counts, capacity):
    items = [k for k, n in counts.items() for _ in range(n)]
    first = max(items)
    items.remove(first)
    sums = {first}
    for x in items:
        sums |= {s + x for s in sums if s + x <= capacity}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8))
def test_fill_is_the_best_multiset(counts):
    used = fill(counts, 40)
    assert all(used[k] <= counts[k] for k in used)
    assert max(counts) in used
    assert sum(k * n for k, n in used.items()) == brute(counts, 40)


def check_pieces(rows, texts, capacity=4096):
    want = {d: np.array([*x, 2], "<u4") for d, x in zip(texts, whole([t or "" for t in texts.values()]), strict=True)}
    seen, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        x = want[r.doc_id]
        assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seen[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, x in want.items():
        at = 0
        for s, n in sorted(seen[d]):
            assert s == at
            at += n
        assert at == len(x)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), sum(len(x) for x in want.values())


def test_pack_documents(spark):
    rnd = random.Random(2)
    texts = {i: " ".join(rnd.choice(["the", "tion", "lorem", "x,"]) for _ in range(rnd.choice([0, 1, 5, 50, 300, 1500, 9000]))) for i in range(400)}
    texts[7] = None
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, length string").repartition(3)
    rows = pack_documents(df, PATH).collect()
    n, total = check_pieces(rows, texts)
    assert n <= total / 4096 * 4096 / 4080 + 3  # one window of each of three partitions is left unfilled
    # the pool's bound changes windows, not pieces
    small = pack_documents(df, PATH, pool=30).collect()
    check_pieces(small, texts)


def test_pack_repeated_rows_and_empty(spark):
    schema = "doc_id long, text string"
    rows = pack_documents(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, ""), (1, "")], schema).coalesce(1), PATH).collect()
    assert len(rows) == 4 and sorted(r.length for r in rows) == [1, 1, 3, 3]
    assert pack_documents(spark.createDataFrame([], schema), PATH).collect() == []
