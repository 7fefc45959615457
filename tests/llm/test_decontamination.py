import hashlib
import random

from weftline.llm import decontamination as D


def slow_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def slow_report(text, items):
    words, hit, found = slow_words(text), set(), set()
    for item, t in items:
        w = slow_words(t)
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(item)
    ids = sorted(str(x) for x in found)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def cases():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "x9", "A-B"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for i in range(25)] + [(100, None), (101, ""), (3, say(14)), (102, "?!")]
    docs = [(i, say(rnd.randrange(0, 120))) for i in range(60)]
    docs += [(200, None), (201, ""), (202, items[4][1].upper()), (203, "z " * 3000 + (items[-2][1] or "") + ", end"), (203, "repeat"), (None, items[-2][1])]
    docs += [(300 + i, f"before-it {t}; after") for i, (_, t) in enumerate(items) if t]
    return docs, items


def test_report_equals_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, hit_spans2 string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (D.BLOCK_WORDS, 20):
        report = D.find_contamination(d.select("doc_id", "text"), b, block_words=block_words).mapInArrow(D._report, D.RESULT)
        got = sorted(tuple(r) for r in report.na.fill(-1, ["doc_id"]).collect())
        want = sorted((-1 if i is None else i, *slow_report(t, items)) for i, t in docs)
        assert got == want


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.contamination_report(d, b).collect()] == [False]
    assert D.contamination_report(d.limit(0), b).collect() == []


def test_removal_keeps_the_rest(spark):
    item = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, f"Keep this, {item.upper()}! And this."), (2, "clean text stays as it is"), (3, None), (4, item)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.remove_contamination(d, b).collect()}
    assert got == {1: "Keep this, ! And this.", 2: "clean text stays as it is", 3: None, 4: ""}
    assert {r.doc_id for r in D.remove_contamination(d, b, max_share=0.5).collect()} == {2, 3}


def test_search_skips_blocks():
    table = D.WuManber({tuple(b"%d" % i for i in range(10)): [1]}, 10)
    assert table.shift[b"7", b"8", b"9"] == 0 and table.shift[b"0", b"1", b"2"] == 7
    assert list(table.find([b"x"] * 5 + [b"%d" % i for i in range(10)] + [b"y"])) == [(5, [1])]


def test_columns_of_the_result_are_replaced(spark):
    docs = spark.createDataFrame([(1, "one two three", "x", 5)], "doc_id long, text string, hit_spans string, hit_items long")
    items = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    got = D.find_contamination(docs, items).collect()
    assert [(r.hit_spans, r.hit_items) for r in got] == [([1, 3], ["7"])]


def test_blocks_are_bounded_and_long_items_lose_no_window(spark, monkeypatch):
    words = [f"v{i}" for i in range(137)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "v5 v6"), (3, None)], "item_id long, text string")
    blocks = D.benchmark_blocks(items, block_words=20)
    assert blocks.df.count() >= 7
    docs = [(i, " ".join(words[i : i + 10])) for i in range(128)] + [(500, " ".join(words[i] for i in range(0, 137, 2)))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for group in (1, D.GROUP_BYTES):  # one group of documents after another, or all at once
        monkeypatch.setattr(D, "GROUP_BYTES", group)
        got = {r.doc_id: r for r in D.find_contamination(d, items, block_words=20).collect()}
        assert all(got[i].hit_spans == [0, 10] for i in range(128)) and got[500].hit_spans is None
        assert got[5].hit_items == ["1", "2"] and got[6].hit_items == ["1"]
