"""Operators with exact results against brute force or SQL, with nulls, empty texts, ties, repeats and empty tables."""

import random
import re

import duckdb
import numpy as np
import pytest

from corpusmill.llm import chat, decontaminate, jaccard, lines

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("part_words", [100_000, 60])
def test_decontaminate_as_sql(spark, part_words):
    # short items, a null and an empty one, equal items, an item within another, a repeated and a null document
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:15])), (2, "One two"), (3, None), (4, "..."), (5, " ".join(words[:15])), (6, " ".join(words[3:14])), (7, "solo"), (8, " ".join(words[10:30]))]
    docs = [(1, "x " + " ".join(words)), (2, "one, TWO! solo"), (3, None), (4, ""), (5, " ".join(words[4:13])), (6, " ".join(words[4:14]) * 2), (1, "x " + " ".join(words)), (None, "solo é1 two one two"), (8, "one two " * 5000)]
    r = random.Random(0)
    docs += [(100 + i, " ".join(r.choice(words + ["one", "two", "solo"]) for _ in range(40))) for i in range(40)]
    got = decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), part_words=part_words)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(con.execute(decontaminate.report_sql()).fetchall(), key=order)


def test_decontaminate_clean(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Some words before, {item.upper()}, and so many more words after it as to be kept", "a"), (2, item, "b"), (3, None, "c"), (4, "clean", "d")], DOCS + ", `TEXT2` string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.clean(docs, items).collect()}
    assert got == {1: "Some words before, , and so many more words after it as to be kept", 3: None, 4: "clean"}
    assert decontaminate.clean(docs.limit(0), items).count() == 0 == decontaminate.report(docs.limit(0), items.limit(0)).count()


def repeated(rows, least):
    """By comparing every run with every earlier place."""
    docs, out = [(i, [x for x in (t or "").split("\n") if x]) for i, t in sorted(rows)], {}
    for d, (i, own) in enumerate(docs):
        size, gone = [len(x.split(" ")) if x.strip() else 0 for x in own], set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if sum(size[a:b]) >= least:
                    run = own[a:b]
                    for e in range(d + 1):
                        other = docs[e][1]
                        ends = len(other) - len(run) + 1
                        if any(other[p : p + len(run)] == run for p in range(min(a, ends) if e == d else ends)):
                            gone.update(range(a, b))
                            break
        if gone:
            out[i] = sorted(gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lines_as_brute_force(spark, seed):
    r = random.Random(seed)
    some = ["a b c", "d e", "f", "g h i j k", "l m", "zz z", ""]
    rows = [(i, "\n".join(r.choice(some) for _ in range(r.randrange(0, 14)))) for i in range(25)] + [(90, None)]
    got = {x.key: x.removed for x in lines.repeated(spark.createDataFrame(rows, DOCS), least=6).collect()}
    assert got == repeated(rows, 6) and got


def test_lines_dedup(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"own\n{passage}\nend"), (2, f"{passage}\nother"), (3, passage), (3, passage), (4, None), (None, "x")]
    got = sorted((r.doc_id or 0, r.text) for r in lines.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, "x"), (1, rows[0][1]), (2, "other"), (3, ""), (3, ""), (4, None)]
    assert lines.dedup(spark.createDataFrame([], DOCS)).count() == 0


def links(rows):
    """All pairs of sets compared."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    n, up = dict.fromkeys(sets, 0), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and sets[a] and sets[b] and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), n[i], root(i)) for i in sets)


@pytest.mark.parametrize("bounds", [{}, {"tile_points": 8, "tile_shingles": 500, "driver_edges": 3}])
def test_jaccard_as_brute_force(spark, bounds):
    r = random.Random(1)
    base = [[r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(r.choice([1, 3, 5, 12, 40, 100, 300]))] for _ in range(10)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "X" + str(r.randrange(9))
            else:
                w = w[: r.randrange(max(1, len(w) - 8), len(w) + 1)]
        rows.append((i, " ".join(w) if r.random() > 0.04 else r.choice([None, "", " \n"])))
    docs = spark.createDataFrame(rows, DOCS)
    want = links(rows)
    assert sorted(map(tuple, jaccard.similar(docs, **bounds).collect())) == want
    if not bounds:
        assert sorted(x.doc_id for x in jaccard.keep_one(docs).collect()) == sorted({w[3] for w in want})
        assert jaccard.similar(docs.limit(0)).count() == 0


def test_chat_as_sql(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    extra = [(-1, 1, "user", None), (-1, 1, "user", None), (-1, 0, None, "\\"), (-1, None, "assistant", "###</turn>\\### a: "), (None, 0, "as:sis\\tant", "")]
    rows = chat.with_trap(rows).unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.register("c", rows.where("conv_id IS NULL OR conv_id <> -7").toArrow())
    con.execute("CREATE VIEW conversations AS SELECT * FROM c")
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, chat.digests(rows).collect()), key=order) == sorted(con.execute(chat.digests_sql()).fetchall(), key=order)


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "c", 9.0), (1, 5, 4, "assistant", "d", None), (2, 7, 99, "user", "orphan", 0.0), (3, 1, 2, "x", "circle", 0.0), (3, 2, 1, "x", "circle", 0.0)]
    done = chat.format_trees(spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double"), 2)
    got = {(r.conv_id, r.branch): [t for _, t in chat.read_back(r.formatted)] for r in done.collect()}
    assert got == {(1, 1): ["q", "a", "c", "d"], (1, 2): ["q", "b"], (2, 1): ["orphan"]}


def test_jaccard_parts_keep_similar_pairs():
    r = np.random.default_rng(0)
    for size in [*range(8, 60), 90, 143, 144, 320, 1000, 5000]:
        for _ in range(20):
            b = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            gone = int(r.integers(0, len(b) // 10 + 1))  # a subset of Jaccard 0.9 or more
            a = np.sort(r.permutation(b)[gone:])
            if gone > 1 and r.random() < 0.5:  # some replaced instead of dropped
                some = len(b) // 20
                a = np.unique(np.concatenate([r.permutation(b)[some:], r.integers(0, 1 << 63, some).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(jaccard.part_keys(a), jaccard.part_keys(b))), (len(a), len(b), both)


def test_jaccard_common_passages_share_no_part(spark):
    # every shingle stands in several texts, no two texts are similar: nothing is to be moved for the trees
    r = random.Random(2)
    pool = [" ".join(r.choice("abcdefghij") + str(r.randrange(900)) for _ in range(25)) for _ in range(120)]
    docs = spark.createDataFrame([(i, " ".join(r.sample(pool, 30))) for i in range(60)], DOCS)
    keys = jaccard._describe(docs, "doc_id", "text").selectExpr("explode(keys) AS k")
    shared = keys.groupBy("k").count().where("count > 1").agg({"count": "sum"}).head()[0] or 0
    assert shared <= 0.02 * keys.count()
