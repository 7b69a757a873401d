import duckdb
import random
import re

from conftest import SF
from brute import lower
from tallyspark.llm import decontaminate, queries

TOKEN = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(rows, items, size=10):
    wins = {}
    for item, text in items:
        w = re.findall(TOKEN, lower(text))
        for k in range(max(len(w) - size + 1, min(1, len(w)))):
            wins.setdefault(tuple(w[k: k + size]), set()).add(item)
    lengths, out = {len(x) for x in wins}, []
    for i, text in rows:
        w = re.findall(TOKEN, lower(text))
        hit, ids = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[k: k + n]))) is not None:
                    hit.update(range(k, k + n))
                    ids |= {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "one, TWO three"), (2, "Three four"), (2, "five"), (None, "ab"), (3, None), (4, " !? "), (5, "ab"),
         (6, "a b c d e f g h i j k l"), (7, "é"), (11, "one two three")]


def test_same_as_brute_force(spark, table, texts):
    given = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [*texts, (1_000_000, given[0][1] + " tail " + given[1][1]), (1_000_001, "x a b c d e f g h i j k l y"), (1_000_002, "a b c d e f g h i k")]
    items = spark.createDataFrame(given + ITEMS, "item_id long, text string")
    want = brute(rows, given + ITEMS)
    for block in (decontaminate.BLOCK, 2000):
        keep = ("doc_id",) if block == decontaminate.BLOCK else ("doc_id", "text")
        found = decontaminate.report(table(rows), items, keep, block=block)
        got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()], key=str)
        if block != decontaminate.BLOCK:  # several blocks meet by id and text: equal rows are one
            got, expected = sorted({str(x) for x in got}), sorted({str(x) for x in want})
        else:
            expected = want
        assert got == expected


def test_several_blocks_judge_row_by_row(spark, table):
    """Null ids, repeated ids and equal rows stay rows of their own, and hits of different texts stay apart."""
    rows = [(None, "one two three"), (None, "no words of it"), (None, "three four x ab"), (None, None), (8, "three four"),
            (8, "one two three four five"), (8, "x"), (9, "a b c d e f g h i j k l"), (9, "a b c d e f g h i j k l"), (10, "")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert len(decontaminate.scan(table(rows), items, block=12)) > 3
    for block in (decontaminate.BLOCK, 12):
        found = decontaminate.report(table(rows), items, block=block)
        got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()], key=str)
        assert got == brute(rows, ITEMS)
    columns = ("doc_id", "text", "_text")
    assert decontaminate.report(table(rows), items, columns, block=12).columns[:3] == list(columns)
    assert decontaminate.report(table(rows), items, ("text", "lang"), block=12).count() == len(rows)


def test_blocks_bound_the_automaton(spark, table):
    """A generated benchmark beyond the limit, one item of it longer than a block: all windows, in automata that are bounded."""
    draw = random.Random(7)
    prose = lambda n: " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(n))
    given = [(k, prose(draw.randint(1, 40))) for k in range(30)] + [(99, prose(900)), (100, "a " * 300), (None, prose(20))]
    given += [(k, given[0][1]) for k in range(200, 260)]  # one text, many ids
    items = spark.createDataFrame(given, "item_id long, text string")
    whole = {w for _, t in given for w in decontaminate.windows(t.encode(), 10)}
    limit = sum(map(len, whole)) // 8
    found = list(decontaminate.blocks(items, "item_id", "text", 10, limit))
    assert len(found) >= 8
    for block in found:
        runs = {w for _, t in block for w in decontaminate.windows(t, 10)}
        nodes = decontaminate._Scanner(block, 10).automaton.get_stats()["nodes_count"]
        assert sum(map(len, runs)) <= limit and nodes <= limit + 1
    pairs = lambda rows: {(None if i is None else str(i), w) for i, t in rows for w in decontaminate.windows(t, 10)}
    assert set().union(*map(pairs, found)) == pairs([(i, t.encode()) for i, t in given])
    long = given[30][1]
    rows = [(1, long), (1, long[100:5000]), (None, given[3][1] + " . " + given[4][1]), (2, prose(50)), (3, "a " * 50), (4, given[0][1])]
    got = decontaminate.report(table(rows), items, block=limit).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, given)


def test_offsets_lead_to_the_original(spark, table):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    text = "Zéro -- ONE,\n\ttwo... (Three)! and one two three"
    found = decontaminate.scan(table([(1, text)]), items)[0].first()
    body = text.encode()
    assert [body[s.begin: s.end] for s in found.bytes_hit] == [b"ONE,\n\ttwo... (Three", b"one two three"]


def test_empty_tables(spark, table, texts):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.report(table(), items).collect()} == {False}
    assert decontaminate.report(table([]), items).count() == 0


def test_sql_of_the_query(spark, table):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    frame = queries.QUERIES["op7_benchmark_passages"](spark, SF)
    names = sorted(frame.columns)
    want = con.execute(f"select {', '.join(names)} from ({queries.SQL['op7_benchmark_passages']})").fetchall()
    assert sorted(map(tuple, frame.select(*names).collect()), key=str) == sorted(want, key=str)
