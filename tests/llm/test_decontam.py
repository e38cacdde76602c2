import re

from quarrymill.llm.decontam import NAME, NUMBER, NUMBER_UNIT, UNIT, decontaminate, leaks, raw_words, template

SF = "/root/testdata/sf0.01"


def test_templates(spark):
    texts = ["On Monday John Smith bought 12 apples, and 3.5 kg of flour. It cost $45. He ran 5km in 10% time", "THE CAT. Sat, On 3 miles", None, "", "### 7 ###"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(template_col := template(__import__("pyspark").sql.functions.col("t")).alias("a"), raw_words(__import__("pyspark").sql.functions.col("t")).alias("b")).collect()
    assert template_col is not None
    assert got[0].a == ["on", NAME, NAME, NAME, "bought", NUMBER, "apples", "and", NUMBER, UNIT, "of", "flour", "it", "cost", NUMBER, "he", "ran", NUMBER_UNIT, "in", NUMBER, "time"]
    assert all(len(r.a) == len(r.b) for r in got)
    assert got[1].a == ["the", "cat", "sat", NAME, NUMBER, UNIT] and got[2].a == got[3].a == []


ITEM = "If Anna walks 12 miles in 3 hours while her friend Bob runs 12 miles then how fast is Anna going at the very end of this day"


def test_asked_again_with_other_values(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one item of exactly nine words right here ok"), (3, None), (4, "")], "item_id long, text string")
    swap = lambda t, **k: re.sub("|".join(k), lambda m: k[m[0]], t)
    docs = [
        (1, "x y. " + swap(ITEM, Anna="Peter", Bob="Carl") + " z"), (2, ITEM.replace("Bob runs 12 miles then how fast is Anna", "Bob runs 9 miles then how fast is Dave").replace("3 hours", "3 hours")),
        (3, "hm short one item, of exactly nine words: right here ok hm"), (4, None), (5, ""), (None, ITEM), (6, "nothing of the kind " * 20), (7, ITEM), (7, "another text"),
    ]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()}
    assert {(1, 1), (3, 2), (None, 1), (7, 1)} <= got and not {i for i, _ in got} & {4, 5, 6}
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id in (6, 7)) == [(6, docs[6][1]), (7, "another text")]
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench, chunk=3).collect()} == got


def test_values_must_agree(spark):
    item = "the train from Paris leaves 9 minutes after the one from Lyon and the bus from Paris needs longer"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("Paris", "Rome")), (2, "the train from Rome leaves 9 minutes after the one from Lyon and the bus from Turin needs longer")], "doc_id long, text string")
    assert {r.doc_id for r in leaks(docs, bench).collect()} == {1}


def test_plain_passages_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: [w for w in re.sub(r"[^\w\s]|_", "", t.lower()).split()]
    index = {}
    for b in bench.collect():
        w = words(b.text)
        for k in range(len(w) - 12):
            index.setdefault(tuple(w[k : k + 13]), set()).add(b.item_id)
    want = set()
    for d in docs.collect():
        w = words(d.text)
        for k in range(len(w) - 12):
            want |= {(d.doc_id, i) for i in index.get(tuple(w[k : k + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert want and want <= got and len(got - want) <= 1


def test_verbatim_copies_are_found_whatever_their_template(spark):
    items = ["add 12 34 56 kg 78 90 11 m and 13 14 15 16 17 18 20", "Which is the largest city of the whole country of France today", "Name three prime numbers", "Der Hund Sah Die Katze Im Garten Und Der Vogel Sang Laut Am Morgen"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Read this: {t}, he said." for t in items] + [items[0].replace("34", "35").replace("16", "19"), "Name three large numbers", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert got == {(k, k) for k in range(4)}
    assert {(r.doc_id, r.item_id) for r in leaks(docs, bench, chunk=3).collect()} == got


def test_equal_windows_count_where_values_elsewhere_disagree(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(50)]
    words[8:10], words[40:42] = ["12", "miles"], ["12", "miles"]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    words[40] = "15"
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = leaks(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_windows) for r in got] == [(1, 1, 28)]  # of 38, those without the word 40


def found(spark, items, texts, **options):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in leaks(docs, bench, **options).collect()}


def test_any_white_space_is_one_blank(spark):
    other = ITEM.replace("Anna", "Petra").replace("12 miles", "15 km")  # asked again, so that only templates find it
    texts = [t for x in (ITEM, other) for t in (x, "\n".join(x.split()), x.replace(" ", "  "), x.replace("while her", "while\n\n her").replace("3 hours", "3\thours"), re.sub(r" (?=[A-Z0-9])", "\r\n", x), re.sub(r" (?=miles|km|hours)", "  ", x))]
    assert found(spark, [ITEM], texts) == {(k, 0) for k in range(len(texts))}


def test_short_items_and_values_that_disagree_in_poor_windows(spark):
    items = ["Name seven rivers of the old world", "We put 12 red 7 blue 9 green 5 black 8 12 round ones and some other balls into the box"]
    texts = ["He said: Name seven rivers of the old world, please", items[1].replace("8 12", "8 4"), items[1].replace("12", "14")]
    assert found(spark, items, texts) == {(0, 0), (2, 1)}


def test_a_shared_window_does_not_multiply(spark):
    shared = "answer the following question by choosing exactly one of the options that are listed below it"
    items = [f"{shared} w{k}a w{k}b w{k}c" for k in range(30)]
    texts = [f"text {k} {shared} end" for k in range(30)] + [items[17]]
    got = found(spark, items, texts)
    assert got == {(k, 0) for k in range(31)} | {(30, 17)}
    assert found(spark, items, texts, chunk=0) == got  # joined by a shuffle


def test_windows_of_other_items_count_where_a_run_disagrees(spark):
    both = "a train leaves the town at {} and goes on to the next station"
    items = ["the count is 7 here " + both.format(7), "some other words before " + both.format(8)]
    assert found(spark, items, ["the count is 9 here " + both.format(8)]) == {(0, 1)}


def test_null_and_repeated_items(spark):
    bench = spark.createDataFrame([(None, ITEM), (3, ITEM), (2, ITEM), (9, None), (None, "some words that are an item without an id")], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (1, "x"), (None, "some words that are an item without an id")], "doc_id long, `text.x` string")
    assert sorted(((r.doc_id, r.item_id) for r in leaks(docs, bench, text_col="text.x").collect()), key=str) == [(1, 2), (None, None)]
    assert [tuple(r) for r in decontaminate(docs, bench, text_col="text.x").collect()] == [(1, "x")]
    assert [tuple(r) for r in decontaminate(docs, bench, text_col="text.x", broadcast_rows=0).collect()] == [(1, "x")]
