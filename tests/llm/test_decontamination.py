"""Templates, slots and the defined cases."""

import random
import re

from quillon.llm import decontamination as dc


def test_templates_catch_new_parameters(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(f"q{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    items = [
        (1, "If Anna buys 12 apples and gives 5 kg of them to Bruno, how many apples does Anna keep after 12 days?"),
        (2, "the small river bends twice before it reaches the old stone mill"),
        (3, "only three words"), (4, "no"), (5, None), (6, ""), (None, "an item that has no name at all here"),
    ]
    docs = [
        (1, f"{noise(30)} {items[0][1]} {noise(10)}", "x"),
        (2, f"{noise(9)}. If Clara buys 30 apples and gives 7 lb of them to David, how many apples does Clara keep after 30 days? {noise(4)}", "x"),
        (3, "If Clara buys 30 apples and gives 7 lb of them to David, how many apples does Emma keep after 99 days?", "x"),
        (4, f"{noise(5)} The small river bends twice before it reaches the old stone mill, {noise(5)}", "x"),
        (5, f"the small river bends {noise(40)}", "x"),
        (6, f"{noise(3)} only three words {noise(3)}", "x"),
        (7, None, "x"), (8, "", "x"), (9, noise(20000), "x"), (4, "another text", "x"), (None, items[1][1], "x"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in dc.matches(d, b).collect()}
    assert got == {(1, 1): False, (2, 1): True, (4, 2): False, (6, 3): False}
    kept = [r["doc_id"] for r in dc.matches(d, b.limit(0)).collect()]
    assert kept == [] and dc.matches(d.limit(0), b).count() == 0


def test_plain_passages_against_brute_force(spark):
    rng = random.Random(2)
    words = ["the", "of", "and", "thon", "erin", "anst", "blere", "tionou"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 40)))) for i in range(20)]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(80)]
        if i % 3 == 0:
            k = rng.randrange(len(w))
            w[k:k] = rng.choice(items)[1].split()
        docs.append((i, " ".join(w)))
    grams = lambda t: {tuple(x) for w in [re.findall(r"\w+", t)] for x in zip(*(w[k:] for k in range(5)), strict=False)}
    places = lambda t: [tuple(w[k : k + 5]) for w in [re.findall(r"\w+", t)] for k in range(len(w) - 4)]
    want = {(d, i) for d, t in docs for i, x in items if sum(p in grams(t) for p in places(x)) >= 0.8 * len(places(x))}
    out = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == want


def _found(spark, pairs):
    """Which documents hold the item of their own number."""
    noise = "zor vik lem dap."
    d = spark.createDataFrame([(i, f"{noise} {t} {noise}") for i, (_, t) in enumerate(pairs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "item_id long, text string")
    return [(r["doc_id"], r["coverage"]) for r in dc.matches(d, b).orderBy("doc_id").collect() if r["doc_id"] == r["item_id"]]


def test_items_full_of_numbers(spark):
    sums, rope = "What is 12 times 3 plus 5 minus 2?", "A rope of 12 m costs 3 dollars and 5 cents; 7 m cost 2 dollars. How much do 9 m cost?"
    pairs = [(t, t) for t in (sums, rope, "Solve 12 + 30", "12 30 44 51 67 80 92")]
    pairs += [(sums, "What is 41 times 6 plus 8 minus 7?"), (rope, "A rope of 15 m costs 4 dollars and 6 cents; 8 m cost 1 dollars. How much do 11 m cost?"), ("Solve 12 + 31", "Solve 13 + 37")]
    assert _found(spark, pairs) == [(i, 1.0) for i in range(6)]


def test_names_that_open_sentences(spark):
    has = "{} has {} apples. {} has {} apples. How many apples do they have in total?"
    buys = "{0} buys {1} apples for {2} dollars each. {3} buys {4} pears for {5} dollars each. How much more does {0} spend than {3}?"
    pairs = [(has.format("John", 5, "Mary", 3), has.format("Peter", 8, "Susan", 6)), (buys.format("John", 5, 2, "Mary", 3, 4), buys.format("Peter", 8, 7, "Susan", 6, 9))]
    assert _found(spark, pairs) == [(0, 1.0), (1, 1.0)]
