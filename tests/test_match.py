"""The matcher: counts against the whole pool, and pairs made after both sides' evidence."""

from quillon.operators import match
from quillon.operators.retrieve import jaccard


def _tables(spark):
    texts = {1: "a b c", 2: "A b", 3: None, 4: "", 5: "x y", 6: "a b c", 7: "c c d e f g"}
    anchors = spark.createDataFrame([*texts.items(), (1, "b d"), (None, "a x")], "anchor bigint, text string")
    pool = spark.createDataFrame([(d + 10, "en" if d % 2 else "fr", str(d), t) for d, t in texts.items()] + [(20, "KR", "1", "a"), (21, None, "2", "d e x")], "chunk_id bigint, country string, number string, text string")
    kinds = "id bigint, article_ids array<string>, concept_keys array<string>, concept_names array<string>, compare_targets array<string>, neighbours array<string>"
    known = spark.createDataFrame([(1, ["d:1:2"], ["p", "q"], ["P"], ["d:12:1"], ["d:11:1"]), (11, ["d:11:1"], ["q"], [], [], []), (12, ["d:12:1"], ["p", "q"], ["P"], [], [])], kinds)
    return anchors, pool, known


def test_graph_match_counts_as_pairs_do(spark):
    """Null, empty and repeated texts, repeated and null anchors: the same rows as with a score made pair by pair."""
    anchors, pool, known = _tables(spark)
    for limit in (1, 3, 80):
        fast, slow = (match.graph_match(anchors, pool, known, limit=limit, **kw) for kw in ({}, {"pair_score": lambda a, b: jaccard(a, b)}))
        assert fast.columns == slow.columns
        rows = [sorted(map(str, x.collect())) for x in (fast, slow)]
        assert rows[0] == rows[1] and rows[0]
    assert match.graph_match(anchors, pool.where("false"), known).count() == 0


def test_pairs_are_made_where_they_are_ranked(spark):
    """Pairs are not dealt by chunk, of which there are few: the evidence is joined to each side before they meet."""
    anchors, pool, known = _tables(spark)
    plan = match.graph_match(anchors, pool, known)._jdf.queryExecution().optimizedPlan().toString()
    assert next(x for x in plan.split("\n") if "Join " in x).split("Join ")[1].startswith("Inner")
    assert plan.count("array_intersect") == 2  # of the evidence only
