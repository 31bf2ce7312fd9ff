"""The near-duplicate stage leaves one document of each component of close fingerprints."""

import random
import time

import corpus

from tillscope.llm import simhash
from tillscope.llm.components import connected_components
from tillscope.session import materialise


def _edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.getrandbits(40):x}"
    return words


def _check(spark, rows):
    """The kept ids are the least of the components over all pairs within 3 bits."""
    prints = [corpus.fingerprint(text, 3) for _, text in rows]
    least = {}
    for (doc_id, _), root in zip(rows, corpus.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)):
        rank = (doc_id is None, doc_id or 0)
        least[root] = min(least.get(root, rank), rank)
    kept = simhash.keep_representatives(corpus.documents(spark, rows), 3)
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert found == sorted(least.values())
    return len(rows) - len(least)


def test_chains_of_edited_copies_are_one_group(spark):
    rng = random.Random(4)
    texts = []
    for n in range(8):
        text = [f"c{n}_{k}" for k in range(1500)]
        for _ in range(8):
            texts.append(" ".join(text))
            text = _edited(rng, text, 4)
    rng.shuffle(texts)
    assert _check(spark, list(enumerate(texts))) >= 40


def test_nulls_repeated_rows_and_rows_without_id(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (5, "A b C d"), (None, "a b c d"), (None, "x y z"), (None, "x y z")]
    rows += [(7, None), (8, ""), (9, " \n"), (10, "one"), (10, "two other words here")]
    _check(spark, rows)
    kept = simhash.keep_representatives(corpus.documents(spark, rows), 3)
    assert kept.columns == corpus.documents(spark, rows).columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["doc"]) for r in kept.collect()) == [
        (0, "x y z", 1), (3, "a b c d", 1), (7, "", 1), (10, "one", 1), (10, "two other words here", 1),
    ]


def test_the_shared_corpus(spark):
    _check(spark, corpus.ROWS)


def _path(rng, n, at):
    nodes = list(range(at, at + n))
    rng.shuffle(nodes)
    return list(zip(nodes, nodes[1:]))


def test_components_of_checkpointed_unions_take_flat_rounds(spark):
    rng = random.Random(8)
    parts = [_path(rng, 64, at) for at in range(0, 1024, 128)]
    edges = None
    for part in parts:
        frame = materialise(spark.createDataFrame(part, "src long, dst long"))
        edges = frame if edges is None else materialise(edges.unionByName(frame))
    began = time.monotonic()
    found = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert time.monotonic() - began < 120
    assert found == {n: 128 * (n // 128) for part in parts for edge in part for n in edge}


def test_no_edges_give_no_components(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).isEmpty()
