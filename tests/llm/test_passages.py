"""Repeated passages are found wherever they stand, and whole lines of any place."""

import random

import corpus

from tillscope.llm import substring_dedup


def _words(rng, n):
    return " ".join(f"w{rng.getrandbits(40):x}" for _ in range(n))


def _after(spark, texts):
    kept = substring_dedup.remove_spans(corpus.documents(spark, list(enumerate(texts))))
    return [r["text"] for r in sorted(kept.collect(), key=lambda r: r["doc_id"])]


def test_a_passage_without_punctuation_is_found_mid_line(spark):
    rng = random.Random(1)
    passages = [_words(rng, 51) for _ in range(20)]
    texts = [f"{_words(rng, 30)} {p} {_words(rng, 30)}" for p in passages * 2]
    after = _after(spark, texts)
    assert after[:20] == texts[:20]
    assert all(len(t.split()) <= 111 - 25 for t in after[20:])


def test_no_run_of_fifty_words_is_left(spark):
    rng = random.Random(2)
    passages = [_words(rng, n) for n in (49, 50, 60, 75, 120, 121, 400)]
    texts = [f"{_words(rng, 30)}. {p}. {_words(rng, 30)}" for p in passages * 2]
    after = _after(spark, texts)
    assert after[:7] == texts[:7]
    for early, late in zip(after[:7], after[7:]):
        words, own = early.split(), late.split()
        runs = {tuple(words[n : n + 49]) for n in range(len(words))}
        assert not any(tuple(own[n : n + 49]) in runs for n in range(len(own) - 48))
        assert len(own) <= 60 + 2 * 23 + 2


def test_lines_and_paragraphs_shorter_than_a_block_are_units(spark):
    rng = random.Random(3)
    line, last = _words(rng, 22), _words(rng, 12)
    paragraph = f"{_words(rng, 9)}\n{_words(rng, 9)}"
    own = [[_words(rng, 40) for _ in range(3)] for _ in range(4)]
    texts = [f"{a}\n{line}\n{b}\n\n{paragraph}\n\n{c}\n{last}" for a, b, c in own]
    after = _after(spark, texts)
    assert after[0] == texts[0]
    for text, kept in zip(texts[1:], after[1:]):
        assert kept == text.replace(line, "").replace(paragraph, "").replace(last, "")
