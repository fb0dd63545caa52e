"""Rules against counting by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import rules


def covered(words, n):
    seen, places = set(), set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in seen:
            places |= set(range(i, i + n))
        seen.add(gram)
    return sum(len(words[i]) for i in places)


def top(words, n):
    counts = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return max(((c, c * sum(map(len, g))) for g, c in counts.items() if c > 1), default=(0, 0))[1]


def expected(text):
    text = text or ""
    words = text.split()
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    chars, line_chars = sum(map(len, words)), sum(map(len, lines))
    share = lambda a, b: a / b if b else 0.0
    return {
        "words": len(words),
        "mean_word_chars": share(chars, len(words)),
        "symbols_per_word": share(text.count("#") + text.replace("...", "…").count("…"), len(words)),
        "bullet_lines": share(sum(x[0] in "•‣◦▪●*-" for x in lines), len(lines)),
        "ellipsis_lines": share(sum(x.endswith(("...", "…")) for x in lines), len(lines)),
        "alphabetic_words": share(sum(any(c.isalpha() for c in w) for w in words), len(words)),
        "stop_words": len({w.lower() for w in words} & set(rules.STOP_WORDS)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        "repeated_line_chars": share(line_chars - sum(map(len, set(lines))), line_chars),
        **{f"top_{n}gram_chars": share(top(words, n), chars) for n in rules.TOP_NGRAMS},
        **{f"repeated_{n}gram_chars": share(covered(words, n), chars) for n in rules.REPEATED_NGRAMS},
    }


RNG = random.Random(5)
TEXTS = [
    None, "", "   \n\n ", "one", "the the the the the the the", "a b a b a b a b a b a b a b", "* x\n- y\n• z\n-\nplain...\nmore…",
    "same line here\nsame line here \nsame line here\nother", "# # word ... …", "é ü 1 2 ! ß", "x y z w",
    " ".join(RNG.choice("abcd") for _ in range(300)), " ".join(RNG.choice(["aa", "b", "ccc"]) for _ in range(500)),
    " ".join(RNG.choice("abcdefgh") * RNG.randrange(1, 9) for _ in range(400)), "word " * 20000, "the quick fox and dog of ten " * 3 + "with that",
    "\n".join(f"line number {i % 7} of the text" for i in range(200)), "y" * 200000,
]


@pytest.fixture(scope="module")
def measured(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string").withColumn("n", F.lit("kept"))
    out = rules.measures(rows)
    assert out.columns[:3] == ["id", "text", "n"]
    return {r.id: r.asDict() for r in out.withColumn("failed", rules.failed_rules()).collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_text(measured, i):
    want = expected(TEXTS[i])
    got = {k: v for k, v in measured[i].items() if k in want}
    assert got == pytest.approx(want, abs=1e-12)
    broken = [k for k, (lo, hi) in rules.LIMITS.items() if (lo is not None and want[k] < lo) or (hi is not None and want[k] > hi)]
    assert measured[i]["failed"] == broken


def test_tagger_and_own_limits(spark):
    chunks = spark.createDataFrame([("1_0", "short"), ("1_1", None)], "chunk_id string, text string")
    got = {r.chunk_id: (r.attr_rules_failed, r.attr_rules_pass) for r in rules.tag_rules(chunks, {"words": (1, None)}).collect()}
    assert got == {"1_0": ([], True), "1_1": (["words"], False)}
    assert rules.tag_rules(chunks.limit(0)).collect() == []
