"""Quality and repetition rules as Columns, with the published thresholds (Rae et al., 2021).

Repetition is measured in characters of words.  A word counts as repeated for n when any
n-gram that covers it occurred before in the text; a word that several such n-grams cover counts once.  All of
it happens inside a row: n-grams are hashed and sorted with their places, equal neighbours give the places of
repeats, longer n-grams are formed only where shorter ones repeat, and the words between the last covered one and the next repeat's end are added up, so the work is that of a
sort, whatever the text repeats.  A null or empty text has no words: its shares are 0 and it fails ``words``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words, marks and thresholds of the published rules.
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with"]
BULLETS = "^[•‣◦▪●*-]"
TOP_NGRAMS = {2: 0.20, 3: 0.18, 4: 0.16}
REPEATED_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

# What a text must meet: least and most of each measure.
LIMITS: dict[str, tuple[float | None, float | None]] = {
    "words": (50, 100_000),
    "mean_word_chars": (3, 10),
    "symbols_per_word": (None, 0.1),
    "bullet_lines": (None, 0.9),
    "ellipsis_lines": (None, 0.3),
    "alphabetic_words": (0.8, None),
    "stop_words": (2, None),
    "repeated_lines": (None, 0.3),
    "repeated_line_chars": (None, 0.2),
    **{f"top_{n}gram_chars": (None, most) for n, most in TOP_NGRAMS.items()},
    **{f"repeated_{n}gram_chars": (None, most) for n, most in REPEATED_NGRAMS.items()},
}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _chars(texts: Column) -> Column:
    return F.length(F.array_join(texts, ""))


# Elements are read by place below, never by slices: inside a function over elements a slice copies the whole array.


def _ngrams(hashes: Column, places: Column, n: int) -> Column:
    """(hash, place) of the n-grams at ``places``, sorted; places too near the end have none."""
    whole = F.filter(places, lambda i: i <= F.size(hashes) - n)
    return F.sort_array(
        F.transform(whole, lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]).alias("h"), i.alias("i")))
    )


def _shared(ngrams: Column) -> Column:
    """Places of n-grams that occur more than once: only there can a longer one do so."""
    equal = lambda g, k: F.coalesce(F.get(ngrams, k)["h"] == g["h"], F.lit(False))
    return F.filter(F.transform(ngrams, lambda g, k: F.when(equal(g, k - 1) | equal(g, k + 1), g["i"])), lambda i: i.isNotNull())


def _repeats(ngrams: Column) -> Column:
    """Places of n-grams that occurred before, ascending."""
    marked = F.transform(ngrams, lambda g, k: F.when((k > 0) & (F.get(ngrams, k - 1)["h"] == g["h"]), g["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _covered_chars(places: Column, lengths: Column, n: int) -> Column:
    """Characters of the words that the n-grams at ascending ``places`` cover, each once."""

    def fresh(at: Column, k: Column) -> Column:
        done = F.coalesce(F.get(places, k - 1) + n, F.lit(0))
        return _sum([F.when(at + j >= done, F.get(lengths, at + j)).otherwise(0) for j in range(n)])

    return F.aggregate(F.transform(places, fresh), F.lit(0), lambda total, x: total + x)


def _top_chars(ngrams: Column, lengths: Column, n: int) -> Column:
    """Characters of the most frequent n-gram times its count; of equally frequent ones the longest; 0 if none repeats."""
    none = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("run"), F.lit(1).alias("most"), F.lit(0).alias("chars"))

    def step(seen: Column, g: Column) -> Column:
        run = F.when((seen["run"] > 0) & (seen["h"] == g["h"]), seen["run"] + 1).otherwise(F.lit(1))
        chars = _sum([F.get(lengths, g["i"] + j) for j in range(n)])
        longest = F.when((run == 1) | (run < seen["most"]), seen["chars"]).when(run > seen["most"], chars).otherwise(F.greatest(seen["chars"], chars))
        return F.struct(g["h"].alias("h"), run.alias("run"), F.greatest(run, seen["most"]).alias("most"), longest.alias("chars"))

    return F.aggregate(ngrams, none, step, lambda seen: seen["most"] * seen["chars"])


def measures(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with one column for each measure of ``LIMITS``; names beginning with ``_`` must be free."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = rows.withColumns(
        {
            "_words": F.regexp_extract_all(whole, F.lit(r"(?U)\S+"), F.lit(0)),
            "_lines": F.filter(F.transform(F.split(whole, "\n"), lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")), lambda x: x != ""),
        }
    )
    words, lines = F.col("_words"), F.col("_lines")
    # In columns of their own: inside a function over elements an expression would be computed for each of them.
    hashed = split.withColumns(
        {"_hashes": F.transform(words, lambda w: F.xxhash64(w)), "_lengths": F.transform(words, F.length), "_n": F.size(words), "_chars": _chars(words), "_line_chars": _chars(lines)}
    )
    grams, places = hashed, F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>"))
    for size in sorted({*TOP_NGRAMS, *REPEATED_NGRAMS}):
        grams = grams.withColumn(f"_grams{size}", _ngrams(F.col("_hashes"), places, size))
        grams = grams.withColumn(f"_shared{size}", _shared(F.col(f"_grams{size}")))
        places = F.col(f"_shared{size}")
    repeats = grams.withColumns({f"_again{n}": _repeats(F.col(f"_grams{n}")) for n in REPEATED_NGRAMS})
    n, chars = F.col("_n"), F.col("_chars")

    def counted(values: Column, test) -> Column:
        return F.size(F.filter(values, test))

    stops = F.array_intersect(F.transform(words, lambda w: F.lower(w)), F.array(*[F.lit(w) for w in STOP_WORDS]))
    symbols = F.regexp_count(whole, F.lit(r"#|\.\.\.|…"))
    made = {
        "words": n.cast("long"),
        "mean_word_chars": _share(chars, n),
        "symbols_per_word": _share(symbols, n),
        "bullet_lines": _share(counted(lines, lambda x: x.rlike(BULLETS)), F.size(lines)),
        "ellipsis_lines": _share(counted(lines, lambda x: x.endswith("...") | x.endswith("…")), F.size(lines)),
        "alphabetic_words": _share(counted(words, lambda w: w.rlike(r"\p{L}")), n),
        "stop_words": F.size(stops).cast("long"),
        "repeated_lines": _share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "repeated_line_chars": _share(F.col("_line_chars") - _chars(F.array_distinct(lines)), F.col("_line_chars")),
        **{f"top_{k}gram_chars": _share(_top_chars(F.col(f"_grams{k}"), F.col("_lengths"), k), chars) for k in TOP_NGRAMS},
        **{f"repeated_{k}gram_chars": _share(_covered_chars(F.col(f"_again{k}"), F.col("_lengths"), k), chars) for k in REPEATED_NGRAMS},
    }
    return repeats.select(*[f"`{c}`" for c in rows.columns], *[c.alias(name) for name, c in made.items()])


def failed_rules(limits: dict[str, tuple[float | None, float | None]] = LIMITS) -> Column:
    """Names of the limits that a measured row does not keep, in their order."""
    broken = []
    for name, (least, most) in limits.items():
        out = F.lit(False)
        if least is not None:
            out = out | (F.col(name) < least)
        if most is not None:
            out = out | (F.col(name) > most)
        broken.append(F.when(out, F.lit(name)))
    return F.array_compact(F.array(*broken))


def tag_rules(chunks: DataFrame, limits: dict[str, tuple[float | None, float | None]] = LIMITS) -> DataFrame:
    """(chunk_id, attr_rules_failed, attr_rules_pass)."""
    judged = measures(chunks.select("chunk_id", "text")).withColumn("attr_rules_failed", failed_rules(limits))
    return judged.select("chunk_id", "attr_rules_failed", (F.size("attr_rules_failed") == 0).alias("attr_rules_pass"))
