"""Language identification by hyperdimensional profiles.

Each letter (and the gap between words) has a random vector of +1 and -1.  An n-gram's
vector binds its letters: their vectors, permuted by place, multiplied.  A
text's vector bundles (adds) those of its n-grams, a language's prototype
those of its training texts; a text gets the language whose prototype has the
largest cosine with it.

Training counts the n-grams of each language within tasks and bundles there, so only one
vector per language and task is shuffled.  Prototypes are as many as languages,
at most ``MAX_LANGUAGES`` (more is an error), and go to the tasks with the function.

Memory does not grow with texts or batches: at most ``ROWS`` texts, or ``SLICE`` characters of
one long text with the last letters before them, are bundled at a time, and n-grams are
counted and bound in blocks of ``BLOCK``.

Null texts and texts without a letter are ``und`` with score 0, as is everything if
nothing was learned.  Rows with null language teach nothing.  Ties go to the
smaller language name.  Texts of any length are read whole.  Repeated rows teach and are
answered as often as they occur.  An empty table gives no prototypes and no answers.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from chunkloom.llm.common import byte_slices

DIMENSIONS = 1024
GRAM = 3
SEED = 20
MAX_LANGUAGES = 4096
# Characters of text, and texts, whose n-grams are handled at a time.
SLICE = 1 << 18
ROWS = 128
# N-grams whose vectors are held at a time.
BLOCK = 2048
UNKNOWN = "und"


class Letters:
    """Turns texts into n-gram counts, and n-grams into vectors."""

    def __init__(self):
        import numpy as np

        self.table = np.full(0x110000, -1, np.int32)
        self.vectors: dict[int, object] = {}

    def vector(self, symbol: int):
        import numpy as np

        if symbol not in self.vectors:
            self.vectors[symbol] = np.random.default_rng([SEED, symbol]).choice(np.array([-1, 1], np.int8), DIMENSIONS)
        return self.vectors[symbol]

    def symbols(self, codes):
        """Letters by their lower case; everything else is a gap (0)."""
        import numpy as np

        found = self.table[codes]
        if (found < 0).any():
            for code in np.unique(codes[found < 0]):
                c = chr(code)
                self.table[code] = ord(c.lower()[0]) if c.isalpha() else 0
            found = self.table[codes]
        return found

    def pieces(self, texts: list[str], size: int | None = None) -> Iterator:
        """The texts as runs of symbols: (symbols, the text of each), in pieces of bounded size.

        A gap stands at both ends of a text and once for each run of gaps.  A text beyond
        ``size`` has pieces of its own; each begins with the last symbols of the one before."""
        import numpy as np

        size = size or SLICE
        for a, b in byte_slices([max(len(t), SLICE // ROWS) for t in texts], size):
            if b - a > 1 or len(texts[a]) <= size:
                encoded = [f" {t} ".encode("utf-32-le", "surrogatepass") for t in texts[a:b]]
                sizes = np.array([len(e) // 4 for e in encoded])
                yield self.spaced(self.symbols(np.frombuffer(b"".join(encoded), "<u4")), np.repeat(np.arange(a, b), sizes))
                continue
            last = np.zeros(1, np.int32)
            for start in range(0, len(texts[a]) + 1, size):
                part = texts[a][start : start + size] + (" " if start + size > len(texts[a]) else "")
                found = self.symbols(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"))
                symbols = np.concatenate([last, found])
                symbols, rows = self.spaced(symbols, np.full(len(symbols), a))
                yield symbols, rows
                last = symbols[1 - GRAM :]

    @staticmethod
    def spaced(symbols, rows):
        """Without the gaps that follow a gap of the same text."""
        import numpy as np

        keep = (symbols != 0) | np.append(True, (symbols[:-1] != 0) | (rows[1:] != rows[:-1]))
        return symbols[keep], rows[keep]

    def grams(self, symbols, rows):
        """(row, gram number) of every n-gram of the symbols, and the grams as symbols."""
        import numpy as np

        n = max(0, len(symbols) - GRAM + 1)
        known, small = np.unique(symbols, return_inverse=True)
        code = np.zeros(n, np.int64)
        for i in range(GRAM):
            code = code * len(known) + small[i : n + i]
        inside = rows[:n] == rows[GRAM - 1 :] if n else np.zeros(0, bool)
        codes, number = np.unique(code[inside], return_inverse=True)
        places = [codes // len(known) ** (GRAM - 1 - i) % len(known) for i in range(GRAM)]
        return rows[:n][inside], number, np.stack([known[p] for p in places], axis=1) if n else np.zeros((0, GRAM), np.int32)

    def bind(self, grams):
        """The vectors of n-grams given as symbols."""
        import numpy as np

        out = np.ones((len(grams), DIMENSIONS), np.int8)
        for place in range(GRAM):
            known, number = np.unique(grams[:, place], return_inverse=True)
            out *= np.stack([np.roll(self.vector(int(s)), GRAM - 1 - place) for s in known])[number]
        return out

    def bundle(self, rows, number, grams, n: int):
        """The sum of the vectors of each of ``n`` rows' n-grams; counts are dense for one block of n-grams at a time."""
        import numpy as np

        out = np.zeros((n, DIMENSIONS))
        order = np.argsort(number, kind="stable") if len(grams) > BLOCK else np.arange(len(number))
        rows, number = rows[order], number[order]
        for a in range(0, len(grams), BLOCK):
            block = grams[a : a + BLOCK]
            i, j = np.searchsorted(number, [a, a + BLOCK]) if len(grams) > BLOCK else (0, len(number))
            counts = np.bincount(rows[i:j] * len(block) + number[i:j] - a, minlength=n * len(block))
            out += counts.reshape(n, len(block)).astype(np.float32) @ self.bind(block).astype(np.float32)
        return out

    def bundles(self, texts: list[str]) -> Iterator:
        """(first text, vectors of it and the next ones) over all texts; zero for a text without a letter.

        The pieces of a long text come one by one, to be added."""
        for symbols, rows in self.pieces(texts):
            first, last = int(rows[0]), int(rows[-1])
            yield first, self.bundle(*self.grams(symbols, rows - first), last - first + 1)


def _bundle_by_language(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    letters, sums = Letters(), {}
    for batch in batches:
        languages = np.array(batch.column("lang").to_pylist(), dtype=object).astype(str)
        for symbols, rows in letters.pieces(batch.column("text").to_pylist(), SLICE * 4):
            names, which = np.unique(languages[rows[0] : rows[-1] + 1], return_inverse=True)
            # No n-gram spans two texts, but those of a language are counted together.
            row, number, grams = letters.grams(symbols, rows)
            vectors = letters.bundle(which[row - rows[0]], number, grams, len(names))
            for name, vector in zip(names, vectors):
                sums[name] = sums.get(name, 0) + vector
    for name, vector in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS), pa.int32()), pa.array(vector)],
            ["lang", "i", "x"],
        )


def learn(texts: DataFrame, lang_column: str = "lang", text_column: str = "text") -> dict:
    """Language -> prototype of length one."""
    import numpy as np

    rows = texts.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    sums = rows.mapInArrow(_bundle_by_language, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    limit = (MAX_LANGUAGES + 1) * DIMENSIONS
    found = sums.limit(limit).toPandas()
    if len(found) == limit:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    prototypes = {}
    for name, part in found.sort_values(["lang", "i"]).groupby("lang"):
        vector = part["x"].to_numpy()
        norm = np.linalg.norm(vector)
        if norm > 0:
            prototypes[name] = vector / norm
    return prototypes


def predictor(prototypes: dict):
    """A function of a text column: struct of lang_pred and score (the cosine, 0 at least)."""

    @F.pandas_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        letters, names = Letters(), np.array(sorted(prototypes) or [UNKNOWN], dtype=object)
        matrix = np.stack([prototypes.get(n, np.zeros(DIMENSIONS)) for n in names]).T
        def answers(vectors):
            norms = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ matrix / np.where(norms > 0, norms, 1)[:, None]
            top = cosines.argmax(axis=1)
            return np.where(norms > 0, names[top], UNKNOWN), np.clip(cosines[np.arange(len(top)), top], 0, 1)

        for texts in batches:
            best, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            at, held = 0, None
            for first, vectors in letters.bundles(texts.fillna("").tolist()):
                if held is not None and first == at:
                    held = held + vectors
                    continue
                if held is not None:
                    best[at : at + len(held)], score[at : at + len(held)] = answers(held)
                at, held = first, vectors
            if held is not None:
                best[at : at + len(held)], score[at : at + len(held)] = answers(held)
            yield pd.DataFrame({"lang_pred": best, "score": score})

    return predict
