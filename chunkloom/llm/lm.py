"""Language-model scoring by a weighted backoff automaton.

Tokens are blank-separated words with A-Z lower-cased, then one end token, known by 64-bit hashes.
Documents are dealt into batches of about ``BATCH`` bytes, one row each.  A batch sends its distinct
n-grams of every order with their training counts once, in blocks by hash range; the counts are
summed in each range and come back to the batches, so every n-gram has its exact count over all
training texts, nothing of them passes the driver or is broadcast, and no n-gram takes more
places than there are batches.

N-grams of all orders with at least ``least`` training occurrences are known.  A state is the
longest known context.  It has an arc for each known continuation, with the discounted relative
frequency, and a failure arc to the context one token shorter, whose weight leaves
the probabilities of all tokens a sum of one.  The sums behind a context's weight are whole numbers; they come from the
first batch of each of its continuations and go to the batches that fail there.  Each batch builds the
part of the automaton that its own texts can reach.  The root has the smoothed single-token
probabilities.  A text is scored in one traversal from left to right that
carries the state; many texts (and parts of long ones, which repeat the tokens
that decide their first state) are traversed in step.

A null or empty text is the end token alone.  Repeated rows are scored each.  A null
doc_id is never training.  Without training texts all counts are zero.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import byte_slices, mix, span_hashes, text_bytes, word_spans
from chunkloom.session import materialize

ORDER = 3
# Least training occurrences of a known n-gram, whatever the size of the training texts.
LEAST = 2
DISCOUNT = 0.5
SMOOTHING = 0.1
BATCH = 8 << 20
# Tokens of a text traversed as one part.
PART = 256
END = 0
# Hash ranges: at least so many, and one for so many batches.
RANGES = 256
BATCHES_PER_RANGE = 4
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tokens_of(texts):
    """Token hashes of all texts in a row, each text closed by END, and each token's row."""
    import numpy as np

    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    hashes, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    sizes = np.diff(text_bytes(texts)[1])
    for a, b in byte_slices(sizes.tolist()):
        data, offsets = text_bytes(texts.slice(a, b - a))
        starts, ends, row = word_spans(data, offsets, ~blank)
        words = span_hashes(data, starts, ends).view(np.int64)
        words[words == END] = 1
        counts = np.bincount(row, minlength=b - a)
        own = np.full(len(words) + b - a, END, np.int64)
        place = np.ones(len(own), bool)
        place[np.cumsum(counts + 1) - 1] = False
        own[place] = words
        hashes.append(own)
        rows.append(a + np.repeat(np.arange(b - a), counts + 1))
    return np.concatenate(hashes), np.concatenate(rows)


def _deal(batches: Iterator) -> Iterator:
    """(doc_id, text, training) -> (batch, body): the rows of a batch as one compressed Arrow stream."""
    import pyarrow as pa
    import pyarrow.compute as pc

    number, filled, held = TaskContext.get().partitionId() << 32, 0, []

    def close():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        columns = [pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["batch", "body"])

    for rows in batches:
        start = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_pylist()):
            if filled and filled + size > BATCH:
                held += [rows.slice(start, i - start)] if i > start else []
                yield close()
                number, filled, held, start = number + 1, 0, [], i
            filled += size + 1
        held += [rows.slice(start)] if start < rows.num_rows else []
    if held:
        yield close()


def pack(values) -> bytes:
    """An array of 8-byte numbers, compressed by byte planes."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, size: int, kind):
    """The array of ``pack``."""
    import numpy as np
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(blob, 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def codes_of(hashes, rows, order: int) -> Iterator:
    """For each k: the code of the n-gram of k + 1 tokens that ends at each token, and the tokens at which one does."""
    import numpy as np

    code, inside = hashes.view(np.uint64), np.ones(len(hashes), bool)
    for k in range(order):
        if k:
            longer, within = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
            longer[1:] = mix(code[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes.view(np.uint64)[1:])
            within[1:] = inside[:-1] & (rows[1:] == rows[:-1])
            code, inside = longer, within
        yield k, code, np.flatnonzero(inside)


class Grams:
    """The n-grams of a batch's texts.

    ``names[k]`` has the sorted codes of its n-grams of k + 1 tokens, ``at[k]`` a place where each
    ends and ``place[k]`` the number of the one that ends at each token, or -1.
    """

    def __init__(self, hashes, rows, order: int):
        import numpy as np

        self.names, self.at, self.place = [], [], []
        for _, code, ends in codes_of(hashes, rows, order):
            names, first, number = np.unique(code[ends], return_index=True, return_inverse=True)
            place = np.full(len(hashes), -1, np.int64)
            place[ends] = number
            self.names.append(names)
            self.at.append(ends[first])
            self.place.append(place)

    def learn(self, counts: list, firsts: list, total: int, distinct: int, least: int) -> None:
        """Takes the training counts of all n-grams and which of them this batch answers for."""
        import numpy as np

        self.counts, self.firsts = counts, firsts
        self.known = [c >= least for c in counts]
        self.tokens = total + SMOOTHING * (distinct + 1)
        self.p = [(counts[0] + SMOOTHING) / self.tokens]
        # The context of each n-gram, and the n-gram without its first token.
        self.context, self.shorter = [None], [None]
        for k in range(1, len(counts)):
            self.context.append(self.place[k - 1][self.at[k] - 1])
            self.shorter.append(self.place[k - 1][self.at[k]])
            with np.errstate(divide="ignore", invalid="ignore"):
                self.p.append((counts[k] - DISCOUNT) / counts[k - 1][self.context[k]])

    def sums(self, k: int):
        """Contexts of k tokens whose weight this batch needs or adds to, and what it adds: the counts
        of their continuations, of these without their first token, and how many there are."""
        import numpy as np

        own = np.flatnonzero(self.known[k] & self.firsts[k])
        size, context = len(self.names[k - 1]), self.context[k][own]
        asked = np.zeros(size, bool)
        asked[context] = True
        asked[self.context[k][~self.known[k]]] = True
        asked = np.flatnonzero(asked & self.known[k - 1])
        # Whole numbers, exact in doubles far beyond any count.
        added = [np.bincount(context, weights=w, minlength=size) for w in (self.counts[k][own], self.counts[k - 1][self.shorter[k][own]], None)]
        return asked, [a[asked].astype(np.int64) for a in added]

    def back(self, k: int, asked, kept, below, many):
        """Weights of the failure arcs of contexts of k tokens, from the sums over all batches.

        What a context's continuations leave of its probability, over what they leave of that of the shorter context.
        """
        import numpy as np

        left = 1 - (kept - DISCOUNT * many) / self.counts[k - 1][asked]
        if k == 1:
            shorter = 1 - (below + SMOOTHING * many) / self.tokens
        else:
            shorter = 1 - (below - DISCOUNT * many) / self.counts[k - 2][self.shorter[k - 1][asked]]
        out = np.zeros(len(self.names[k - 1]))
        out[asked] = np.log10(np.maximum(left, 1e-12)) - np.log10(np.maximum(shorter, 1e-12))
        return out


def _blocks(level: int, batch: int, names, ranges: int, columns: list) -> list:
    """Rows (level, range, batch, size, codes, a column each): sorted codes cut by hash range."""
    import numpy as np

    number = ((names >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(number)) + 1
    return [
        (level, int(number[a]), batch, int(b - a), pack(np.diff(names[a:b], prepend=np.uint64(0))), *(pack(c[a:b]) for c in columns))
        for a, b in zip([0, *cuts], [*cuts, len(names)])
        if b > a
    ]


BLOCK = ("level", "int"), ("range", "int"), ("batch", "long"), ("size", "long"), ("codes", "binary")


def schema_of(fields) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields)


def _arrow(rows: list, fields):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])


REQUEST = (*BLOCK, ("n", "binary"))
ANSWER = ("level", "int"), ("range", "int"), ("batch", "long"), ("size", "long"), ("answer", "binary")
COUNTED = (*ANSWER, ("total", "long"), ("distinct", "long"))
ADDED = "kept", "below", "many"
SUMS = (*BLOCK, *((name, "binary") for name in ADDED))


def _requests(levels: range, ranges: int):
    """Batches -> their distinct n-grams of some levels with training counts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for rows in batches:
            for batch, body in zip(rows.column("batch").to_pylist(), rows.column("body")):
                docs = pa.ipc.open_stream(body.as_buffer()).read_all()
                hashes, row = tokens_of(docs.column("text").combine_chunks())
                training = docs.column("training").to_numpy().astype(bool)[row]
                for k, code, ends in codes_of(hashes, row, levels.stop):
                    if k in levels:
                        names, number = np.unique(code[ends], return_inverse=True)
                        n = np.bincount(number[training[ends]], minlength=len(names)).astype(np.int64)
                        yield from _arrow(_blocks(k, batch, names, ranges, [n]), REQUEST).to_batches()

    return run


def _opened(table):
    """A range's blocks: rows in order of batch, all codes as numbers in a sorted list, where each block ends."""
    import numpy as np

    table = table.sort_by("batch")
    sizes = table.column("size").to_pylist()
    codes = [np.cumsum(unpack(c, n, np.uint64), dtype=np.uint64) for c, n in zip(table.column("codes").to_pylist(), sizes)]
    _, first, number = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
    return table, sizes, np.cumsum(sizes)[:-1], first, number


def _numbers(table, name: str, sizes: list, kind):
    import numpy as np

    return np.concatenate([unpack(c, n, kind) for c, n in zip(table.column(name).to_pylist(), sizes)])


def _count(least: int):
    def run(table):
        """Sums counts in one range and answers twice the count, and one more to the first batch that asks."""
        import numpy as np

        level, place = table.column("level")[0].as_py(), table.column("range")[0].as_py()
        table, sizes, cuts, first, number = _opened(table)
        n = _numbers(table, "n", sizes, np.int64)
        c = np.bincount(number, weights=n).astype(np.int64)
        if level:
            c[c < least] = 0
        own = np.zeros(len(number), np.int64)
        own[first] = c > 0
        answers, totals, owned = (np.split(x, cuts) for x in (2 * c[number] + own, n, own))
        rows = [
            (level, place, b, size, pack(a), int(t.sum()), int(o.sum()))
            for b, size, a, t, o in zip(table.column("batch").to_pylist(), sizes, answers, totals, owned)
        ]
        return _arrow(rows, COUNTED)

    return run


def _add(table):
    """Adds up one range's sums over all batches and answers them, the three numbers behind each other."""
    import numpy as np

    level, place = table.column("level")[0].as_py(), table.column("range")[0].as_py()
    table, sizes, cuts, _, number = _opened(table)
    whole = [np.bincount(number, weights=_numbers(table, c, sizes, np.int64)).astype(np.int64)[number] for c in ADDED]
    parts = zip(*(np.split(x, cuts) for x in whole))
    rows = zip(table.column("batch").to_pylist(), sizes, parts)
    return _arrow([(level, place, b, size, pack(np.concatenate(part))) for b, size, part in rows], ANSWER)


def _answers(table, level: int, numbers: int = 1):
    """One level's answers to a batch, in the order of its codes: an array for each of the ``numbers`` they hold."""
    import numpy as np
    import pyarrow.compute as pc

    table = table.filter(pc.equal(table.column("level"), level)).sort_by("range")
    if not table.num_rows:
        return np.empty((numbers, 0), np.int64)
    blocks = zip(table.column("answer").to_pylist(), table.column("size").to_pylist())
    return np.concatenate([unpack(c, numbers * n, np.int64).reshape(numbers, n) for c, n in blocks], axis=1)


def _learned(body, answers, order: int, total: int, distinct: int, least: int):
    """A batch's documents, token hashes and rows, and its n-grams with their counts."""
    import numpy as np
    import pyarrow as pa

    docs = pa.ipc.open_stream(body.as_buffer()).read_all()
    hashes, rows = tokens_of(docs.column("text").combine_chunks())
    grams = Grams(hashes, rows, order)
    both = [_answers(answers, k)[0] for k in range(order)]
    grams.learn([b >> 1 for b in both], [(b & 1).astype(bool) for b in both], total, distinct, least)
    return docs, hashes, rows, grams


def _sums(order: int, ranges: int, total: int, distinct: int, least: int):
    """A batch with its counts -> what it adds to the weights of contexts, level -k for those of k tokens."""

    def run(batch, answers):
        import pyarrow as pa

        out = [_arrow([], SUMS)]
        for number, body in zip(batch.column("batch").to_pylist(), batch.column("body")):
            grams = _learned(body, answers, order, total, distinct, least)[-1]
            for k in range(1, order):
                asked, added = grams.sums(k)
                out.append(_arrow(_blocks(-k, number, grams.names[k - 1][asked], ranges, added), SUMS))
        return pa.concat_tables(out)

    return run


def find(sorted_values, wanted):
    """Places of values in a sorted array, -1 for those that are not there."""
    import numpy as np

    if not len(sorted_values):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


class Automaton:
    """States, arcs and failure arcs of the known n-grams of a batch.

    State 0 is the root; the n-grams of each order follow.  ``levels[0]`` has the known tokens;
    ``levels[k]`` the codes of known n-grams of k + 1 tokens: the number of the n-gram without its
    last token, times the known tokens, plus the last token's number.  ``back[k]`` has the
    weights of failure arcs for all contexts in ``grams``.
    """

    def __init__(self, grams: Grams, back: list):
        import numpy as np

        known = [np.flatnonzero(k) for k in grams.known]
        # Names are sorted, so known tokens are; longer n-grams are numbered by their codes.
        self.levels, self.arc, self.back, self.suffix = [grams.names[0][known[0]].view(np.int64)], [None], [], []
        number, width = [], max(1, len(known[0]))
        for k, mine in enumerate(known):
            if k:
                codes = number[k - 1][grams.context[k][mine]] * width + number[0][grams.place[0][grams.at[k][mine]]]
            else:
                codes = self.levels[0]
            order = np.argsort(codes, kind="stable")
            mine = mine[order]
            number.append(np.full(len(grams.names[k]), -1, np.int64))
            number[k][mine] = np.arange(len(mine))
            if k:
                self.levels.append(codes[order])
                self.arc.append(np.log10(grams.p[k][mine]))
            else:
                self.levels[0] = codes[order]
            self.suffix.append(number[k - 1][grams.shorter[k][mine]] if k else np.zeros(len(mine), np.int64))
            # The longest n-grams have no arcs of their own and fail for free.
            self.back.append(back[k][mine] if k < len(known) - 1 else np.zeros(len(mine)))
        self.first = np.cumsum([1, *map(len, self.levels)])

    def step(self, state, known, single):
        """One token for many states: (log10 probability, next state)."""
        import numpy as np

        score, target, width = np.zeros(len(state)), np.zeros(len(state), np.int64), len(self.levels[0])
        open_, at = np.arange(len(state)), state.copy()
        for k in range(len(self.levels), 0, -1):
            # States of order k try their arcs, then fail to order k - 1.
            here = open_[at[open_] >= self.first[k - 1]]
            own = at[here] - self.first[k - 1]
            if k < len(self.levels):
                arc = np.where(known[here] >= 0, find(self.levels[k], own * width + known[here]), -1)
            else:
                arc = np.full(len(here), -1)
            taken = arc >= 0
            if taken.any():
                score[here[taken]] += self.arc[k][arc[taken]]
                target[here[taken]] = self.first[k] + arc[taken]
            failed = here[~taken]
            score[failed] += self.back[k - 1][own[~taken]]
            at[failed] = 0 if k == 1 else self.first[k - 2] + self.suffix[k - 1][own[~taken]]
            open_ = np.setdiff1d(open_, here[taken], assume_unique=True) if taken.any() else open_
        score[open_] += single[open_]
        target[open_] = np.where(known[open_] >= 0, 1 + known[open_], 0)
        return score, target

    def traverse(self, hashes, rows, single, n_rows: int):
        """The score of each row's tokens."""
        import numpy as np

        known = find(self.levels[0], hashes)
        sizes = np.bincount(rows, minlength=n_rows)
        begins = np.cumsum(sizes) - sizes
        parts = -(-sizes // PART)
        row = np.repeat(np.arange(n_rows), parts)
        number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = begins[row] + number * PART
        stop = np.minimum(start + PART, begins[row] + sizes[row])
        # Tokens before the part that only lead to its first state.
        lead = np.minimum(number * PART, len(self.levels))
        order = np.argsort(-(stop - start + lead), kind="stable")
        start, stop, lead, row = start[order], stop[order], lead[order], row[order]
        scores, state = np.zeros(len(row)), np.zeros(len(row), np.int64)
        length = stop - start + lead
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, side="left"))
            at = start[:n] - lead[:n] + i
            gained, state[:n] = self.step(state[:n], known[at], single[at])
            scores[:n] += np.where(i >= lead[:n], gained, 0.0)
        return np.bincount(row, weights=scores, minlength=n_rows)


def _score(order: int, total: int, distinct: int, least: int):
    def run(batch, answers):
        import numpy as np
        import pyarrow as pa

        out = []
        for body in batch.column("body"):
            docs, hashes, rows, grams = _learned(body, answers, order, total, distinct, least)
            back = [grams.back(k, grams.sums(k)[0], *_answers(answers, -k, len(ADDED))) for k in range(1, order)]
            uses, single = grams.counts[0][grams.place[0]], np.log10(grams.p[0])[grams.place[0]]
            n = docs.num_rows
            columns = [
                docs.column("doc_id").combine_chunks(),
                docs.column("training").combine_chunks(),
                pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                pa.array(np.bincount(rows, weights=uses > 0, minlength=n).astype(np.int64)),
                pa.array(np.full(n, total, np.int64)),
                pa.array(np.bincount(rows, weights=single, minlength=n)),
                pa.array(Automaton(grams, back).traverse(hashes, rows, single, n)),
            ]
            names = ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            out.append(pa.Table.from_arrays(columns, names))
        return pa.concat_tables(out)

    return run


def _written(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, with the shuffle files of the job removed at its end."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN_KEY, "false")
    conf.set(CLEAN_KEY, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(CLEAN_KEY, before)


def score_documents(
    docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, least: int = LEAST
) -> DataFrame:
    """One row per document: doc_id, training, n_tokens, n_known, train_tokens, base_score, score.

    N-grams of two or more tokens are known from ``least`` training occurrences on, also single ones with 1.
    """
    if order < 1 or least < 1:
        raise ValueError("order and least occurrences must be at least 1")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = materialize(rows.mapInArrow(_deal, "batch long, body binary"), "batches")
    ranges = max(RANGES, -(-dealt.count() // BATCHES_PER_RANGE))

    def counted(levels: range) -> DataFrame:
        requests = dealt.mapInArrow(_requests(levels, ranges), schema_of(REQUEST))
        return _written(requests.groupBy("level", "range").applyInArrow(_count(least), schema_of(COUNTED)), "counts")

    # The longest n-grams are most of all: counted apart, their requests and the others are not on disk together.
    counts = counted(range(0, 1) if order == 1 else range(0, order - 1))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "distinct")]
    total, distinct = counts.where("level = 0").agg(*sums).first()
    if order > 1:
        counts = counts.union(counted(range(order - 1, order)))
    answers = counts.select(*(name for name, _ in ANSWER))
    if order > 1:
        added = (
            dealt.groupBy("batch")
            .cogroup(answers.groupBy("batch"))
            .applyInArrow(_sums(order, ranges, total, distinct, least), schema_of(SUMS))
        )
        weights = _written(added.groupBy("level", "range").applyInArrow(_add, schema_of(ANSWER)), "weights")
        answers = answers.union(weights)
    return (
        dealt.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(
            _score(order, total, distinct, least),
            f"doc_id {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
