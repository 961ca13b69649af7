"""Periodic runs of words, by Lyndon roots.

A run is a stretch of consecutive words with a smallest period `q` that no
neighbouring word extends.  Every run of two periods or more contains a Lyndon
word of length `q` that is the longest one at its place, under an order of the
words or under the inverse order.  So the Lyndon arrays under both orders name
all candidates (place, period), and the longest common extensions to the left
and to the right of (place, place + period) give the run.

The Lyndon array is what the first phase of Baier's suffix sorter yields: it
groups the suffixes by their longest Lyndon prefix, from the highest group
down.  The suffixes that aren't grouped yet stay in a linked list; what a
suffix spans when its group's turn comes reaches just to the next one in the
list, which is its Lyndon length.

Only words in k-grams that occur twice in a text can lie in a run of at least
2 * k words: in such a run, at least k words in a row equal those one period
on, and these k-grams and their repeats cover it.  Texts are cut to such
stretches first, which loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arborist.llm.common import fresh, give_back

#: Bytes of text whose words are numbered at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 22
RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
RUN_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def lyndon_lengths(keys: Sequence[int], inverse: bool = False) -> list[int]:
    """Length of the longest Lyndon word at every place of `keys`, by Baier grouping.

    The order is that of the keys or, with `inverse`, the opposite one; a prefix
    is the lesser under both.
    """
    n = len(keys)
    first: dict[int, list[int]] = {}
    for i, key in enumerate(keys):
        first.setdefault(key, []).append(i)
    members = [first[key] for key in sorted(first, reverse=not inverse)]  # highest group first
    below = [*range(1, len(members)), -1]  # the next lower group
    above = [*range(-1, len(members) - 1)]
    number = {keys[group[0]]: g for g, group in enumerate(members)}
    of = [number[key] for key in keys]
    left = [*range(-1, n)]  # the nearest ungrouped places; place n is the end, place -1 the last list item
    right = [*range(1, n + 1), n, 0]
    length = [0] * n
    group = 0 if members else -1
    while group >= 0:
        reached: list[int] = []
        times: list[int] = []
        last = -1
        for i in members[group]:
            if of[i] != group:
                continue
            before, after = left[i], right[i]
            length[i] = after - i
            right[before] = after
            left[after] = before
            if before < 0:
                continue
            if before == last:
                times[-1] += 1
            else:
                reached.append(before)
                times.append(1)
                last = before
        members[group] = []
        # a place before the group absorbs its words: it rises right above its
        # old group, the higher the more often the word follows it
        if len(reached) == 1:
            place = reached[0]
            old = of[place]
            over = above[old]
            of[place] = len(members)
            below.append(old)
            above.append(over)
            below[over] = above[old] = len(members)
            members.append([place])
        elif reached:
            moved: dict[tuple[int, int], list[int]] = {}
            for place, count in zip(reached, times):
                key = of[place], count
                if key in moved:
                    moved[key].append(place)
                else:
                    moved[key] = [place]
            for old, count in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                # highest count first: each further one goes right above the old group, below those
                over = above[old]
                new = len(members)
                below.append(old)
                above.append(over)
                below[over] = above[old] = new
                places = moved[old, count]
                members.append(places)
                for place in places:
                    of[place] = new
        group = below[group]
    return length


def extend(words: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """How far the words before and from `a` agree with those before and from `b` (a < b)."""
    back = forth = 0
    step = 16
    while True:
        k = min(step, a - back)
        if not k:
            break
        differ = np.flatnonzero(words[a - back - k : a - back] != words[b - back - k : b - back])
        if len(differ):
            back += k - 1 - int(differ[-1])
            break
        back += k
        step *= 4
    step = 16
    while True:
        k = min(step, len(words) - b - forth)
        if not k:
            break
        differ = np.flatnonzero(words[a + forth : a + forth + k] != words[b + forth : b + forth + k])
        if len(differ):
            forth += int(differ[0])
            break
        forth += k
        step *= 4
    return back, forth


def runs_of(words: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least two periods and `shortest` words, by start, then period."""
    n = len(words)
    found: set[tuple[int, int, int]] = set()
    keys = words.tolist()
    for inverse in (False, True):
        period = np.array(lyndon_lengths(keys, inverse), dtype=np.int64)
        here = np.arange(n)
        there = here + period
        forth = words[here] == words[np.minimum(there, n - 1)]
        forth &= there < n
        back = words[here - 1] == words[there - 1]
        back[:1] = False
        end_of: dict[int, int] = {}  # where the last run of a period ends: a root within it gives the same run
        places = np.flatnonzero(forth | back)
        for i, q in zip(places.tolist(), period[places].tolist()):
            if end_of.get(q, -1) >= i + q:
                continue
            before, after = extend(words, i, i + q)
            total = before + q + after
            if total >= 2 * q:
                end_of[q] = i + q + after
                if total >= shortest:
                    found.add((i - before, total, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def repeated_stretches(words: np.ndarray, text_of: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Maximal stretches (begin, end) covered by k-grams that occur twice within their text.

    Grams are compared by hash: a clash only makes a stretch longer.
    """
    n = len(words) - k + 1
    if n < 2:
        return []
    odd = np.random.default_rng(11).integers(1, 1 << 62, size=k + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    inside = text_of[:n] == text_of[k - 1 :]
    code = text_of[:n].astype(np.uint64) * odd[k]
    wide = words.astype(np.uint64) + np.uint64(1)
    for j in range(k):
        code += wide[j : j + n] * odd[j]
        code ^= code >> np.uint64(29)
    at = np.flatnonzero(inside)
    order = at[np.argsort(code[at])]
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    if not len(starts):
        return []
    # a gap, or another text, ends a stretch
    breaks = (starts[1:] > starts[:-1] + k) | (text_of[starts[1:]] != text_of[starts[:-1]])
    begins = starts[np.concatenate(([True], breaks))]
    ends = starts[np.concatenate((breaks, [True]))] + k
    return list(zip(begins.tolist(), ends.tolist()))


def analyse(texts: Sequence[bytes], shortest: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of every text.

    A text is collapsed by dropping every word that a run holds after its first
    period; what is kept is joined by single spaces.
    """
    split = [text.split() for text in texts]
    sizes = np.array([len(words) for words in split], dtype=np.int64)
    text_of = np.repeat(np.arange(len(split)), sizes)
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    flat = pa.chunked_array([pa.array(words, pa.binary()) for words in split] or [pa.array([], pa.binary())]).combine_chunks()
    numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in repeated_stretches(numbers, text_of, max(1, -(-shortest // 2))):
        text = int(text_of[begin])
        shift = begin - int(firsts[text])
        here = [(start + shift, length, q) for start, length, q in runs_of(numbers[begin:end], shortest)]
        if here:
            runs.setdefault(text, []).extend(here)
    for text, words in enumerate(split):
        here = runs.get(text, [])
        if here:
            here.sort(key=lambda run: (run[0], run[2]))
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for start, length, q in here:
                edge[start + q] += 1
                edge[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        yield int(sizes[text]), here, b" ".join(words)


def periodic_runs(df: DataFrame, text: str = "text", shortest: int = 12) -> DataFrame:
    """`df` with the periodic runs of words in `text`, and the text without what the runs repeat.

    Columns added (names behind underscores where `df` has them): `n_words`,
    `runs` (array of start, length, period, by start, then period) and
    `collapsed`.  Words are runs of anything but ASCII white space; runs have two
    periods and `shortest` words at least.  A null text has no words, no runs and
    an empty collapsed text, as an empty one; ids, ties, repeated rows and other
    columns play no part; an empty table gives an empty one.  Each text is one
    row's work and nothing is shuffled.
    """
    names = fresh(df, "n_words", "runs", "collapsed")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in zip(names, (T.LongType(), RUN, T.StringType())))])
    at = df.columns.index(text)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at).cast(pa.binary())), 0).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_BYTES, prepend=0))
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                if high > low:
                    yield batch.slice(int(low), int(high - low))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            counts, found, kept = zip(*analyse(texts, shortest))
            spans = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
            columns = [pa.array(counts, pa.int64()), pa.array(spans, RUN_ARROW), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[f.name for f in schema])
        give_back()

    return df.mapInArrow(kernel, schema)
