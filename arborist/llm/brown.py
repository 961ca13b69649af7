"""Language-model scores from Brown class n-grams.

Words are put into classes by exchange clustering, so that the classes of
neighbouring words tell as much about each other as they can; a text's
probability is then the product, over its tokens, of a class transition and of
the word's share in its class.

Texts are packed into blocks of bounded size, each with its own dictionary.
Words are dealt by their hashes to ranges of bounded size.  Blocks and ranges
exchange packets: a block sends its words of a range, and later their counts of
neighbouring classes; a range sends back what it knows of these words.  So a
shuffle moves a few packed rows for each block, never a row per token or word.
Classes come from two stages:

* the most frequent words, a fixed number, exchange one after the other on
  their own bigram counts until none gains;
* then every word of the training texts, in rounds: its counts of classes to
  the left and to the right are summed over all blocks, and it moves to the
  class in which the likelihood of the corpus is largest, the word being taken
  out of its own class.  Words of a round move together; a round after which
  the likelihood is lower than before is undone and ends the clustering.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborist.llm.common import fresh, from_files, give_back, locator
from arborist.llm.shingles import mix, powers
from arborist.session import cut_lineage

CLASSES = 48  #: classes of words; the end of a text is a further one, 0
SEEDS = 512  #: most frequent words, clustered first
ROUNDS = 2  #: exchange rounds over the whole vocabulary
BLOCK_BYTES = 1 << 23  #: text in a block; a longer text is a block of its own
RANGE_WORDS = 1 << 19  #: dictionary entries in a range of words
SHARE = 0.1  #: pseudo-count of a word in its class, and of an unknown word in every class
BACKOFF = 10.0  #: pseudo-count of the class frequencies in a transition
END = b""  #: the end of a text, in dictionaries: no word is empty

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def phi(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1))


# blocks


BLOCK = "block LONG, places ARRAY<STRING>, learn BINARY, sizes BINARY, tokens BINARY, seats BINARY, words BINARY, hashes BINARY, counts BINARY, n_words LONG"
PACKET = "range LONG, block LONG, data BINARY"


def squeeze(values: np.ndarray) -> bytes:
    """An array of integers as bytes, small numbers in two bytes each."""
    values = np.asarray(values)
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = "<u2" if low >= 0 and high < 1 << 16 else "<i4" if -(1 << 31) <= low and high < 1 << 31 else "<i8"
    raw = values.astype(kind).tobytes()
    return kind[1:].encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[10:], decompressed_size=int.from_bytes(data[2:10], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, "<" + data[:2].decode()).astype(np.int64)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays of a packet that holds several."""
    out = []
    while data:
        size = int.from_bytes(data[:8], "little")
        out.append(unsqueeze(data[8 : 8 + size]))
        data = data[8 + size :]
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """Numbers below 2**62 that deal words out; equal words have equal numbers."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(words.to_pylist()), dtype=np.uint8)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    mixed = mix((sums[ends] - sums[ends - sizes]) * down[ends - sizes] + sizes.astype(np.uint64))
    return (mixed >> np.uint64(2)).astype(np.int64)


def pack_block(number: int, places: list[str], learn: list[bool], texts: list[bytes]) -> dict:
    """One block: where its texts are, whether they teach, their lengths and tokens, and the block's dictionary.

    Tokens are ranks by frequency.  The dictionary is in the order of the words'
    hashes, so that every range of hashes is a slice; `seats` says where the word
    of a rank is in it.
    """
    parts, sizes = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        words.append(END)
        sizes.append(len(words))
        parts.append(pa.array(words, pa.binary()))
    coded = pa.chunked_array(parts).combine_chunks().dictionary_encode()
    del parts
    tokens = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(coded.dictionary)
    teaches = np.repeat(np.array(learn, dtype=bool), sizes)
    counts = np.bincount(tokens[teaches], minlength=size)
    by_rank = np.argsort(-np.bincount(tokens, minlength=size), kind="stable")
    rank = np.empty(size, dtype=np.int64)
    rank[by_rank] = np.arange(size)
    hashes = word_hashes(coded.dictionary)
    by_hash = np.argsort(hashes, kind="stable")
    seat = np.empty(size, dtype=np.int64)
    seat[by_hash] = np.arange(size)
    return {
        "block": number,
        "places": places,
        "learn": squeeze(np.array(learn, dtype=np.int64)),
        "sizes": squeeze(np.array(sizes)),
        "tokens": squeeze(rank[tokens]),
        "seats": squeeze(seat[by_rank]),
        "words": b" ".join(coded.dictionary.take(pa.array(by_hash)).to_pylist()),
        "hashes": hashes[by_hash].tobytes(),
        "counts": squeeze(counts[by_hash]),
        "n_words": size,
    }


def pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of `docs`(place, learn, text)."""
    schema = T._parse_datatype_string(BLOCK)
    arrow = pa.schema(
        [("block", pa.int64()), ("places", pa.list_(pa.string())), *((c, pa.binary()) for c in schema.names[2:9]), ("n_words", pa.int64())]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        places: list[str] = []
        learn: list[bool] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for place, teaches, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                text = text or b""
                if texts and held + len(text) > block_bytes:
                    yield pa.RecordBatch.from_pylist([pack_block(number, places, learn, texts)], schema=arrow)
                    number, places, learn, texts, held = number + 1, [], [], [], 0
                places.append(place)
                learn.append(bool(teaches))
                texts.append(text)
                held += len(text) + 1
        if texts:
            yield pa.RecordBatch.from_pylist([pack_block(number, places, learn, texts)], schema=arrow)
        del places, learn, texts
        give_back()

    return docs.select("place", "learn", "text").mapInArrow(kernel, schema)


def cuts(hashes: bytes, ranges: int) -> np.ndarray:
    """Where the slices of a block's dictionary begin and end, for so many ranges of hashes."""
    bounds = np.array([((1 << 62) * r) // ranges for r in range(ranges)], dtype=np.int64)
    own = np.frombuffer(hashes, dtype=np.int64)
    return np.append(np.searchsorted(own, bounds), len(own))


def packets(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table(
        {"range": pa.array([r for r, _, _ in rows], pa.int64()), "block": pa.array([b for _, b, _ in rows], pa.int64()), "data": pa.array([d for _, _, d in rows], pa.binary())}
    )


def number_words(blocks: DataFrame, ranges: int, seeds: int) -> DataFrame:
    """Packets of a range of words: per block the numbers of its words, and for the whole range (`block` -1) their counts.

    A range's most frequent words come with it (`block` -2, one packet per word:
    its count, high byte first, its number, and the word), and where the end is
    (`block` -3: its number).
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts, at = row["words"].split(b" "), unsqueeze(row["counts"]), cuts(row["hashes"], ranges)
                found = [
                    (r, row["block"], len(c := squeeze(counts[a:b])).to_bytes(8, "little") + c + b" ".join(words[a:b]))
                    for r, (a, b) in enumerate(zip(at, at[1:]))
                    if b > a
                ]
                yield from packets(found).to_batches()
        give_back()

    def number(table: pa.Table) -> pa.Table:
        r = table["range"][0].as_py()
        parts, counts = [], []
        for data in table["data"].to_pylist():
            size = int.from_bytes(data[:8], "little")
            counts.append(unsqueeze(data[8 : 8 + size]))
            parts.append(pa.array(data[8 + size :].split(b" "), pa.binary()))
        coded = pa.chunked_array(parts).combine_chunks().dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.bincount(ids, np.concatenate(counts), minlength=len(coded.dictionary)).astype(np.int64)
        bounds = np.cumsum([0, *map(len, parts)])
        rows = [(r, b, squeeze(ids[a:z])) for b, a, z in zip(table["block"].to_pylist(), bounds, bounds[1:])]
        rows.append((r, -1, squeeze(total)))
        # by count, then by word
        lead = np.flatnonzero(total >= max(1, np.sort(total)[-min(seeds + 1, len(total))]))
        named = sorted((-int(total[k]), coded.dictionary[int(k)].as_py(), int(k)) for k in lead)
        for count, word, k in [x for x in named if x[1] != END][:seeds]:
            rows.append((r, -2, (-count).to_bytes(8, "big") + k.to_bytes(8, "little") + word))
        end = pc.index(coded.dictionary, pa.scalar(END, pa.binary())).as_py()
        if end >= 0:
            rows.append((r, -3, end.to_bytes(8, "little")))
        give_back()
        return packets(rows)

    dealt = blocks.select("block", "words", "hashes", "counts").mapInArrow(deal, PACKET)
    return dealt.groupBy("range").applyInArrow(number, PACKET)


def attach(ids: DataFrame, *states: DataFrame) -> DataFrame:
    """What is known of the words of every range (`states`: range, data), dealt to the blocks that have them."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        values = [unsqueeze(d) for _, d in sorted(zip(right["place"].to_pylist(), right["data"].to_pylist()))]
        rows = []
        for r, block, data in zip(left["range"].to_pylist(), left["block"].to_pylist(), left["data"].to_pylist()):
            own = unsqueeze(data)
            packed = [squeeze(v[own]) for v in values]
            rows.append((r, block, b"".join(len(p).to_bytes(8, "little") + p for p in packed)))
        return packets(rows)

    known = [s.select(F.col("range").alias("of"), F.lit(k).alias("place"), "data") for k, s in enumerate(states)]
    every = known[0]
    for more in known[1:]:
        every = every.unionByName(more)
    return ids.groupBy("range").cogroup(every.groupBy("of")).applyInArrow(kernel, PACKET)


def meet(blocks: DataFrame, attached: DataFrame, kernel, schema: str) -> DataFrame:
    """Each block with what is attached to its dictionary, in one task of bounded size.

    `kernel` takes the block's row, its tokens as places in the dictionary, and the attached values by place.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (block,) = left.to_pylist()
        slices = []
        for _, data in sorted(zip(right["range"].to_pylist(), right["data"].to_pylist())):
            slices.append(unpacked(data))
        known = [np.concatenate(v) for v in zip(*slices)]
        del slices
        out = kernel(block, unsqueeze(block["seats"])[unsqueeze(block["tokens"])], *known)
        give_back()
        return out

    own = blocks.select("block", "places", "learn", "sizes", "tokens", "seats", "hashes")
    dealt = attached.select("range", F.col("block").alias("in_block"), "data")
    return own.groupBy("block").cogroup(dealt.groupBy("in_block")).applyInArrow(run, schema)


def teaching(block: dict) -> np.ndarray:
    """Whether each token of a block is in a text that teaches."""
    return np.repeat(unsqueeze(block["learn"]).astype(bool), unsqueeze(block["sizes"]))


def square(cells: DataFrame, width: int) -> np.ndarray:
    """The matrix of a table (cell, n) with no more than `width` squared different cells."""
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(width * width, dtype=np.int64)
    matrix[found["cell"].to_numpy()] = found["n"].to_numpy()
    return matrix.reshape(width, width)


# seeds


def exchange_seeds(pairs: np.ndarray, classes: int, passes: int = 20) -> np.ndarray:
    """Classes 1 .. `classes` of words 1 .., from their bigram counts (0: the end), by sequential exchange."""
    n = len(pairs) - 1
    of = np.concatenate(([0], np.arange(n) % classes + 1))
    k = classes + 1
    pairs = pairs.astype(np.float64)
    matrix = np.zeros((k, k))
    np.add.at(matrix, (of[:, None], of[None, :]), pairs)
    for _ in range(passes):
        moved = False
        for w in range(1, n + 1):
            self_pair = pairs[w, w]
            right = np.bincount(of, pairs[w], minlength=k)
            left = np.bincount(of, pairs[:, w], minlength=k)
            right[of[w]] -= self_pair
            left[of[w]] -= self_pair
            old = of[w]
            matrix[old] -= right
            matrix[:, old] -= left
            matrix[old, old] -= self_pair
            gain = np.full(k, -np.inf)
            rows, columns = matrix.sum(1), matrix.sum(0)
            base = phi(matrix)
            gain[1:] = (phi(matrix + right[None, :]) - base).sum(1)[1:] + (phi(matrix + left[:, None]) - base).sum(0)[1:]
            # the cell of the class with itself takes both sides at once
            own = np.diag(matrix)
            gain[1:] += (phi(own + right + left + self_pair) - phi(own + right) - phi(own + left) + phi(own))[1:]
            gain[1:] -= (phi(rows + right.sum() + self_pair) - phi(rows) + phi(columns + left.sum() + self_pair) - phi(columns))[1:]
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            of[w] = new
            moved |= new != old
            matrix[new] += right
            matrix[:, new] += left
            matrix[new, new] += self_pair
        if not moved:
            break
    return of


def seed_pairs(blocks: DataFrame, attached: DataFrame, seeds: int) -> np.ndarray:
    """Counts of neighbouring pairs of the most frequent words, the end being number 0 and other words -1."""

    def kernel(block: dict, tokens: np.ndarray, number: np.ndarray) -> pa.Table:
        here = number[tokens]
        before = np.concatenate(([0], here[:-1]))  # a block begins after an end
        both = teaching(block) & (here >= 0) & (before >= 0)
        cells, counts = np.unique(before[both] * (seeds + 1) + here[both], return_counts=True)
        return pa.table({"cell": cells, "n": counts})

    return square(meet(blocks, attached, kernel, "cell LONG, n LONG"), seeds + 1)


# exchange over the vocabulary


def neighbour_stats(blocks: DataFrame, attached: DataFrame, width: int, ranges: int, of_words: bool) -> DataFrame:
    """Per block a packet (`range` -1) with its transitions between classes, a matrix line by line.

    With `of_words` also a packet per range: of every word of the slice the
    number of its cells, then the cells' codes and counts: a class before it
    (codes below `width`) or after it.  The start of a text counts as an end.
    """

    def kernel(block: dict, tokens: np.ndarray, of: np.ndarray) -> pa.Table:
        teaches = teaching(block)
        here = of[tokens]
        before = np.concatenate(([0], here[:-1]))[teaches]
        after = np.concatenate((here[1:], [0]))[teaches]
        at = tokens[teaches]
        rows = [(-1, block["block"], squeeze(np.bincount(before * width + here[teaches], minlength=width * width)))]
        del here, teaches
        if of_words:
            inner = of[at] != 0  # the end stays where it is
            at, before, after = at[inner], before[inner], after[inner]
            cells, counts = np.unique(np.concatenate((at * (2 * width) + before, at * (2 * width) + width + after)), return_counts=True)
            words = cells // (2 * width)
            edges = cuts(block["hashes"], ranges)
            places = np.searchsorted(words, edges)
            for r in range(ranges):
                a, b = places[r], places[r + 1]
                if edges[r + 1] > edges[r]:
                    parts = (np.bincount(words[a:b] - edges[r], minlength=edges[r + 1] - edges[r]), cells[a:b] % (2 * width), counts[a:b])
                    rows.append((r, block["block"], b"".join(len(p).to_bytes(8, "little") + p for p in map(squeeze, parts))))
        return packets(rows)

    return meet(blocks, attached, kernel, PACKET)


def transitions(stats: DataFrame, width: int) -> np.ndarray:
    """Counts of neighbouring classes in all training texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += unsqueeze(data)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": cells, "n": total[cells]})

    return square(stats.where("range = -1").select("data").mapInArrow(add, "cell LONG, n LONG"), width)


def likelihood(matrix: np.ndarray) -> float:
    """The part of the training texts' log-likelihood that depends on the classes."""
    m = matrix.astype(np.float64)
    return float(phi(m).sum() - phi(m.sum(1)).sum() - phi(m.sum(0)).sum())


def best_classes(matrix: np.ndarray, old: np.ndarray, total: np.ndarray, rows: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The class of every word with the largest gain of likelihood, its neighbours keeping theirs.

    Row i of (rows, codes, counts) says that word rows[i] has counts[i] times the
    class codes[i] before it (below the width) or after it; `total` are the
    words' occurrences.  Words are taken out of their own class first.  The last
    class is that of words without a class, and none moves there.
    """
    width = len(matrix)
    plain = matrix.astype(np.float64)
    # [code, class]: the cell that an occurrence of this neighbour adds to
    cells = np.concatenate((plain, plain.T))
    base = phi(cells)
    gain_of = np.empty((len(codes), width))
    for times in (1, 2, 3):  # nearly all
        some = counts == times
        gain_of[some] = (phi(cells + times) - base)[codes[some]]
    many = np.flatnonzero(counts > 3)
    gain_of[many] = phi(cells[codes[many]] + counts[many, None]) - base[codes[many]]
    own = old[rows]
    here_now = cells[codes, own]
    gain_of[np.arange(len(rows)), own] = phi(np.maximum(here_now, counts)) - phi(np.maximum(here_now - counts, 0))
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    gain = np.add.reduceat(gain_of, starts, axis=0)
    here = rows[starts]
    n = total[here].astype(np.float64)[:, None]
    for size in (plain.sum(0), plain.sum(1)):
        s = np.repeat(size[None, :], len(here), axis=0)
        at = np.arange(len(here)), old[here]
        s[at] = np.maximum(s[at] - n[:, 0], 0)
        gain -= phi(s + n) - phi(s)
    gain[:, 0] = gain[:, -1] = -np.inf
    best = gain.argmax(1)
    stay = gain[np.arange(len(here)), old[here]] >= gain[np.arange(len(here)), best] - 1e-9
    out = old.copy()
    out[here] = np.where(stay & (old[here] != width - 1), old[here], best)
    return out


def exchange_round(ids: DataFrame, state: DataFrame, stats: DataFrame, matrix: np.ndarray) -> DataFrame:
    """The state (range, data: classes by word number) after one round."""
    width = len(matrix)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = {b: unsqueeze(d) for b, d in zip(left["block"].to_pylist(), left["data"].to_pylist())}
        old = numbers.pop(-1)
        coded, counted = [], []
        for block, data in zip(right["in_block"].to_pylist(), right["data"].to_pylist()):
            lengths, codes, counts = unpacked(data)
            coded.append(np.repeat(numbers[block], lengths) * (2 * width) + codes)
            counted.append(counts)
        new = old.copy()
        if coded:
            cells, at = np.unique(np.concatenate(coded), return_inverse=True)
            counts = np.bincount(at, np.concatenate(counted), minlength=len(cells)).astype(np.int64)
            del coded, counted, at
            words, codes = cells // (2 * width), cells % (2 * width)
            total = np.bincount(words[codes < width], counts[codes < width], minlength=len(old)).astype(np.int64)
            for low in range(0, len(old), 4096):
                a, b = np.searchsorted(words, (low, low + 4096))
                if b > a:
                    part = slice(low, low + 4096)
                    new[part] = best_classes(matrix, old[part], total[part], words[a:b] - low, codes[a:b], counts[a:b])
        give_back()
        return packets([(left["range"][0].as_py(), -1, squeeze(new))])

    known = ids.unionByName(state)
    dealt = stats.where("range >= 0").select(F.col("range").alias("of"), F.col("block").alias("in_block"), "data")
    return known.groupBy("range").cogroup(dealt.groupBy("of")).applyInArrow(kernel, PACKET)


# the model


@dataclass
class ClassModel:
    """Transitions between classes and shares of words, as log10 probabilities of bounded size."""

    move: np.ndarray  #: [class before, class]; row `width - 1` is for an unknown word before
    share_of: np.ndarray  #: log10 of (occurrences of the class + SHARE for every word and an unknown one)
    unknown: np.ndarray  #: [class before]: log10 probability of an unknown word
    tokens: int
    words: int


def class_model(matrix: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> ClassModel:
    """From transition counts, occurrences of every class, and its number of different words."""
    width = len(matrix)
    total = sizes.sum()
    known = np.arange(width) < width - 1
    frequency = sizes / total if total else known / (width - 1)
    mass = sizes + SHARE * (words + 1)
    seen = matrix * known[None, :]
    move = (seen + BACKOFF * frequency[None, :]) / (seen.sum(1, keepdims=True) + BACKOFF)
    move[width - 1] = frequency  # what follows an unknown word has the classes' frequencies
    unknown = (move * (SHARE / mass)[None, :])[:, known].sum(1)
    with np.errstate(divide="ignore"):
        return ClassModel(np.log10(move), np.log10(mass), np.log10(unknown), int(total), int(words.sum()))


def score_blocks(blocks: DataFrame, attached: DataFrame, model: ClassModel) -> DataFrame:
    """(place, n_tokens, n_known, base_score, score) of every text."""
    floor = math.log10(model.tokens + SHARE * (model.words + 1))

    def kernel(block: dict, tokens: np.ndarray, of: np.ndarray, count: np.ndarray) -> pa.Table:
        sizes = unsqueeze(block["sizes"])
        text = np.repeat(np.arange(len(sizes)), sizes)
        here = of[tokens]
        before = np.concatenate(([0], here[:-1]))
        n = count[tokens]
        weight = np.log10(n + SHARE)
        known = n > 0
        likely = np.where(known, model.move[before, here] + weight - model.share_of[here], model.unknown[before])
        return pa.table(
            {
                "place": pa.array(block["places"], pa.string()),
                "n_tokens": sizes,
                "n_known": np.bincount(text, known, minlength=len(sizes)).astype(np.int64),
                "base_score": np.bincount(text, weight - floor, minlength=len(sizes)),
                "score": np.bincount(text, likely, minlength=len(sizes)),
            }
        )

    return meet(blocks, attached, kernel, "place STRING, n_tokens LONG, n_known LONG, base_score DOUBLE, score DOUBLE")


def first_state(counts: DataFrame, ends: dict[int, int], seeds: dict[int, list[tuple[int, int]]], other: int, unseen: int) -> DataFrame:
    """The state in which seeds have their number or class, the end has 0, words of training texts `other` and the rest `unseen`."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.where(unsqueeze(data) > 0, other, unseen)
                if r in ends:
                    values[ends[r]] = 0
                for k, v in seeds.get(r, ()):
                    values[k] = v
                rows.append((r, -1, squeeze(values)))
            yield from packets(rows).to_batches()

    return counts.select("range", "data").mapInArrow(fill, PACKET)


def class_sizes(state: DataFrame, counts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and different training words of every class."""

    def change(left: pa.Table, right: pa.Table) -> pa.Table:
        of, n = unsqueeze(left["data"][0].as_py()), unsqueeze(right["data"][0].as_py())
        sizes = np.bincount(of, n, minlength=width).astype(np.int64)
        return pa.table({"class": np.arange(width), "size": sizes, "words": np.bincount(of[n > 0], minlength=width)})

    other = counts.select(F.col("range").alias("of"), "data")
    rows = state.groupBy("range").cogroup(other.groupBy("of")).applyInArrow(change, "class LONG, size LONG, words LONG")
    found = {r["class"]: r for r in rows.groupBy("class").agg(F.sum("size").alias("size"), F.sum("words").alias("words")).collect()}
    return tuple(np.array([found[c][k] if c in found else 0 for c in range(width)]) for k in ("size", "words"))


def brown_scores(
    df: DataFrame,
    learn: Column,
    text: str = "text",
    classes: int = CLASSES,
    seeds: int = SEEDS,
    rounds: int = ROUNDS,
    block_bytes: int = BLOCK_BYTES,
    history: list[float] | None = None,
) -> DataFrame:
    """`df` with language-model scores of `text`, learnt from the rows where `learn` holds.

    Tokens are the words (runs of anything but ASCII white space, A-Z in lower
    case) and one end.  Columns added, behind underscores where `df` has them:
    n_tokens, n_known (tokens that occur in training texts), train_tokens,
    base_score (log10 probability under word frequencies with 0.1 added) and score
    (log10 probability under the class model).  A null text is an empty one; a
    null `learn` does not teach; repeated rows count as often as they come; without
    training texts every token is unknown and has probability 1; an empty table
    gives an empty one.  Other columns play no part.  `history` receives the
    training likelihood by the classes of every round that was kept.
    """
    spark = df.sparkSession
    names = fresh(df, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    place, teaches = fresh(df, "place", "learn")
    placed = from_files(df).withColumn(place, locator())
    docs = placed.withColumn(teaches, F.coalesce(learn, F.lit(False)))
    blocks = cut_lineage(pack(docs.select(F.col(place).alias("place"), F.col(teaches).alias("learn"), F.col(text).alias("text")), block_bytes))
    ranges = max(1, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // RANGE_WORDS))
    width = classes + 2
    numbered = cut_lineage(number_words(blocks, ranges, seeds))
    ids, counts = numbered.where("block >= 0"), numbered.where("block = -1")

    lead = numbered.where("block = -2").orderBy(F.expr("substring(data, 1, 8)").desc(), F.expr("substring(data, 17)")).limit(seeds)
    at = [(r["range"], int.from_bytes(r["data"][8:16], "little")) for r in lead.select("range", "data").collect()]
    ends = {r["range"]: int.from_bytes(r["data"], "little") for r in numbered.where("block = -3").collect()}
    of_range = lambda values: {r: [(k, v) for (q, k), v in zip(at, values) if q == r] for r, _ in at}
    numbers = first_state(counts, ends, of_range(range(1, len(at) + 1)), -1, -1)
    pairs = seed_pairs(blocks, attach(ids, numbers), seeds)
    of = exchange_seeds(pairs[: len(at) + 1, : len(at) + 1], classes)
    state = cut_lineage(first_state(counts, ends, of_range(of[1:].tolist()), width - 1, width - 1))

    best, matrix, kept = -math.inf, None, state
    for turn in range(rounds + 1):
        stats = cut_lineage(neighbour_stats(blocks, attach(ids, state), width, ranges, turn < rounds))
        moves = transitions(stats, width)
        # before the first round most words have no class, and so no likelihood to compare
        fits = likelihood(moves) if turn else -math.inf
        if turn > 1 and fits < best:
            break
        best, matrix, kept = fits, moves, state
        if turn and history is not None:
            history.append(fits)
        if turn < rounds:
            state = cut_lineage(exchange_round(ids, state, stats, moves))
    model = class_model(matrix, *class_sizes(kept, counts, width))
    total, *others = names[2], *(n for n in names if n != names[2])
    found = score_blocks(blocks, attach(ids, kept, counts), model).toDF(place, *others)
    return placed.join(found, place).withColumn(total, F.lit(model.tokens).cast("long")).select(*df.columns, *names)
