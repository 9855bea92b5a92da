"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids plus an end id; only longer ones than a sequence are cut, the remainder coming first. Whole
sequences are settled at once. The rest is dealt to blocks of about BLOCK_ROWS pieces. Each block is evolved by ISLANDS tasks, each
with a population of its own: crossover injects whole well-filled bins of one parent into the other, removes the bins that
hold a duplicate, and best-fits the displaced documents, longest first; mutation dissolves poorly filled bins. Between
epochs the best solution of each island moves on to the next island of its block, around a ring. Then the best island's bins
that are filled well settle; the others dissolve and their documents join other blocks in the next round. Rows of a block are
bounded whatever the table's size, and only ids and lengths are moved.
"""

from __future__ import annotations

import base64
import json
import math
import random
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, ship, stash

CAPACITY = 2048
END_ID = 0
BLOCK_ROWS = 4096
#: Tasks that evolve each block, and how often they run; their elites migrate between the runs.
ISLANDS, EPOCHS = 3, 2
MEMBERS, GENERATIONS = 4, 8
#: Bins filled less than this dissolve between rounds.
SETTLED = 0.995
ROUNDS = 3
#: Words whose ids a worker remembers at most; then it starts anew.
REMEMBERED = 400_000


class _Slow(Exception):
    pass


def read_ranks(ranks_path: str, pattern: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """The encoder of ordinary text of a file of ranks, and the bytes of each id."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    given = {i: token for token, i in ranks.items()}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, [given.get(i, b"") for i in range(max(given) + 1)]


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes; ids of single words are remembered.

    A byte-level BPE never joins across a single space or newline between two other characters but for the space that
    leads a word, so such texts are put together from their words; others are encoded whole. Texts with the string of a
    special token go through the tokenizer's own file, which gives it one id.
    """

    def __init__(self, ranks_path: str, pattern: str, whole_path: str):
        with open(whole_path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens") or ()]
        self.whole_path, self.whole = whole_path, None

        self.encode = read_ranks(ranks_path, pattern)[0]
        self.first, self.later = _Words(self.encode, ""), _Words(self.encode, " ")
        self.newline = self._bytes("\n")

    def _bytes(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _by_file(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.whole_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self._by_file(text)
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return self._bytes(text)
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first.clear()
            self.later.clear()
        try:
            out = []
            later = self.later.__getitem__
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(self.first[words[0]])
                out.extend(map(later, words[1:]))
                out.append(self.newline)
            out.pop()
            return b"".join(out)
        except _Slow:
            return self._bytes(text)


class _Words(dict):
    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, word: str) -> bytes:
        if word.split() != [word]:
            raise _Slow
        ids = array("I", self.encode(self.lead + word))
        out = ids.tobytes()
        if len(word) <= 40:
            self[word] = out
        return out


def pieces(docs: DataFrame, ranks_path: str, pattern: str, whole_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32) of every piece; uid is unique. Null text counts as empty."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(ranks_path, pattern, whole_path)
        end = np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            row, number, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encoder(text.as_py() or "") + end
                n = len(ids) // 4
                head = n % capacity or capacity
                view = memoryview(ids)
                for k, a in enumerate([0, *range(head, n, capacity)]):
                    b = head if not k else a + capacity
                    row.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(view[4 * a : 4 * b]))
            yield {
                "uid": pa.array(np.arange(uid, uid + len(row))), "doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(number, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            uid += len(row)

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs, step, f"uid bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", [id_col, text_col])


class Solution:
    """Bins of item indexes with their fill; best fit by a bit set of the spaces that some bin has."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.space: dict[int, int] = {}
        self.with_space: dict[int, set[int]] = {}
        self.mask = 0
        self.next = 0

    def _enter(self, b: int, space: int) -> None:
        self.space[b] = space
        some = self.with_space.get(space)
        if not some:
            self.with_space[space] = {b}
            self.mask |= 1 << space
        else:
            some.add(b)

    def _leave(self, b: int) -> None:
        space = self.space.pop(b)
        some = self.with_space[space]
        some.discard(b)
        if not some:
            self.mask &= ~(1 << space)

    def add_bin(self, items: list[int]) -> None:
        self.bins[self.next] = items
        self._enter(self.next, self.capacity - sum(self.sizes[i] for i in items))
        self.next += 1

    def drop_bin(self, b: int) -> list[int]:
        self._leave(b)
        return self.bins.pop(b)

    def place(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.mask >> size
        if not fits:
            self.add_bin([item])
            return
        space = size + (fits & -fits).bit_length() - 1
        b = next(iter(self.with_space[space]))
        self._leave(b)
        self.bins[b].append(item)
        self._enter(b, space - size)

    def place_all(self, items: list[int]) -> None:
        for i in sorted(items, key=self.sizes.__getitem__, reverse=True):
            self.place(i)

    def copy(self) -> Solution:
        new = Solution(self.sizes, self.capacity)
        for items in self.bins.values():
            new.add_bin(list(items))
        return new

    def fitness(self) -> tuple[int, float]:
        return -len(self.bins), sum((1 - s / self.capacity) ** 2 for s in self.space.values())


def crossover(keeper: Solution, donor: Solution, rng: random.Random) -> Solution:
    """A copy of keeper with some of donor's well-filled bins."""
    child = keeper.copy()
    filled = sorted(donor.bins, key=donor.space.__getitem__)[: max(1, len(donor.bins) // 2)]
    given = [b for b in filled if rng.random() < 0.3] or filled[:1]
    injected = {i for b in given for i in donor.bins[b]}
    displaced: list[int] = []
    for b in [b for b, items in child.bins.items() if not injected.isdisjoint(items)]:
        displaced += (i for i in child.drop_bin(b) if i not in injected)
    for b in given:
        child.add_bin(list(donor.bins[b]))
    child.place_all(displaced)
    return child


def mutate(solution: Solution, rng: random.Random) -> None:
    """Dissolve the worst bins and a few others, and best-fit their documents."""
    worst = sorted(solution.bins, key=solution.space.__getitem__, reverse=True)[: max(2, len(solution.bins) // 20)]
    loose = [i for b in {*worst, *rng.sample(list(solution.bins), min(3, len(solution.bins)))} for i in solution.drop_bin(b)]
    solution.place_all(loose)


def evolve(sizes: list[int], capacity: int, seed: int, given: tuple = (), members: int = MEMBERS, generations: int = GENERATIONS) -> Solution:
    """The best solution of a population after the given number of generations. Deterministic. given: bins of solutions that join at the start."""
    rng = random.Random(seed)
    population = []
    for bins in given:
        new = Solution(sizes, capacity)
        for items in bins:
            new.add_bin(list(items))
        population.append(new)
    while len(population) < members:
        new = Solution(sizes, capacity)
        if population:
            order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.8, 1))
        else:
            order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
        for i in order:
            new.place(i)
        population.append(new)
    for _ in range(generations):
        population.sort(key=Solution.fitness, reverse=True)
        child = crossover(population[0], population[rng.randrange(1, len(population))], rng)
        if rng.random() < 0.5:
            child = crossover(child, population[rng.randrange(len(population))], rng)
        mutate(child, rng)
        if child.fitness() > population[-1].fitness():
            population[-1] = child
    return max(population, key=Solution.fitness)


def _bins(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


def _evolved(rows: pd.DataFrame, capacity: int, epoch: int, given: tuple[str, ...]) -> pd.DataFrame:
    """rows of one island (uid, length, block, island, and the bins of given solutions) with their bin and the island's cost."""
    rows = rows.sort_values("uid", ignore_index=True)
    seed = int(rows["block"].iat[0]) * 1009 + int(rows["island"].iat[0]) * 31 + epoch
    best = evolve(rows["length"].tolist(), capacity, seed, tuple(_bins(rows[g].to_numpy()) for g in given))
    bins, fill = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64)
    for b, items in enumerate(best.bins.values()):
        bins[items] = b
        fill[items] = sum(best.sizes[i] for i in items)
    fewest, squares = best.fitness()
    return pd.DataFrame({
        "uid": rows["uid"], "length": rows["length"], "block": rows["block"], "island": rows["island"], "bin": bins, "fill": fill,
        "cost": -fewest - squares / (1 - fewest),
    })


_EVOLVED = "uid bigint, length bigint, block bigint, island int, bin int, fill bigint, cost double"


def evolve_blocks(loose: DataFrame, capacity: int, blocks: int, turn: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(uid, length, block, bin, fill) of the best island of each block after all epochs. loose: uid, length."""
    dealt = loose.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(blocks)).cast("bigint").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    given: tuple[str, ...] = ()
    for epoch in range(epochs):
        step = (lambda e, g: lambda rows: _evolved(rows, capacity, e, g))(turn * epochs + epoch, given)
        got = stash(dealt.groupBy("block", "island").applyInPandas(step, _EVOLVED), f"epoch{epoch}")
        # The elite of each island migrates to the next one.
        guest = got.select(F.col("uid").alias("u"), F.pmod(F.col("island") + 1, F.lit(islands)).alias("i"), F.col("bin").alias("guest"))
        dealt = got.select("uid", "length", "block", "island", F.col("bin").alias("own")).join(guest, (F.col("uid") == F.col("u")) & (F.col("island") == F.col("i"))).drop("u", "i")
        given = ("own", "guest")
    best = got.groupBy("block").agg(F.min(F.struct("cost", "island")).alias("best")).select(F.col("block").alias("b"), F.col("best.island").alias("i"))
    return got.join(best, (F.col("block") == F.col("b")) & (F.col("island") == F.col("i"))).select("uid", "length", "block", "bin", "fill")


def pack(found: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """found (as of pieces, read from a written table) plus sequence_id and offset."""
    names = found.columns
    whole = found.where(F.col("length") == capacity).select(*names, F.col("uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    loose, placed = found.where(F.col("length") != capacity).select("uid", "length"), None
    for k in range(rounds):
        n = loose.count()
        blocks = max(1, math.ceil(n / block_rows))
        last = k == rounds - 1 or blocks == 1
        got = stash(evolve_blocks(loose, capacity, blocks, k), f"round{k}")
        full = F.lit(True) if last else F.col("fill") >= SETTLED * capacity
        own = Window.partitionBy("block", "bin")  # a sequence's pieces: capacity rows at most
        before = F.sum("length").over(own.orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
        settled = got.where(full).select(F.col("uid").alias("u"), F.min("uid").over(own).alias("sequence_id"), F.coalesce(before, F.lit(0)).alias("offset"))
        placed = settled if placed is None else placed.union(settled)
        if last:
            break
        loose = got.where(~full).select("uid", "length")
    return whole.union(found.join(placed, F.col("uid") == F.col("u")).select(*names, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, whole_path: str | None = None, capacity: int = CAPACITY,
                   end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Defined cases: null and empty texts are one piece, the end id alone; rows that repeat, also with one id, are packed
    each; null ids stay null; an empty table gives an empty result; other columns are ignored. Ties between bins go
    to any one of them.
    """
    import public_tokenizers

    ship(docs.sparkSession)
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole_path = whole_path or public_tokenizers.path("byte_bpe_50k.json")
    found = stash(pieces(docs, ranks_path, pattern or public_tokenizers.PATTERN, whole_path, capacity, end_id, id_col, text_col), "pieces")
    return pack(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
