"""Texts packed into containers of fixed capacity (problem 6).

Harmonic packing. A text's size is its number of tokens of a public tokenizer. Sizes in (C/(k+1), C/k] form class k,
and a bin of class k takes exactly k texts, so each worker fills the bins of its own rows without knowing any other
row: no shuffle, no sort, no global number. Each worker keeps one open bin for each class at most.

The bins of the classes leave room over. Texts of C/CLASSES and less, for which the method keeps a last class without
a fixed number, are first put into that room, the largest first, each where the least room is left that fits, and
then into bins of their own. They are placed when a worker has read WINDOW rows; its open bins and rooms are carried
over to the next rows. At the end its unfilled bins, at most one a class, are merged best-fit.

A text longer than the capacity, and only such a text, is split: all pieces but the last fill a container each, and
the last piece is packed like a text of its size.

Defined results: a null text gives no row; an empty text has size 0, is placed, and takes no room; equal texts are
packed each on their own; an empty table gives an empty result. Containers are numbered by the partition of the input
and a running number, so that a task that runs again gives the same numbers.
"""

from __future__ import annotations

import base64
import bisect
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.session import ship

CAPACITY = 4096
CLASSES = 6
#: Rows a worker reads before it places the small texts it holds; bounds its memory, not its rows.
WINDOW = 200_000
VOCABULARY = "byte_bpe_50k.tiktoken"
OUT = "container_id long, doc_id long, piece int, start_token int, n_tokens int"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary lies on the driver: TOKENIZER_DIR, the installed package, or /opt/tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    for folder in (os.environ.get("TOKENIZER_DIR"), os.path.dirname(spec.origin) if spec and spec.origin else None, "/opt/tokenizers"):
        if folder and os.path.exists(path := os.path.join(folder, name)):
            return path
    raise FileNotFoundError(name)


# Fixed value: the pre-tokenizer of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_ENCODER: dict = {}


def encoder(path: str):
    """One tokenizer for each worker process."""
    if path not in _ENCODER:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODER[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODER[path]


def token_counts(texts, path: str) -> list[int]:
    enc = encoder(path)
    return [len(enc.encode_ordinary(t)) for t in texts]


class Packer:
    """Fills containers with the items of one worker."""

    def __init__(self, capacity: int, classes: int = CLASSES):
        self.capacity, self.classes, self.small = capacity, classes, capacity // classes
        self.next = 0
        self.open: dict[int, list] = {}  # class -> [container, items, room]
        self.rooms: list[tuple[int, int]] = []  # (room, container) of closed bins, by room
        self.held: list[tuple[int, tuple]] = []
        self.out: list[tuple] = []
        self.last: int | None = None  # where a text without tokens may lie

    def put(self, container: int, item: tuple, size: int) -> None:
        self.out.append((container, *item, size))
        self.last = container

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def keep_room(self, room: int, container: int) -> None:
        if room > 0:
            bisect.insort(self.rooms, (room, container))

    def add(self, item: tuple, size: int) -> None:
        """item: (doc_id, piece, start_token)."""
        if size <= self.small:
            self.held.append((size, item))
        elif size == self.capacity:
            self.put(self.new(), item, size)
        else:
            k = self.capacity // size
            if k not in self.open:
                self.open[k] = [self.new(), 0, self.capacity]
            bin_ = self.open[k]
            self.put(bin_[0], item, size)
            bin_[1] += 1
            bin_[2] -= size
            if bin_[1] == k:
                self.keep_room(bin_[2], bin_[0])
                del self.open[k]

    def best_fit(self, size: int) -> int | None:
        """The container with the least room that fits, taken out of the table; its new room is kept."""
        i = bisect.bisect_left(self.rooms, (size, -1))
        if i == len(self.rooms):
            return None
        room, container = self.rooms.pop(i)
        self.keep_room(room - size, container)
        return container

    def fill(self) -> None:
        """Put the small items held into the rooms, the largest first, and what does not fit into containers of its own."""
        for size, item in sorted(self.held, key=lambda x: (-x[0], x[1])):
            c = self.best_fit(size) if size else self.last
            if c is None:
                c = self.new()
                self.keep_room(self.capacity - size, c)
            self.put(c, item, size)
        self.held = []

    def close(self) -> None:
        """Merge the unfilled bins, then fill."""
        unfilled = {b[0] for b in self.open.values()}
        loose = sorted((i for i, row in enumerate(self.out) if row[0] in unfilled), key=lambda i: -self.out[i][4])
        spare = sorted(unfilled)
        for i in loose:
            c = self.best_fit(self.out[i][4])
            if c is None:
                c = spare.pop(0) if spare else self.new()
                self.keep_room(self.capacity - self.out[i][4], c)
            self.out[i] = (c, *self.out[i][1:])
        self.last = self.out[-1][0] if self.out else None
        self.fill()
        self.open, self.rooms = {}, []

    def ready(self) -> list[tuple]:
        """What was put, but for the few items of the open bins, which may still move."""
        unfilled = {b[0] for b in self.open.values()}
        done = [r for r in self.out if r[0] not in unfilled]
        self.out = [r for r in self.out if r[0] in unfilled]
        self.last = None if self.last in unfilled else self.last
        return done

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(df: DataFrame, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, classes: int = CLASSES, window: int = WINDOW) -> DataFrame:
    """(container_id, doc_id, piece, start_token, n_tokens): where each text, or piece of an over-long one, is put."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ship(df.sparkSession)
    given = vocabulary or vocabulary_path()
    df.sparkSession.sparkContext.addFile(given)  # the vocabulary goes with the job
    name = os.path.basename(given)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = SparkFiles.get(name)
        base = TaskContext.get().partitionId() << 36
        packer, seen = Packer(capacity, max(1, min(classes, capacity))), 0
        frame = lambda rows: pd.DataFrame([(base + r[0], *r[1:]) for r in rows], columns=["container_id", "doc_id", "piece", "start_token", "n_tokens"])
        for b in batches:
            for i, n in zip(b["doc_id"].tolist(), token_counts(b["text"], path)):
                full = (n - 1) // capacity if n else 0
                for p in range(full):
                    packer.add((i, p, p * capacity), capacity)
                packer.add((i, full, full * capacity), n - full * capacity)
            seen += len(b)
            if seen >= window:
                packer.fill()
                seen = 0
                yield frame(packer.ready())
        packer.close()
        yield frame(packer.take())

    return df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, OUT)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_items, used, unused) of each container."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, the containers that all tokens would fill at least, and the share of room used."""
    c = containers(packed, capacity)
    total = F.coalesce(F.sum("used"), F.lit(0))
    return c.agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"), F.count("*").alias("n_containers"), F.ceil(total / capacity).alias("least_containers"), (total / (F.nullif(F.count("*"), F.lit(0)) * capacity)).alias("used_share"))
