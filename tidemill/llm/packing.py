"""Packing token sequences: bounded-space best fit per partition, and a merge of what stays open."""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import groups_of, tidy
from tidemill.plans.session import work_dir

LENGTH = 1024
# Windows that a partition keeps open, also after a merge.
OPEN = 64
# Partitions whose open windows meet in one group.
FAN_IN = 16
# Parts of texts whose ids a task remembers, about 70 MB.
REMEMBERED = 400_000
# Bytes of text that are split at a time.
STEP = 1 << 20


class WordIds:
    """Token ids of texts, by a tokenizer that is asked once for each part that recurs.

    A byte-level tokenizer splits before every space that a non-space follows and around single line
    breaks, whatever stands elsewhere; so texts whose white space is single spaces and line breaks are
    split there, many texts at a time, and their distinct parts looked up. Others, and those that hold one of the
    tokenizer's added tokens, are given to it whole.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # white space other than single spaces and line breaks between words
        odd = r"[\x01\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
        self.whole = "|".join([rf"(?-m:{odd})", *[re.escape(t) for t in added if t]])
        (self.line_break,) = self.encode(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(REMEMBERED + 1, np.int64)
        self.append(["\n"], np.array([self.line_break], np.uint32), np.array([1]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered parts one after the other, and where each part ends."""
        size = self.starts[at + 1] - self.starts[at]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.ids[np.repeat(self.starts[at] - (end - size), size) + np.arange(total)], end

    def append(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        k, n = len(self.number), len(parts)
        first = self.starts[k]
        while k + n >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
        while first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[first : first + len(ids)] = ids
        self.starts[k + 1 : k + n + 1] = first + ends
        self.number.update(zip(parts, range(k, k + n)))

    def learn(self, parts: list[str]) -> None:
        """Remember new parts; they are tokenized many at a time, with line breaks between them."""
        lines = ["\n".join(parts[k : k + 256]) + "\n" for k in range(0, len(parts), 256)]
        ids = np.fromiter(chain.from_iterable(self.encode(lines)), np.uint32)
        breaks = np.flatnonzero(ids == self.line_break)
        self.append(parts, ids[ids != self.line_break], breaks - np.arange(len(breaks)))

    def by_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts one after the other, and where each text ends."""
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\x01\n\x01"), " ", "\x01 ")
        split = pc.split_pattern(marked, "\x01")
        cut = split.offsets.to_numpy()
        parts = split.flatten().dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        number = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            number[missing] = np.arange(len(missing)) + len(self.number)
            self.learn([distinct[k] for k in missing])
        ids, end = self.gather(number[parts.indices.to_numpy()])
        return ids, np.concatenate([[0], end])[cut[1:]]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none is null) one after the other, and where each text ends."""
        if len(self.number) > REMEMBERED:
            self.forget()
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0, bool)
        odd |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        some, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        plain, ends = self.by_parts(texts.take(pa.array(some))) if len(some) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not len(rest):
            return plain, ends
        whole = self.encode(texts.take(pa.array(rest)).to_pylist())
        size = np.zeros(len(texts), np.int64)
        size[some], size[rest] = np.diff(ends, prepend=0), [len(x) for x in whole]
        end = np.cumsum(size)
        out = np.zeros(int(end[-1]), np.uint32)
        mine = np.repeat(odd, size)
        out[~mine] = plain
        out[mine] = np.fromiter(chain.from_iterable(whole), np.uint32)
        return out, end


_loaded: dict[int, WordIds] = {}


def word_ids(content: str) -> WordIds:
    """The worker's tokenizer."""
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = WordIds(content)
    return _loaded[key]


class Windows:
    """Open windows by free space; pieces go where the least space is left over."""

    def __init__(self, length: int):
        self.length = length
        self.open: list[tuple[int, int]] = []  # (free, window), sorted
        self.pieces: dict[int, list] = {}
        self.made = 0

    def place(self, size: int, piece) -> int | None:
        """Put a piece into the fullest window that has room; the window, if that fills it. None: no room."""
        at = bisect_left(self.open, (size, -1))
        if at == len(self.open):
            return None
        free, window = self.open.pop(at)
        self.pieces[window].append((self.length - free, piece))
        if free == size:
            return window
        insort(self.open, (free - size, window))
        return -1

    def start(self, size: int, piece) -> int:
        window = self.made
        self.made += 1
        self.pieces[window] = [(0, piece)]
        if size < self.length:
            insort(self.open, (self.length - size, window))
        return window

    def fullest(self) -> int:
        return self.open.pop(0)[1]

    def close(self, window: int) -> list:
        return self.pieces.pop(window)


NAMES = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open", "part"]
TYPES = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]


class _Rows:
    """Pieces collected into record batches."""

    def __init__(self, key_type: pa.DataType, part: int, level: int = 0):
        self.types = [key_type, *TYPES[1:]]
        self.part, self.level, self.rows, self.count = part, level, [], 0

    def add(self, window: list, is_open: bool) -> None:
        number = self.level << 58 | self.part << 32 | self.count
        self.count += 1
        for offset, (key, start, ids, tokens) in window:
            self.rows.append((key, start, len(ids) // 4, ids, tokens, number, offset, is_open, self.part))

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.types)], names=NAMES)
            self.rows = []


def ranges(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes; a longer text has a range of its own."""
    part = np.cumsum(sizes) // size
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]]) if len(sizes) else [0]
    yield from zip(cuts, cuts[1:])


def _pack(content, length: int, end: int, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokenize documents and pack them, keeping a fixed number of windows open."""
        encode = word_ids(content.value)
        rows, windows = _Rows(key_type, TaskContext.get().partitionId()), Windows(length)
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").fill_null("")
            sizes = pc.binary_length(texts).to_numpy()
            for a, b in ranges(sizes, STEP):
                ids, ends = encode(texts.slice(a, b - a))
                # every document is closed by the end id
                data = np.insert(ids, ends, end).astype("<u4").tobytes()
                ends = (ends + np.arange(1, b - a + 1)).tolist()
                for key, first, last in zip(keys[a:b], [0, *ends], ends):
                    tokens = last - first
                    full = tokens // length * length
                    for s in range(0, full, length):
                        rows.add([(0, (key, s, data[4 * (first + s) : 4 * (first + s + length)], tokens))], False)
                    if full < tokens:
                        size, piece = tokens - full, (key, full, data[4 * (first + full) : 4 * last], tokens)
                        filled = windows.place(size, piece)
                        if filled is None:
                            if len(windows.open) >= OPEN:
                                rows.add(windows.close(windows.fullest()), False)
                            windows.start(size, piece)
                        elif filled >= 0:
                            rows.add(windows.close(filled), False)
                yield from rows.take(1000)
        encode.forget()  # the worker may go on to other work
        for _, window in list(windows.open):
            rows.add(windows.close(window), True)
        yield from rows.take()

    return run


def _merge(length: int, key_type: pa.DataType, last: bool, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pack the open pieces of some partitions anew, longest first; all but a few windows are closed."""
        for group in groups_of(batches, ["part"]):
            part = group.column("part")[0].as_py()
            rows, windows = _Rows(key_type, part, level), Windows(length)
            for piece in zip(*(group.column(n).to_pylist() for n in ("key", "start", "ids", "doc_tokens"))):
                size = len(piece[2]) // 4
                filled = windows.place(size, piece)
                if filled is None:
                    windows.start(size, piece)
                elif filled >= 0:
                    rows.add(windows.close(filled), False)
            while len(windows.open) > (0 if last else OPEN):
                rows.add(windows.close(windows.fullest()), False)
            for _, window in list(windows.open):
                rows.add(windows.close(window), True)
            yield from rows.take()

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens: (key, start, length, ids, doc_tokens,
    sequence_id, offset).

    ``tokenizer`` is the content of a tokenizer file; ``end`` closes each document (a null or empty text is that id
    alone). Whole windows are cut from the front of long documents; the rest of each goes, uncut, to the
    open window that it fills best. If it fits nowhere and the limit of open windows is reached, the fullest is
    closed. What stays open in all partitions is packed again in groups of partitions, then in groups of groups,
    so no task sees more than a fixed number of windows. ``ids`` are little-endian unsigned 32-bit numbers.
    Rows with equal keys are documents of their own. Other columns are dropped. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    key_type = to_arrow_type(kind)
    schema = f"key {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, part long"
    content = spark.sparkContext.broadcast(tokenizer)

    def written(rows: DataFrame) -> DataFrame:
        path = work_dir(spark, "packed")
        # ids are small numbers in four bytes
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    level = written(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(tidy(_pack(content, length, end, key_type)), schema))
    parts = (level.where("open").agg(F.max("part")).first()[0] or 0) + 1
    done = level.where("NOT open")
    step = 0
    while True:
        step += 1
        parts = -(-parts // FAN_IN)
        groups = level.where("open").withColumn("part", F.pmod("part", F.lit(parts)))
        dealt = groups.repartition(parts, "part").sortWithinPartitions("part", F.col("length").desc(), "key", "start")
        level = written(dealt.mapInArrow(_merge(length, key_type, parts == 1, step), schema))
        done = done.unionByName(level.where("NOT open"))
        if parts == 1:
            break
    return done.drop("open", "part").withColumnRenamed("key", key)
