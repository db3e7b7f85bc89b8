"""Problem 8: the whole corpus as ids of a public byte-level BPE tokenizer.

The corpus' most frequent words are compiled with their ids into a minimal acyclic transducer: an
automaton that shares prefixes and suffixes and whose arcs carry numbers that add up to a
word's place in the table of ids.  It is one flat file, sent to the executors once and
memory-mapped by every worker.  Words it does not know are merged exactly by the tokenizer's
ranks, so the lexicon's size changes the speed and never the ids.

Null and empty texts have the empty list.  Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, tokenizer_dir

#: Fixed value: the public pattern that splits text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "byte_bpe_50k.tiktoken"

#: Most words in the lexicon, which bounds what the driver gathers; all others are merged.
LEXICON_WORDS = 50_000

#: Longer words are never lexicon entries.
LEXICON_BYTES = 64

_MAGIC = b"PWTRAN01"


class Ranks:
    """The merge ranks, and exact merging of one word."""

    def __init__(self, folder: str) -> None:
        import regex

        self.split = regex.compile(PATTERN).findall
        with open(os.path.join(folder, RANKS), "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word.  Pairs wait in a heap, so very long words take n log n steps."""
        import heapq

        rank = self.rank
        if (whole := rank.get(word)) is not None:
            return [whole]
        n = len(word)
        piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if piece[i] is not None else n
            if j >= n or piece[i] + piece[j] != pair:
                continue  # one side has been merged since
            piece[i], piece[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(pair + piece[k])) is not None:
                    heapq.heappush(heap, (r, i, pair + piece[k]))
            if (h := before[i]) >= 0 and (r := rank.get(piece[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, piece[h] + pair))
        return [rank[p] for p in piece if p is not None]


def compile_transducer(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of ``entries``, as the flat file that workers map.

    Words come in sorted order; a state is closed as soon as no further word can pass it, and
    is replaced by an equal one if there is any (same arcs, same finality), which makes the
    automaton minimal at every step.  Arc numbers count the words that sort before.
    """
    words = sorted(w for w in entries if w)
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    register: dict[tuple, int] = {}
    open_path: list[list] = [[False, []]]  # [final, closed arcs] along the current word
    last = b""

    def close(depth: int) -> None:
        while len(open_path) > depth + 1:
            final, arcs = open_path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            open_path[-1][1].append((last[len(open_path) - 1], register[key]))

    for word in words:
        common = len(os.path.commonprefix((last, word)))
        close(common)
        open_path.extend([False, []] for _ in range(len(word) - common))
        open_path[-1][0] = True
        last = word
    close(0)
    root = len(states)
    states.append((open_path[0][0], tuple(open_path[0][1])))

    reach = [0] * len(states)  # words from a state on; targets are always numbered lower
    keys, targets, adds = [], [], []
    for s, (final, arcs) in enumerate(states):
        total = int(final)
        for byte, to in arcs:
            keys.append(s << 8 | byte)
            targets.append(to)
            adds.append(total)
            total += reach[to]
        reach[s] = total
    ids = [entries[w] for w in words]
    flat = np.fromiter((i for x in ids for i in x), np.int32)
    parts = [
        np.array(keys, np.int64), np.array(targets, np.int32), np.array(adds, np.int32),
        np.array([f for f, _ in states], np.int32), np.cumsum([0, *map(len, ids)]).astype(np.int32), flat,
    ]
    return b"".join([_MAGIC + struct.pack("<7q", root, *map(len, parts)), *(p.tobytes() for p in parts)])


class Transducer:
    """A memory-mapped transducer."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            head = f.read(64)
        if head[:8] != _MAGIC:
            raise ValueError(f"{path} is no transducer")
        root, *sizes = struct.unpack("<7q", head[8:])
        self.root, at, parts = root, 64, []
        for n, kind in zip(sizes, (np.int64, *[np.int32] * 5), strict=True):
            parts.append(np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind))
            at += n * np.dtype(kind).itemsize
        self.keys, self.targets, self.adds, self.final, self.ends, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon or -1; all words step through the automaton together."""
        place = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return place
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length) - length
        text = np.frombuffer(b"".join(words), np.uint8)
        who = np.flatnonzero((length > 0) & (length <= LEXICON_BYTES))
        state, total, step = np.full(len(who), self.root, np.int64), np.zeros(len(who), np.int64), 0
        while len(who):
            key = state << 8 | text[begin[who] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[at] == key
            who, at = who[go], at[go]
            state, total = self.targets[at].astype(np.int64), total[go] + self.adds[at]
            step += 1
            done = length[who] == step
            ok = done & (self.final[state] == 1)
            place[who[ok]] = total[ok]
            who, state, total = who[~done], state[~done], total[~done]
        return place

    def output(self, place: int) -> np.ndarray:
        return self.ids[self.ends[place] : self.ends[place + 1]]


class Encoder:
    """Encodes batches of texts; one per worker."""

    def __init__(self, lexicon: str, folder: str) -> None:
        self.lexicon, self.ranks = Transducer(lexicon), Ranks(folder)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts)."""
        number: dict[str, int] = {}
        of: list[int] = []
        ends = [0]
        for t in texts:
            if t:
                of += [number.setdefault(w, len(number)) for w in self.ranks.split(t)]
            ends.append(len(of))
        words = [w.encode("utf-8", "replace") for w in number]
        places = self.lexicon.places(words)
        outputs = [self.lexicon.output(p) if p >= 0 else np.array(self.ranks.merge(w), np.int32) for w, p in zip(words, places, strict=True)]
        sizes = np.fromiter(map(len, outputs), np.int64, len(outputs))
        flat = np.concatenate(outputs) if outputs else np.empty(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        use = np.array(of, np.int64)
        n = sizes[use] if len(use) else np.empty(0, np.int64)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        ids = flat[np.repeat(starts[use] - total[:-1], n) + np.arange(total[-1])] if len(use) else np.empty(0, np.int32)
        return ids.astype(np.int32), total[np.array(ends)]


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(name: str, folder: str) -> Encoder:
    if (name, folder) not in _encoders:
        _encoders[name, folder] = Encoder(name if os.path.isabs(name) else SparkFiles.get(name), folder)
    return _encoders[name, folder]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over the whole corpus, counted within partitions before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, counts = regex.compile(PATTERN).findall, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "replace") for w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    counts.update(split(t))
            if len(counts) > 200_000:
                yield out()
                counts.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, words: int = LEXICON_WORDS, folder: str | None = None) -> str:
    """Compile the corpus' ``words`` most frequent words into one file for all executors; gives its place.

    The file goes to the shared folder of checkpoints and is removed when the application ends.  Workers map it there;
    where that is no local path for them, Spark distributes it and the place is its name among Spark's files.
    """
    spark, ranks = docs.sparkSession, Ranks(folder or tokenizer_dir())
    top = word_counts(docs).where((F.col("n") > 1) & (F.length("word") <= LEXICON_BYTES)).orderBy(F.desc("n"), "word").limit(words).select("word").collect()
    content = compile_transducer({bytes(r.word): ranks.merge(bytes(r.word)) for r in top})
    sc, name = spark.sparkContext, f"lexicon-{uuid.uuid4().hex}.bin"
    path = sc._jvm.org.apache.hadoop.fs.Path(shared_folder(spark), name)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = files.create(path)
    for at in range(0, len(content), 1 << 20):
        out.write(bytearray(content[at : at + (1 << 20)]))
    out.close()
    files.deleteOnExit(path)
    if files.getUri().getScheme() == "file":
        return path.toUri().getPath()
    sc.addFile(path.toString())
    return name


def encoded(docs: DataFrame, folder: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""
    folder, name = folder or tokenizer_dir(), lexicon(docs, words, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ends = _encoder(name, folder)(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def token_sizes(docs: DataFrame, keep: list[str], folder: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """``keep`` columns of every document with its number of tokens as ``n_tokens``."""
    folder, name = folder or tokenizer_dir(), lexicon(docs, words, folder)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, ends = _encoder(name, folder)(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(ends))], names=[*keep, "n_tokens"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def decoded(ids: list[int], folder: str | None = None) -> str:
    """The text of a list of ids, for round trips."""
    back = {i: b for b, i in Ranks(folder or tokenizer_dir()).rank.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")
