"""Quality by the perplexity of an interpolated modified Kneser-Ney model over words, by joins of counts.

The words (single characters in scripts without blanks, runs of digits, single marks) of all trusted texts
are counted as n-grams. The texts that are counted and those to be scored are put into chunks of numbered
words, which are written once. A chunk sends its different n-grams, sorted and packed, to shards told by the
word before the last: there all counts of an n-gram, of its shorter endings and of what stood before its last
word meet, and each chunk gets back the counts that its n-grams ask for, as whole numbers. The shards are
gone through in rounds and what a round shuffled is given up after it, so that the disk holds a part of the
n-grams at a time. A word before the last that is so frequent that it fills shards is dealt to several by
the last word; counts of what stood before are then sums over these.

Texts are dealt into two halves by their content. A text is scored by the model of the other half, so no
text is judged by a model that has counted it or a copy, and the limits, which are quantiles of the trusted
texts of a language, compare like with like.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridwork.session import broadcast_if_small
from gridwork.session import removed
from llm.common import bounded_batches, grouped, key_of, table, text_or_empty, written, written_at
from llm.quality import FEWEST_TEXTS, trusted_documents

ORDER = 3
#: A chunk takes texts until it holds so many words; one text is never cut.
CHUNK_WORDS = 1 << 20
#: Trusted words for each shard, and the least number of shards.
SHARD_WORDS = 1 << 20
LEAST_SHARDS = 32
#: Shards that one word before the last is dealt to at most.
MOST_PARTS = 16
#: The disk holds the n-grams of one round; each goes through all words once more.
ROUNDS = 6
#: So many words have short codes, which are sent to all tasks; the others are called by their hashes.
FREQUENT = 1 << 17
#: Words of an average text of its language that are added to each document, so that the few words of a
#: short one don't decide alone.
PRIOR_WORDS = 16
#: The limit of a language is this quantile of its trusted texts.
LIMIT_QUANTILE = 0.995
#: With fewer different trusted texts the limit is that of all texts, or the language's own if it is higher.
OWN_LIMIT_TEXTS = 100

# Thai, Lao, Burmese, Khmer, kana and Han are written without blanks.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W\d_{_UNSPACED}]+|\d+|[^\w\s]|_")
#: Numbers of the edge before a text, and of the last word where only what stands before it is asked for.
EDGE, NONE = 0, 1
#: Codes of words that have no short one.
_RARE = np.uint64(1 << 63)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def _mixed(x: np.ndarray, seed: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    """64-bit hashes of numbers that come after what gave the seed."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ (seed * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(*lists: np.ndarray) -> bytes:
    """Lists of whole numbers; of rising ones the steps. Bytes of equal weight stand together, empty ones are left out."""
    head, body = [len(lists)], []
    for x in lists:
        x = np.ascontiguousarray(x, dtype=np.uint64) if x.dtype != np.int64 else np.ascontiguousarray(x).view(np.uint64)
        rising = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        if rising:
            x = np.diff(x, prepend=np.uint64(0))
        planes = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head += [len(x), planes, rising]
        body.append(x.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())
    raw = np.array(head, dtype=np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    (n,) = np.frombuffer(raw, dtype=np.int64, count=1)
    head = np.frombuffer(raw, dtype=np.int64, count=3 * n, offset=8).reshape(-1, 3).tolist()
    at, lists = 8 + 24 * int(n), []
    for size, planes, rising in head:
        x = np.zeros((size, 8), dtype=np.uint8)
        x[:, :planes] = np.frombuffer(raw, dtype=np.uint8, count=size * planes, offset=at).reshape(planes, size).T
        at += size * planes
        x = x.reshape(-1).view(np.uint64)
        lists.append((np.cumsum(x, dtype=np.uint64) if rising else x).view(np.int64))
    return lists


class _Parts(dict):
    """The numbers of the words in what stands between blanks, which no word holds; each is cut into words once."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, part: str) -> list[int]:
        number = self.vocabulary
        words = [part] if part.isascii() and part.isalpha() else TOKEN.findall(part)
        found = self[part] = [number.setdefault(w, len(number)) for w in words]
        return found


class Chunk:
    """Texts as numbers into a vocabulary of their own."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()
        self.vocabulary: dict[str, int] = {}
        self.parts = _Parts(self.vocabulary)
        self.words: list[int] = []
        self.sizes: list[int] = []
        self.names: list[tuple[int, int]] = []

    def add(self, name: tuple[int, int], text: str) -> None:
        before = len(self.words)
        self.words.extend(chain.from_iterable(map(self.parts.__getitem__, text.lower().split())))
        self.sizes.append(len(self.words) - before)
        self.names.append(name)

    def data(self, model: tuple | None) -> bytes:
        """Marks, twins and sizes of the texts, their words, and the vocabulary, whose order the numbers have:
        hashes, or with a model the codes."""
        called = np.array([xxhash.xxh3_64_intdigest(w) for w in self.vocabulary], dtype=np.uint64)
        called = _codes(called, model) if model else called
        sort = np.argsort(called)
        number = np.empty(len(sort), dtype=np.int64)
        number[sort] = np.arange(len(sort))
        marks, twins = np.array(self.names, dtype=np.int64).reshape(-1, 2).T
        words = number[np.array(self.words, dtype=np.int64)]
        rare = len(sort) if not model else int(np.searchsorted(called[sort], _RARE))
        return packed(marks, twins, np.array(self.sizes, dtype=np.int64), words, called[sort][:rare], called[sort][rare:])


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    *lists, called, rare = unpacked(data)
    return *lists, np.concatenate([called, rare]).view(np.uint64)


def padded(numbers: np.ndarray, sizes: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, edges before each text, and the places that hold words."""
    starts = np.cumsum(sizes + order - 1) - sizes
    real = np.arange(len(numbers)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    words = np.full(len(numbers) + len(sizes) * (order - 1), EDGE, dtype=np.int64)
    words[real] = numbers
    return words, real


def chunks_of(batches: Iterator[pa.RecordBatch], distinct: bool) -> Iterator[tuple[int, Chunk]]:
    """Chunks (half, chunk) of rows (half, mark, twin, text)."""
    open_chunks = [Chunk(), Chunk()]
    for batch in batches:
        for half, mark, twin, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            chunk = open_chunks[half]
            if distinct:
                if (mark, twin) in chunk.seen:
                    continue
                chunk.seen.add((mark, twin))
            chunk.add((mark, twin), text)
            if len(chunk.words) >= CHUNK_WORDS:
                yield half, chunk
                open_chunks[half] = Chunk()
    for half, chunk in enumerate(open_chunks):
        if chunk.names:
            yield half, chunk


def _named(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (half, mark, twin, text): two hashes name a text, the first one deals the halves."""
    value = text_or_empty(text)
    mark = F.xxhash64(value)
    return docs.select(F.pmod(mark, F.lit(2)).cast("int").alias("half"), mark.alias("mark"), F.xxhash64(F.lit(7), value).alias("twin"), value.alias("text"))


_CHUNKS = "chunk long, half int, words long, data binary"


def _chunk_table(docs: DataFrame, distinct: bool, sent=None) -> DataFrame:
    """Rows (chunk, half, words, data); a chunk is named by its first text and its place in its task."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, (half, chunk) in enumerate(chunks_of(batches, distinct)):
            columns = [pa.array([base + number]), pa.array([half], pa.int32()), pa.array([len(chunk.words)]), pa.array([chunk.data(sent and sent.value)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "half", "words", "data"])

    return _named(docs).mapInArrow(fill, _CHUNKS)


@contextmanager
def _shuffles_given_up(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a job when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def count_grams(trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, str]:
    """The chunks of the trusted texts, written, and their folder. Repeated texts count each time."""
    return written_at(_chunk_table(trusted, False), "word-grams")


@dataclass
class Model:
    """Counted chunks, and how their n-grams are dealt out."""

    chunks: DataFrame
    path: str
    order: int
    #: Sorted hashes of the frequent words with their codes, and into how many parts a code's n-grams are dealt.
    hashes: np.ndarray
    codes: np.ndarray
    parts: np.ndarray
    shards: int


def kneser_ney(counted: tuple[DataFrame, str], order: int = ORDER) -> tuple[Model, dict[int, int]]:
    """The model to score by and each half's number of words. Its counts are added up shard by shard when
    texts are scored, and as each shard has the sums of its contexts nothing else need be kept."""
    chunks, path = counted
    sizes = {r.half: r.n for r in chunks.groupBy("half").agg(F.sum("words").alias("n")).collect() if r.n}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, _, words, hashes = _opened(row["data"])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(words, minlength=len(hashes)))], names=["word", "n"])

    frequent = chunks.select("data").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = frequent.orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()  # bounded
    hashes, n = frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    total = sum(sizes.values())
    shards = max(LEAST_SHARDS, min(total // SHARD_WORDS, 1 << 16))
    parts = np.ones(len(n) + 2, dtype=np.int64)
    parts[2:] = np.clip(n * shards // max(2 * total, 1), 1, min(MOST_PARTS, shards))
    sort = np.argsort(hashes)
    return Model(chunks, path, order, hashes[sort], (sort + 2).astype(np.uint64), parts, shards), sizes


def _codes(hashes: np.ndarray, model: tuple) -> np.ndarray:
    _, known, short, _, _ = model
    if not len(known):
        return hashes | _RARE
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, short[at], hashes | _RARE)


def _one_number(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each row, in the order of the rows; those in the columns are below ``size``."""
    number, span = columns[0], size
    for column in columns[1:]:
        if span * size >= 1 << 62:
            number = np.unique(number, return_inverse=True)[1]
            span = int(number.max(initial=0)) + 1
        number, span = number * size + column, span * size
    return number


def grams_of(data: bytes, model: tuple, counted: bool, only: tuple[int, int] | None = None) -> dict[str, np.ndarray]:
    """The different n-grams of a chunk: their shards, in whose order they stand, their words' codes and numbers,
    and how often each comes. With ``only`` (n, i) those whose shard leaves i when divided by n. Else also the
    place of each word's gram. Unless the chunk is counted, each context of a word that is dealt to several shards is
    asked for in all of them, with NONE as the last word."""
    order, _, _, parts, shards = model
    _, _, sizes, words, code = _opened(data)
    if counted:
        # Numbers in the order of the codes: alike grams of different chunks then pack alike.
        code = _codes(code, model)
        sort = np.argsort(code)
        number = np.empty(len(code), dtype=np.int64)
        number[sort] = np.arange(len(code))
        words, code = number[words], code[sort]
    code = np.concatenate([np.array([EDGE, NONE], dtype=np.uint64), code])
    in_parts = np.ones(len(code), dtype=np.int64)
    few = code < len(parts)
    in_parts[few] = parts[code[few].astype(np.int64)]
    home = (_mixed(code) % np.uint64(shards)).astype(np.int64)
    turn = (_mixed(code, np.uint64(1)) >> np.uint64(8)).astype(np.int64)

    line, real = padded(words + 2, sizes, order)
    before, last = line[real - 1], line[real]
    if only:
        # The round of a word before the last that is in one shard is looked up, not reckoned.
        mine = (home % only[0] == only[1])[before]
        split = np.flatnonzero((in_parts > 1)[before])
        mine[split] = (home[before[split]] + turn[last[split]] % in_parts[before[split]]) % shards % only[0] == only[1]
        chosen = real[mine]
    else:
        chosen = real
    place = None
    columns = [line[chosen - back] for back in range(order - 1, -1, -1)]
    # Those of one word before the last stand together.
    turned = [columns[-2], columns[-1], *columns[:-2]]
    if only and len(code) ** order < 1 << 62:
        number = np.sort(_one_number(turned, len(code)))
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
        n = np.diff(first, append=len(number))
        number, turned = number[first], []
        for _ in range(order):
            number, rest = np.divmod(number, len(code))
            turned.insert(0, rest)
        columns = [*turned[2:], turned[0], turned[1]]
    else:
        first, place, n = np.unique(_one_number(turned, len(code)), return_index=True, return_inverse=True, return_counts=True)[1:]
        columns = [c[first] for c in columns]
    shard = (home[columns[-2]] + turn[columns[-1]] % in_parts[columns[-2]]) % shards
    if not counted:
        split = np.flatnonzero((in_parts > 1)[before])
        if len(split):
            context = [line[real[split] - back] for back in range(order - 1, 0, -1)]
            first = np.unique(_one_number(context, len(code)), return_index=True)[1]
            context = [c[first] for c in context]
            parts_of = in_parts[context[-1]]
            part = np.arange(parts_of.sum()) - np.repeat(np.cumsum(parts_of) - parts_of, parts_of)
            there = (home[np.repeat(context[-1], parts_of)] + part) % shards
            mine = there % only[0] == only[1] if only else np.ones(len(there), dtype=bool)
            asked = [*[np.repeat(c, parts_of) for c in context], np.full(len(part), NONE)]
            columns = [np.concatenate([c, x[mine]]) for c, x in zip(columns, asked, strict=True)]
            shard, n = np.concatenate([shard, there[mine]]), np.concatenate([n, np.zeros(mine.sum(), dtype=np.int64)])
    sort = np.argsort(shard.astype(np.uint16), kind="stable")
    columns = [c[sort] for c in columns]
    if place is not None:
        at = np.empty(len(sort), dtype=np.int64)
        at[sort] = np.arange(len(sort))
        place = at[place]
    out = {"shard": shard[sort], "n": n[sort], "columns": columns, "codes": [code[c] for c in columns], "size": len(code)}
    return out | {"place": place, "split": (in_parts > 1)[columns[-2]]}


def _short(codes: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of codes with places in a list, the last one, instead of those of rare words."""
    rare = np.unique(np.concatenate([c[c >= _RARE] for c in codes]))
    base = np.uint64(FREQUENT + 2)
    return [*[np.where(c >= _RARE, base + np.searchsorted(rare, c).astype(np.uint64), c) for c in codes], rare]


def _long(lists: list[np.ndarray]) -> list[np.ndarray]:
    *columns, rare = [x.view(np.uint64) for x in lists]
    base = np.uint64(FREQUENT + 2)
    every = np.append(rare, np.uint64(0))
    return [np.where(c >= base, every[np.where(c >= base, c - base, 0).astype(np.int64)], c) for c in columns]


def _endings(codes: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the last 1, 2 and so on words."""
    keys = [_mixed(codes[-1])]
    for column in codes[-2::-1]:
        keys.append(_mixed(column, keys[-1]))
    return keys


class Counts:
    """The counts of one half in a shard. For each length above 1: the grams' hashes and counts, and their
    contexts' hashes with the sum of the counts and the number of grams that come 1, 2 and more times."""

    def __init__(self, codes: list[np.ndarray], n: np.ndarray):
        ends, contexts = _endings(codes), _endings(codes[:-1])
        self.levels: list[tuple] = []
        self.many: dict[int, np.ndarray] = {}
        rows = np.arange(len(n))
        for size in range(len(codes), 1, -1):
            keys, first, inverse = np.unique(ends[size - 1][rows], return_index=True, return_inverse=True)
            # Below the highest order a gram counts the different words before it.
            count = np.bincount(inverse, n if size == len(codes) else None, len(keys)).astype(np.int64)
            rows = rows[first]
            context, inverse = np.unique(contexts[size - 2][rows], return_inverse=True)
            kinds = [np.bincount(inverse, x, len(context)).astype(np.int64) for x in (count, count == 1, count == 2, count > 2)]
            self.levels.insert(0, (keys, count, context, kinds))
            self.many[size] = np.array([(count == k).sum() for k in (1, 2, 3, 4)])
        # Each different word before a last word counts once.
        self.words, self.n = np.unique(codes[-1][rows], return_counts=True)

    def answers(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """For each gram and each length above 1 its count and the four numbers of its context."""
        ends, contexts = _endings(codes), _endings(codes[:-1])
        out = []
        for size, (keys, count, context, kinds) in enumerate(self.levels, 2):
            for known, asked, lists in ((keys, ends[size - 1], [count]), (context, contexts[size - 2], kinds)):
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                same = known[at] == asked
                out += [np.where(same, x[at], 0) for x in lists]
            # What a sum has above its least is mostly nothing.
            out[-4] -= out[-3] + 2 * out[-2] + 3 * out[-1]
        return out


_FOUND = "chunk long, half int, shard long, kind int, data binary"
#: Kinds of rows: grams that are counted, grams that are asked for; answers, last words, numbers of grams.
COUNTED, ASKED, ANSWER, LAST, MANY = range(5)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "half", "shard", "kind", "data"])


def _dealt(chunks: DataFrame, sent, counted: bool, rounds: int, turn: int) -> DataFrame:
    """For each chunk and shard of this round one row with the chunk's grams."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            grams = grams_of(row["data"], sent.value, counted, (rounds, turn))
            cuts = np.flatnonzero(np.diff(grams["shard"], prepend=-1, append=-1)) if len(grams["shard"]) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                lists = [*([grams["n"][low:high]] if counted else []), *_short([c[low:high] for c in grams["codes"]])]
                half = row["half"] if counted else 1 - row["half"]
                yield _found([(row["chunk"], half, int(grams["shard"][low]), COUNTED if counted else ASKED, packed(*lists))])

    return chunks.mapInArrow(deal, _FOUND)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the grams of each shard and answers the chunks that ask for some, one by one."""
    for group in grouped(batches, 2):
        shard = group.column("shard")[0].as_py()
        halves, kinds, data = (group.column(x) for x in ("half", "kind", "data"))
        models: dict[int, Counts] = {}
        for half in (0, 1):
            own = [unpacked(d.as_py()) for d, h, k in zip(data, halves.to_pylist(), kinds.to_pylist(), strict=True) if h == half and k == COUNTED]
            if own:
                n = np.concatenate([x[0] for x in own])
                models[half] = Counts([np.concatenate(x) for x in zip(*[_long(x[1:]) for x in own], strict=True)], n)
                sizes = sorted(models[half].many)
                yield _found([(None, half, shard, LAST, packed(models[half].words, models[half].n)), (None, half, shard, MANY, packed(*[models[half].many[x] for x in sizes]))])
        for chunk, half, kind, d in zip(group.column("chunk").to_pylist(), halves.to_pylist(), kinds.to_pylist(), data, strict=True):
            if kind == ASKED and half in models:
                yield _found([(chunk, half, shard, ANSWER, packed(*models[half].answers(_long(unpacked(d.as_py())))))])


def _last_words(found: DataFrame) -> DataFrame:
    """Rows (half, word, n): the words' codes and how many different words stand before each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, n = unpacked(row["data"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["half"], dtype=np.int32)), pa.array(words), pa.array(n)], names=["half", "word", "n"])

    return found.filter(F.col("kind") == LAST).select("half", "data").mapInArrow(read, "half int, word long, n long").groupBy("half", "word").agg(F.sum("n").alias("n"))


def _chunk_words(chunks: DataFrame, sent, counted: bool) -> DataFrame:
    """Rows (half, word, chunk, n) of each chunk's vocabulary, for the half that counts or scores it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, _, words, code = _opened(row["data"])
            half = row["half"] if counted else 1 - row["half"]
            code = (_codes(code, sent.value) if counted else code).view(np.int64)
            columns = [np.full(len(code), half, dtype=np.int32), code, np.full(len(code), row["chunk"]), np.bincount(words, minlength=len(code))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["half", "word", "chunk", "n"])

    return chunks.mapInArrow(read, "half int, word long, chunk long, n long")


def _discounts(many: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more: the usual estimates, and where counts of counts are
    missing, as in tiny corpora, the plain one."""
    y = many[0] / (many[0] + 2 * many[1]) if many[0] else 0.5
    ratios = [(k, many[k - 1], many[k]) for k in (1, 2, 3)]
    return np.array([0.0, *[min(max(k - (k + 1) * y * above / here, 0.05), k - 0.05) if here else y for k, here, above in ratios]])


def _bits(row: dict, model: tuple, answers: dict[int, bytes], words: dict[str, np.ndarray], many: dict, unigrams: dict) -> pa.RecordBatch:
    """The bits of each text of a chunk, by the counts that its grams and words got back."""
    order, half = model[0], 1 - row["half"]
    marks, twins, sizes, numbers, code = _opened(row["data"])
    total, known, unknown = unigrams[half]
    off = _discounts(many[half, 1])
    code = code.view(np.int64)
    sort = np.argsort(words["word"])
    at = np.minimum(np.searchsorted(words["word"][sort], code), len(sort) - 1)
    n = np.where(words["word"][sort][at] == code, words["n"][sort][at], 0) if len(sort) else np.zeros(len(code), dtype=np.int64)
    share = np.where(n > 0, (n - off[np.minimum(n, 3)]) / total, 0.0) + unknown
    chance = share[numbers] if len(numbers) else np.zeros(0)
    if order > 1:
        grams = grams_of(row["data"], model, False)
        found = np.zeros((5 * (order - 1), len(grams["n"])), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(grams["shard"], prepend=-1, append=-1)) if len(grams["n"]) else [0]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if (data := answers.get(int(grams["shard"][low]))) is not None:
                found[:, low:high] = unpacked(data)
        if grams["split"].any():
            # Each part has the numbers of a context that come from its own last words.
            context = _one_number(grams["columns"][:-1], grams["size"])
            asked = grams["columns"][-1] == NONE
            keys, inverse = np.unique(context[asked], return_inverse=True)
            split = np.flatnonzero(grams["split"] & ~asked)
            at = np.searchsorted(keys, context[split])
            for i in range(len(found)):
                if i % 5:
                    found[i, split] = np.bincount(inverse, found[i, asked], len(keys)).astype(np.int64)[at]
        for size in range(2, order + 1):
            count, whole, *kinds = (x[grams["place"]] for x in found[5 * (size - 2) : 5 * (size - 1)])
            off = _discounts(many[half, size])
            whole = whole + kinds[0] + 2 * kinds[1] + 3 * kinds[2]
            seen = whole > 0
            whole = np.where(seen, whole, 1)
            left = np.where(seen, sum(d * x for d, x in zip(off[1:], kinds, strict=True)) / whole, 1.0)
            chance = np.where(count > 0, (count - off[np.minimum(count, 3)]) / whole, 0.0) + left * chance
    bits = np.array([x.sum() for x in np.split(-np.log2(chance), np.cumsum(sizes)[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(marks), pa.array(twins), pa.array(sizes), pa.array(bits)], names=["mark", "twin", "n_words", "bits"])


def scored_texts(docs: DataFrame, model: Model, sizes: dict[int, int], order: int = ORDER) -> DataFrame:
    """Rows (mark, twin, n_words, bits), written, one for each different text, by the model of the other half."""
    spark = docs.sparkSession
    plain = (order, model.hashes, model.codes, model.parts, model.shards)
    sent = spark.sparkContext.broadcast(plain)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_given_up(spark):
        chunks, path = written_at(_chunk_table(docs, True, sent), "word-chunks")
        folders, parts = [path], []
        for turn in range(ROUNDS if order > 1 else 0):
            # One plan reads the two tables and shuffles both once.
            both = _dealt(model.chunks, sent, True, ROUNDS, turn).unionByName(_dealt(chunks, sent, False, ROUNDS, turn))
            here = both.repartition(min(tasks, -(-model.shards // ROUNDS)), "shard").sortWithinPartitions("shard")
            part, folder = written_at(here.mapInArrow(_met, _FOUND), "word-counts")
            parts.append(part)
            folders.append(folder)
            spark.sparkContext._jvm.System.gc()  # shuffles whose job has ended go with their last reference
        if order > 1:
            found = parts[0]
            for part in parts[1:]:
                found = found.unionByName(part)
            last = _last_words(found)
        else:
            found = None
            last = _chunk_words(model.chunks, sent, True).groupBy("half", "word").agg(F.sum("n").alias("n"))
        last, folder = written_at(last, "last-words")
        folders.append(folder)
        removed(spark, model.path)

        many: dict[tuple[int, int], np.ndarray] = {}
        unigrams = {}
        counts = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        for r in last.groupBy("half").agg(F.sum("n").alias("total"), F.count("*").alias("grams"), *counts).collect():  # two rows
            many[r.half, 1] = np.array([r[f"n{k}"] for k in (1, 2, 3, 4)])
            off = _discounts(many[r.half, 1])
            more = r.grams - many[r.half, 1][:2].sum()
            # What is left is spread evenly over the known words and one for all others.
            unigrams[r.half] = (r.total, r.grams, float((off[1] * r.n1 + off[2] * r.n2 + off[3] * more) / r.total / (r.grams + 1)))
        if found is not None:
            for r in found.filter(F.col("kind") == MANY).select("half", "data").toLocalIterator():  # four numbers a length and shard
                for size, n in enumerate(unpacked(bytes(r.data)), 2):
                    many[r.half, size] = many.get((r.half, size), 0) + n

        names = ["chunk", "half", "shard", "kind", "data", "word", "n"]
        no_word = [F.lit(None).cast("long").alias(x) for x in ("word", "n")]
        no_data = [F.lit(None).cast("long").alias("shard"), F.lit(LAST).alias("kind"), F.lit(None).cast("binary").alias("data")]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in grouped(batches):
                kind = group.column("kind").to_numpy()
                own = group.filter(pa.array(kind == ASKED)).to_pylist()
                answers = {r["shard"]: r["data"] for r in group.filter(pa.array(kind == ANSWER)).select(["shard", "data"]).to_pylist()}
                few = group.filter(pa.array(kind == LAST))
                words = {x: few.column(x).to_numpy() for x in ("word", "n")}
                for row in own:
                    yield _bits(row, sent.value, answers, words, many, unigrams)

        scores = []
        for turn in range(ROUNDS):
            mine = F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == turn
            these = chunks.filter(mine)
            rows = these.select("chunk", "half", F.lit(None).cast("long").alias("shard"), F.lit(ASKED).alias("kind"), "data", *no_word)
            if found is not None:
                rows = rows.unionByName(found.filter(F.col("kind") == ANSWER).filter(mine).select("chunk", "half", "shard", "kind", "data", *no_word))
            words = _chunk_words(these, sent, False).drop("n").join(last, ["half", "word"]).select("chunk", "half", *no_data, "word", "n")
            rows = rows.unionByName(words).select(*names).repartition(tasks, "chunk").sortWithinPartitions("chunk")
            scores.append(written(rows.mapInArrow(score, "mark long, twin long, n_words long, bits double"), "chunk-bits"))
        answers = scores[0]
        for more in scores[1:]:
            answers = answers.unionByName(more)
        out = written(answers.groupBy("mark", "twin").agg(F.min("n_words").alias("n_words"), F.min("bits").alias("bits")), "word-bits")
        for folder in folders:
            removed(spark, folder)
    return out


def _smooth(usual: Column) -> Column:
    return (F.col("bits") + PRIOR_WORDS * usual) / (F.col("n_words") + PRIOR_WORDS)


def language_limits(scored: DataFrame) -> DataFrame:
    """From (lang_key, mark, twin, n_words, bits) of the trusted texts rows (lang_key, usual, top): for each
    language, null included, and for all together (lang_key ``all``) the mean bits a word and the limit."""
    # Languages are never called so: their keys begin with v, or are n.
    both = scored.unionByName(scored.withColumn("lang_key", F.lit("all"))).distinct()
    usual = both.groupBy("lang_key").agg((F.sum("bits") / F.greatest(F.sum("n_words"), F.lit(1))).alias("usual"), F.count("*").alias("texts"))
    smooth = both.join(broadcast_if_small(usual), "lang_key").withColumn("x", _smooth(F.col("usual")))
    cuts = smooth.groupBy("lang_key", "usual", "texts").agg(F.percentile_approx("x", LIMIT_QUANTILE, 100_000).alias("own"))
    cuts = written(cuts, "limits")
    every = cuts.filter("lang_key = 'all'").first()  # one row, or none without trusted words
    top = F.when(F.col("texts") >= OWN_LIMIT_TEXTS, F.col("own")).otherwise(F.greatest("own", F.lit(every and every.own)))
    return cuts.select("lang_key", "usual", top.alias("top"))


def with_quality(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """Adds a struct ``q`` to every row (an input column of that name gives way): n_words, bits_per_word
    (smoothed), perplexity, top and kept. Null texts are empty, and texts without words are kept. A language
    without trusted texts has the limit of all. With fewer than FEWEST_TEXTS different trusted texts, or all
    of them in one half, there is no model: numbers but n_words are null and everything is kept. Repeated
    rows and copies are judged alike; other columns stay."""
    bounded_batches()
    own = [c for c in docs.columns if c.lower() != "q"]
    value = text_or_empty("text")
    name = [F.xxhash64(value).alias("mark"), F.xxhash64(F.lit(7), value).alias("twin"), key_of("lang").alias("lang_key")]
    rows = docs.select(F.struct(*own).alias("row"), *name)
    trusted = trusted_documents(docs, labels).filter(F.octet_length("text") > 0)
    halves = [r["n"] for r in trusted.select(*name).groupBy(F.pmod("mark", F.lit(2))).agg(F.countDistinct("mark").alias("n")).collect()]
    sizes: dict[int, int] = {}
    if len(halves) == 2 and sum(halves) >= FEWEST_TEXTS:
        with _shuffles_given_up(docs.sparkSession):
            model, sizes = kneser_ney(count_grams(trusted, order), order)
    if len(sizes) < 2:
        none = F.lit(None).cast("double")
        size = F.udf(lambda text: len(tokens(text)), "long")(value)
        q = F.struct(size.alias("n_words"), *[none.alias(x) for x in ("bits_per_word", "perplexity", "top")], F.lit(True).alias("kept"))
        return docs.select(*own, q.alias("q"))
    scores = scored_texts(docs, model, sizes, order)
    limits = language_limits(written(trusted.select(*name).distinct().join(scores, ["mark", "twin"]).filter("n_words > 0"), "trusted-bits"))
    every = limits.filter("lang_key = 'all'").first()
    judged = rows.join(scores, ["mark", "twin"]).join(broadcast_if_small(limits), "lang_key", "left")
    judged = judged.fillna({"usual": every.usual, "top": every.top}).withColumn("b", _smooth(F.col("usual")))
    kept = (F.col("n_words") == 0) | (F.col("b") <= F.col("top"))
    q = F.struct("n_words", F.col("b").alias("bits_per_word"), F.pow(F.lit(2.0), "b").alias("perplexity"), "top", kept.alias("kept"))
    return judged.select(*[F.col("row")[c].alias(c) for c in own], q.alias("q"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text keeps to its language's limit."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "lang", "text")
    return with_quality(whole, labels).filter("q.kept").select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and whether its language's limit lets it pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return with_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "q.*")
