"""Phrase collocations by vertical partitioning of a word suffix tree, after ERA (Mansour et al., 2011).

The suffix that begins at each word, cut off after the longest phrase's words and at the end of its piece, is
a leaf. Suffixes are grouped by the words they begin with, so that a group's leaves fit the memory of a task:
counts per prefix are taken first, a prefix with too many leaves is lengthened by a word, and small prefixes
are put together. Each group builds its subtrees on its own, by sorting its leaves, and reads the count of
every phrase from the totals of the leaves below it. Words are compared as they are; hashes only deal them out.

Before the shuffle each task sums equal suffixes of the texts it holds, so that a frequent phrase arrives once
per task. A phrase shorter than its group's prefix has leaves in several groups, whose totals are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from llm.common import bounded_batches, grouped, small_batches, table, text_or_empty, together, written
from llm.shingles import mixed, word_hashes

LONGEST = 4
#: Phrases that occur less often are no candidates; nor can they be parts of one.
LEAST = 30
TOP = 2_000
#: A phrase goes if a longer candidate around it occurs at least this share as often.
SHARE_PERCENT = 80
#: Leaves of a group at most, as many as a task holds: about 100 MB.
LEAVES = 1_000_000
#: Prefixes are counted in this many buckets a group; no more than ``MOST_BUCKETS``, 8 MB for each length.
BUCKETS_PER_GROUP, MOST_BUCKETS = 16, 1 << 20
BLOCK = 1024
TEXT_BYTES = 4 << 20
#: Suffixes written out at once, some 2 MB.
SUFFIXES_AT_ONCE = 65_536
SALTS = 64

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8)] = True
_BLANK = _BREAK.copy()
_BLANK[[32, 9]] = True


@dataclass
class Suffixes:
    """All words of some texts in order. ``words`` holds each word and a blank, ``at`` where it begins (and,
    one more, the end); ``depth`` how many words its suffix has, ``lang`` the number of its language, ``code``
    a number of the word, ``hashes`` a hash of each code."""

    words: np.ndarray
    at: np.ndarray
    depth: np.ndarray
    lang: np.ndarray
    code: np.ndarray
    hashes: np.ndarray

    def prefix_hashes(self, lang_hashes: np.ndarray) -> Iterator[np.ndarray]:
        """For each length the hash of the language and the first words, all of them if there are fewer."""
        now = lang_hashes[self.lang]
        own = self.hashes[self.code]
        for length in range(LONGEST):
            longer = self.depth > length
            now = now.copy()
            now[longer] = mixed(now[longer] * np.uint64(0xD6E8FEB86659FD93) + own[np.flatnonzero(longer) + length])
            yield now

    def equal(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each different suffix, and how often the suffix occurs."""
        many = int(self.code.max(initial=0)) + 1
        pair = self.code + many * self.lang
        second = np.where(self.depth > 1, np.append(self.code[1:], 0) + 1, 0)
        pair = _numbers(pair.astype(np.int64) * (many + 1) + second)
        # The two halves of a suffix; the second is missing, one word, or two.
        half = np.append(pair[2:], [0, 0])[: len(pair)] + 1 + many
        third = np.append(self.code[2:], [0, 0])[: len(pair)] + 1
        rest = np.where(self.depth > 3, half, np.where(self.depth > 2, third, 0))
        _, first, counts = np.unique(pair * (int(rest.max(initial=0)) + 1) + rest, return_index=True, return_counts=True)
        return first, counts


def _numbers(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def _encoded(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word and a hash for each number."""
    column = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(words)]).dictionary_encode()
    known = column.dictionary
    if not len(known):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b"".join(known.to_pylist()), dtype=np.uint8)
    return column.indices.to_numpy().astype(np.int64), word_hashes(data, np.array([0, len(data)]))[0]


def suffixes(texts: list[bytes], langs: np.ndarray) -> Suffixes:
    """The suffixes of texts, whose languages are given by number."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    data = _SMALL[data]
    word = ~_BLANK[data]
    first, after = word.copy(), ~word
    first[1:] &= ~word[:-1]
    after[1:] &= word[:-1]
    after[:1] = False
    start, end = np.flatnonzero(first), np.flatnonzero(after)
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[start]
    last = np.searchsorted(piece, piece, side="right")
    depth = np.minimum(last - np.arange(len(start)), LONGEST)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    lang = langs[np.searchsorted(text_end, start, side="right")].astype(np.int64)
    data[end] = 32
    at = np.concatenate([[0], np.cumsum(end - start + 1)])
    words = data[word | after]
    return Suffixes(words, at, depth, lang, *_encoded(words, at))


def _slices(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[low:low + size], one slice behind the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(low - (ends - size), size)]


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of the languages, the number of each row's, and a hash of each."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw = [n.encode() for n in names]
    # One word each, as blanks in a name would make several of it.
    flat = np.frombuffer(b"".join(r.hex().encode() + b"_ " for r in raw), dtype=np.uint8)
    hashes = word_hashes(flat, np.array([0, len(flat)]))[0] if raw else np.zeros(0, dtype=np.uint64)
    return names, coded.indices.to_numpy(), hashes


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str], np.ndarray, Suffixes]]:
    """Some MB of (lang, text) at a time: as much as a task sums before the shuffle."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole():
        rows = pa.Table.from_batches(held).combine_chunks()
        names, numbers, hashes = _languages(rows.column(0).combine_chunks())
        return names, hashes, suffixes([x.as_py().encode() for x in rows.column(1)], numbers)

    for batch in batches:
        for part in small_batches(iter([batch]), 1, TEXT_BYTES):
            if size and size + part.nbytes > TEXT_BYTES:
                yield whole()
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield whole()


@dataclass
class Groups:
    """Which group a prefix belongs to. For each length, ``counts`` has the leaves of each bucket of prefixes;
    ``longest`` are the most leaves of a bucket whose prefixes aren't lengthened."""

    counts: np.ndarray
    leaves: int = LEAVES

    def __post_init__(self):
        buckets = self.counts.shape[1]
        self.limit = max(self.leaves, int(4 * self.counts[0].sum() / buckets))
        self.number, self.parts = [], []
        begin = 0
        for length, row in enumerate(self.counts):
            # Lengthened prefixes leave no leaves here, but for the last length.
            stays = np.where((row > self.limit) & (length < LONGEST - 1), 0, row)
            self.parts.append(np.maximum(-(-stays // self.leaves), 1))
            # Small buckets stand together up to a group's leaves.
            number = begin + np.cumsum(stays) // self.leaves
            self.number.append(number)
            begin = int(number[-1]) + 1

    def of(self, found: Suffixes, lang_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of each suffix and length of its prefix."""
        buckets = np.uint64(self.counts.shape[1])
        group = np.zeros(len(found.code), dtype=np.int64)
        length_of = np.full(len(found.code), LONGEST, dtype=np.int64)
        open_ = np.ones(len(found.code), dtype=bool)
        for length, hashes in enumerate(found.prefix_hashes(lang_hashes)):
            bucket = (hashes % buckets).astype(np.int64)
            here = open_ & ((self.counts[length][bucket] <= self.limit) | (length == LONGEST - 1))
            mine = bucket[here]
            part = ((hashes[here] // buckets) % self.parts[length][mine].astype(np.uint64)).astype(np.int64)
            group[here] = (self.number[length][mine] << 20) + part
            length_of[here] = length + 1
            open_ &= ~here
        return group, length_of


def _prefix_counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, DataFrame]:
    """Leaves of each bucket of prefixes, by length, and rows (lang, n) with the words of each language."""
    size = min(BLOCK, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LONGEST, buckets), dtype=np.int64)
        words: dict[str, int] = {}
        for names, lang_hashes, found in _texts(batches):
            for length, hashes in enumerate(found.prefix_hashes(lang_hashes)):
                total[length] += np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=buckets)
            for name, n in zip(names, np.bincount(found.lang, minlength=len(names)).tolist(), strict=True):
                words[name] = words.get(name, 0) + n
        blocks = total.reshape(-1, size)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None] * len(used) + list(words), pa.string()),
                pa.array([*used.tolist(), *[-1] * len(words)], pa.int64()),
                pa.array([*[blocks[i].tobytes() for i in used], *[None] * len(words)], pa.binary()),
                pa.array([*[0] * len(used), *words.values()], pa.int64()),
            ],
            names=["lang", "block", "counts", "n"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    counted = written(docs.mapInArrow(count, "lang string, block long, counts binary, n long"), "prefixes")
    summed = together(counted.filter("block >= 0").select("block", "counts"), "block").mapInArrow(add, "block long, counts binary")
    total = np.zeros((LONGEST * buckets // size, size), dtype=np.int64)
    # 8 bytes for each bucket and length, of which there are no more than MOST_BUCKETS.
    for row in summed.toLocalIterator():
        total[row.block] = np.frombuffer(row.counts, dtype=np.int64)
    return total.reshape(LONGEST, buckets), counted.filter("block < 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _blocks(found: Suffixes, first: np.ndarray, counts: np.ndarray, keys: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Suffixes sorted by their keys (group, language, prefix), one row for each key."""
    cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    bounds = [*cuts.tolist(), len(first)]
    low = found.at[first]
    size = found.at[first + found.depth[first]] - low
    data = _slices(found.words, low, size)
    ends = np.concatenate([[0], np.cumsum(size)])
    # Lines end where suffixes do; their last byte is the blank after a word.
    data[ends[1:] - 1] = 10
    rows = list(zip(bounds, bounds[1:], strict=False))
    columns = [
        pa.array(keys[0][cuts]),
        pa.array([names[i] for i in keys[1][cuts]], pa.string()),
        pa.array(keys[2][cuts].astype(np.int32)),
        pa.array([data[ends[a] : ends[b]].tobytes() for a, b in rows], pa.binary()),
        pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["group", "lang", "prefix", "leaves", "counts"])


def _leaves(docs: DataFrame, groups) -> DataFrame:
    """Rows (group, lang, prefix, leaves, counts): the suffixes that a task sums for a group, a line each, with
    their numbers as bytes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = groups.value
        for names, lang_hashes, found in _texts(batches):
            group, length = plan.of(found, lang_hashes)
            first, counts = found.equal()
            order = np.lexsort((length[first], found.lang[first], group[first]))
            first, counts = first[order], counts[order]
            keys = np.stack([group[first], found.lang[first], length[first]])
            # Few suffixes at a time, as their texts repeat each word up to four times.
            for low in range(0, len(first), SUFFIXES_AT_ONCE):
                at = slice(low, low + SUFFIXES_AT_ONCE)
                yield _blocks(found, first[at], counts[at], keys[:, at], names)

    return docs.mapInArrow(deal, "group long, lang string, prefix int, leaves binary, counts binary")


@dataclass
class Subtrees:
    """The subtrees over sorted leaves: ``lines`` are the leaves' words, ``at`` the beginnings of leaves' words,
    -1 beyond their depth; ``new`` marks at each depth the leaves with which a node begins."""

    text: np.ndarray
    begin: np.ndarray
    ends: np.ndarray
    new: np.ndarray
    counts: np.ndarray

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first leaf, total of the leaves) of each node with ``depth`` words."""
        reach = self.ends[depth - 1] > 0
        change = np.flatnonzero(self.new[depth - 1])
        if not len(change):
            return change, change
        # Leaves that end above this depth stand before the node's own and belong to none.
        totals = np.add.reduceat(np.where(reach, self.counts, 0), change)
        keep = reach[change]
        return change[keep], totals[keep]


def subtrees(leaves: bytes, counts: np.ndarray) -> Subtrees:
    """Sorts leaves by their words, so that those below a node stand together."""
    data = np.frombuffer(leaves, dtype=np.uint8)
    stop = (data == 32) | (data == 10)
    after = np.flatnonzero(stop) + 1
    words = np.where(stop, np.uint8(32), data)
    code, _ = _encoded(words, np.concatenate([[0], after]))
    line = np.concatenate([[0], np.cumsum(data[after - 1] == 10)])[:-1]
    first_word = np.searchsorted(line, np.arange(len(counts)))
    place = np.arange(len(code)) - first_word[line]
    grid = np.zeros((LONGEST, len(counts)), dtype=np.int64)
    grid[place, line] = code + 1
    ends = np.zeros((LONGEST, len(counts)), dtype=np.int64)
    ends[place, line] = after - 1
    begin = np.concatenate([[0], after])[first_word]
    order = np.lexsort(grid[::-1])
    grid, ends, begin = grid[:, order], ends[:, order], begin[order]
    new = np.ones((LONGEST, len(counts)), dtype=bool)
    new[:, 1:] = np.logical_or.accumulate(grid[:, 1:] != grid[:, :-1], axis=0)
    return Subtrees(data, begin, ends, new, counts[order])


def _counted(leaves: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f) from each group's subtrees; phrases shorter than the prefix of their group have
    one row per group."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            _, lang, prefix = (group.column(i)[0].as_py() for i in range(3))
            counts = np.frombuffer(b"".join(group.column(4).to_pylist()), dtype=np.int32).astype(np.int64)
            tree = subtrees(b"".join(group.column(3).to_pylist()), counts)
            for depth in range(1, LONGEST + 1):
                first, total = tree.nodes(depth)
                if depth >= prefix:
                    first, total = first[total >= least], total[total >= least]
                low, size = tree.begin[first], tree.ends[depth - 1][first] - tree.begin[first]
                data = _slices(tree.text, low, size)
                bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                phrases = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), phrases, pa.array([depth] * n, pa.int32()), pa.array(total)], names=["lang", "phrase", "words", "f"])

    # Rows of a group stand together by one key; language and prefix belong to it.
    keyed = leaves.select(F.concat_ws("/", "group", "prefix", "lang").alias("key"), "lang", "prefix", "leaves", "counts")
    nodes = together(keyed, "key").mapInArrow(build, "lang string, phrase string, words int, f long")
    return nodes.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, leaves: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, phrase, words, f) of all phrases of up to ``LONGEST`` words that occur ``least`` times or more,
    one blank between words, and rows (lang, n) with all words of each language. A-Z become small; phrases end
    at the marks of ``_BREAK``, line ends among them. A null language is ``und``; a null text has no words.
    Repeated rows count as often as they come; other columns play no part; an empty table gives no rows."""
    bounded_batches()
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 << int(np.clip(size // 4 // leaves * BUCKETS_PER_GROUP, 256, MOST_BUCKETS)).bit_length()
    counts, words = _prefix_counts(rows, buckets)
    groups = spark.sparkContext.broadcast(Groups(counts, leaves))
    return written(_counted(_leaves(rows, groups), least), "phrases"), written(words, "words")


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, leaves: int = LEAVES) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 4 words that
    occur ``least`` times or more, by score, then a, then phrase in the order of UTF-8 bytes. Every cut of a
    phrase into two parts with counts l and r has the score floor(2,000,000 * a / (l + r)); the lowest counts, of
    equal ones that with the shorter first part. A phrase inside a longer candidate (dropped or not) that occurs
    at least 80 percent as often is dropped. Products have 38 digits. See ``phrase_counts`` for awkward rows."""
    counts, words = phrase_counts(docs, lang, text, least, leaves)
    candidates = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))

    def part(first: Column | int, size: Column) -> Column:
        return F.array_join(F.slice(F.split("phrase", " ", -1), first, size), " ")

    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "words", "a", cut).withColumns({"head": part(F.lit(1), F.col("k")), "tail": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    cuts = cuts.withColumns({"gain": _exact(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)"), "both": _exact(F.col("l") + F.col("r"))})
    cuts = cuts.withColumn("score", F.expr("gain div both"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Parts of candidates that are candidates themselves, with the most frequent candidate around them.
    spans = [(i, n) for n in (2, 3) for i in range(1, LONGEST - n + 2)]
    parts = [F.when(F.col("words") >= max(i + n - 1, n + 1), F.array_join(F.slice(F.split("phrase", " ", -1), i, n), " ")) for i, n in spans]
    inner = candidates.filter("words > 2").select("lang", F.explode(F.array_compact(F.array(*parts))).alias("phrase"), F.col("a").alias("around"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    held = _exact(F.col("around")) * 100 >= _exact(F.col("a")) * SHARE_PERCENT
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(held, F.lit(False)))
    kept = written(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "collocations")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may hold a third of all: first the best of each share of it, then of these.
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    # One row per language.
    return ranked.join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language in all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
split AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang),
phrases AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM split, range(1, {LONGEST + 1}) AS sizes(size) WHERE len(w) >= size)),
counts AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM phrases GROUP BY ALL HAVING count(*) >= {LEAST}),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scores AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, 2000000 * c.a // (x.f + y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, size, w, a, m, unnest(range(1, size - m + 2)) AS i FROM candidates, range(2, {LONGEST}) AS parts(m) WHERE m < size)
  GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_parts p ON p.lang = best.lang AND p.phrase = best.phrase
  WHERE p.around IS NULL OR 100 * p.around < {SHARE_PERCENT} * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
