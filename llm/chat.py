"""Chat formatting by token-level assembly.

Segments (role, text) are encoded separately and joined by reserved ids, so that no text can make a
marker. Control strings inside texts are escaped all the same, since the formatted text may be encoded
again by others. Loss masks are running sums of +1 where a learnt segment begins and -1 where it ends.

A turn reads ``<|turn|>role<|text|>text<|end|>``. Escaping doubles each backslash and puts one behind the
first character of each control string; reading back takes them out again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from llm.bpe import byte_bpe, vocabulary_files
from llm.common import bounded_batches, small_batches, table, text_or_empty

MARKERS = ("<|turn|>", "<|text|>", "<|end|>")
#: Control strings of this template and of others in use.
CONTROL = (*MARKERS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNT = ("assistant",)

_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turns(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learnt: tuple[str, ...] = LEARNT,
    files: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows (conv, turn, tie, ids, loss), one per turn: the ids of the formatted turn, and for each id
    whether it is learnt. A conversation is its rows in the
    order of turn (null first) and tie, which orders rows of one turn by role and text; repeated rows are
    turns of their own. Null roles and texts are empty; rows whose conversation is null make up one
    conversation. Other columns play no part."""
    bounded_batches()
    files = files or vocabulary_files()
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text")
    )
    rows = rows.select("conv", "turn", F.concat("role", F.lit("\n"), F.md5("text")).alias("tie"), "role", "text")
    schema = T.StructType(
        [
            T.StructField(conv, turns.schema[conv].dataType),
            T.StructField(turn, turns.schema[turn].dataType),
            T.StructField("tie", T.StringType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("loss", T.ArrayType(T.BooleanType())),
        ]
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*files)
        begin, middle, end = (np.array([bpe.size + i], dtype=np.int32) for i in range(len(MARKERS)))
        for batch in small_batches(batches, 4):
            parts, sizes, learnt_at = [], [], []
            at = 0
            for who, said in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                head, body = (bpe.encode(escape(x)).astype(np.int32) for x in (who, said))
                parts += [begin, head, middle, body, end]
                size = len(head) + len(body) + 3
                if who in learnt:
                    learnt_at.append((at + len(head) + 2, at + size - 1))
                sizes.append(size)
                at += size
            change = np.zeros(at + 1, dtype=np.int32)
            for first, last in learnt_at:
                change[first] += 1
                change[last] -= 1
            mask = np.cumsum(change)[:at] > 0
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *parts]))
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(bounds, ids)]
            arrays.append(pa.ListArray.from_arrays(bounds, pa.array(mask)))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(assemble, schema)


def read_turn(ids: np.ndarray, loss: np.ndarray, size: int, decode: Callable[[np.ndarray], str]) -> tuple[str, str, str, int]:
    """Role, text and learnt text of a formatted turn, and the characters it has formatted, all from its
    ids and mask."""
    begin, middle, end = (np.flatnonzero(ids == size + i) for i in range(len(MARKERS)))
    if not (len(begin) == len(middle) == len(end) == 1 and begin[0] == 0 and end[0] == len(ids) - 1):
        raise ValueError("not a formatted turn")
    role, text = decode(ids[1 : middle[0]]), decode(ids[middle[0] + 1 : -1])
    return unescape(role), unescape(text), unescape(decode(ids[loss])), len(role) + len(text) + sum(map(len, MARKERS))


def read_digests(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn", files: tuple[str, str] | None = None) -> DataFrame:
    """Digests of every conversation, read back from its formatted turns. A conversation streams through
    its task in order, so a long one needs no more memory than a short one."""
    files = files or vocabulary_files()
    kind = formatted.schema[conv].dataType
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType()]
    schema = T.StructType([T.StructField(conv, kind), *map(T.StructField, names, kinds)])
    placed = formatted.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), "tie", "ids", "loss")
    placed = placed.repartition("conv").sortWithinPartitions("conv", "turn", "tie")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(*files)
        now, state, done = None, None, []

        def closed() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * len(schema)
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            key_type = batch.column(0).type
            ids, loss = batch.column(3), batch.column(4)
            bounds = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False)
            mask = loss.values.to_numpy(zero_copy_only=False)
            keys = batch.column(0).to_pylist()
            shift = loss.offsets.to_numpy() - bounds
            for i, key in enumerate(keys):
                if state is None or key != now:
                    if state is not None:
                        done.append(closed())
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                low, high = bounds[i], bounds[i + 1]
                role, text, learnt, chars = read_turn(flat[low:high], mask[low + shift[i] : high + shift[i]], bpe.size, bpe.decode)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += chars
            if len(done) >= 1000:
                yield out()
                done.clear()
        if state is not None:
            done.append(closed())
            yield out()

    return placed.mapInArrow(read, schema)


def op9_chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_digests(format_turns(turns.unionByName(extra)))


_SQL_PATTERN = "|".join(re.sub(r"([\\|\[\]])", r"\\\1", x) for x in ("\\", *CONTROL))

OP9_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
keyed AS (
  SELECT *, role || chr(10) || md5(text) AS tie,
         length(role) + len(regexp_extract_all(role, '{_SQL_PATTERN}')) + length(text) + len(regexp_extract_all(text, '{_SQL_PATTERN}'))
         + {sum(map(len, MARKERS))} AS chars
  FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM keyed GROUP BY conv_id
"""
