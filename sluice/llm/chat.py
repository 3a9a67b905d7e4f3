"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the assistant's turns are
intersected with the tokens' spans by binary search. Control strings are tokens of their own, added to the vocabulary, so
that no token crosses a turn's edge; inside texts they are escaped reversibly. The text under the mask is what its tokens decode to.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bpe_core import merger
from sluice.llm.common import sliced

#: The template: an assistant's turn is <s>text</s>, any other [INST]role, line break, text[/INST].
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
ESCAPE = "\x1b"
#: ESCAPE itself, the control strings and, in roles, the line break become ESCAPE and a letter.
CODES = {s: ESCAPE + chr(97 + i) for i, s in enumerate((ESCAPE, *CONTROL, "\n"))}
_BACK = {code: s for s, code in CODES.items()}
_IN_TEXT = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_IN_ROLE = re.compile("|".join(map(re.escape, CODES)))
_CODE = re.compile(ESCAPE + "[a-z]")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\](.*?)\n(.*?)\[/INST\]", re.S)
SCORED_ROLE = "assistant"
MASK = ("first", "last")
#: Characters that are encoded in one call of the library.
BATCH_CHARS = 250_000


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: CODES[m[0]], text)


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _BACK[m[0]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans, in code points, of its scored texts."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        inner = escape(text)
        if role == SCORED_ROLE:
            whole = f"<s>{inner}</s>"
            spans.append((at + 3, at + 3 + len(inner)))
        else:
            whole = f"[INST]{escape(role, role=True)}\n{inner}[/INST]"
        parts.append(whole)
        at += len(whole)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(SCORED_ROLE, unescape(m[1])) if m[1] is not None else (unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) for each span that isn't empty: the tokens that meet it, last excluded. Both lists are sorted, so both
    ends are found by binary search. Tokens that share the bytes of one character share its span. Raises where a token crosses a span's edge."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    out = []
    for a, b in spans:
        if a < b:
            first, last = bisect_right(ends, a), bisect_left(starts, b)
            if first >= last or starts[first] != a or ends[last - 1] != b:
                raise ValueError("a token crosses a turn's edge")
            out.append((first, last))
    return out


def masked_text(ids: list[int], mask: list[tuple[int, int]], token_bytes: list[bytes]) -> str:
    """What the tokens under a loss mask decode to, unescaped."""
    return "".join(unescape(b"".join(map(token_bytes.__getitem__, ids[a:b])).decode()) for a, b in mask)


@lru_cache(2)
def tokenizer(path: str):
    """The vocabulary of ``path`` with the template's control strings as added tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in CONTROL])
    return found


def format_chats(conversations: DataFrame, path: str) -> DataFrame:
    """One row for each conversation: conv_id, formatted, ids (array of int), mask (array of struct of first, last: see
    ``loss_mask``).

    Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own. Null role and
    null text count as empty. A row without conv_id is a conversation of its own, with a null id. Rows are dealt by conv_id
    and sorted by Spark, and conversations stream through each task one after the other: memory holds one at a time
    and the batch being encoded. An empty table gives an empty result; further columns are ignored.
    """
    schema = "conv_id long, formatted string, ids array<int>, mask array<struct<first:int,last:int>>"
    kind = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.struct([(c, pa.int32()) for c in MASK])))])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
        current, held = None, []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (conv != current or conv is None):
                    yield current, held
                    held = []
                current = conv
                held.append((role or "", text or ""))
        if held:
            yield current, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = tokenizer(path)

        def encoded(waiting: list) -> pa.RecordBatch:
            codes = library.encode_batch([formatted for _, formatted, _ in waiting], add_special_tokens=False)
            rows = [{"conv_id": c, "formatted": f, "ids": e.ids, "mask": [dict(zip(MASK, m, strict=True)) for m in loss_mask(e.offsets, spans)]} for (c, f, spans), e in zip(waiting, codes, strict=True)]
            return pa.RecordBatch.from_pylist(rows, schema=kind)

        waiting, size = [], 0
        for conv, held in turns(batches):
            waiting.append((conv, *render(held)))
            size += len(waiting[-1][1])
            if size >= BATCH_CHARS:
                yield encoded(waiting)
                waiting, size = [], 0
        if waiting:
            yield encoded(waiting)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    dealt = rows.repartition("conv_id", lone).sortWithinPartitions(*order).select("conv_id", "role", "text")
    return dealt.mapInArrow(run, schema)


def digests(chats: DataFrame, path: str) -> DataFrame:
    """What can be read back from the output of ``format_chats``: turns from the formatted text, and the loss text from the tokens under the mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = merger(path).token_bytes
        for batch in sliced(batches):
            rows = []
            for conv, formatted, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(formatted)
                loss = masked_text(ids, [tuple(m.values()) for m in mask], token_bytes)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)

    return chats.select("conv_id", "formatted", "ids", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9(conversations: DataFrame, path: str) -> DataFrame:
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digests(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(extra), path), path)


def _escaped_sql(column: str, role: bool = False) -> str:
    sql = f"coalesce({column}, '')"
    for s, code in CODES.items():
        if s != "\n" or role:
            literal = "chr(27)" if s == ESCAPE else "chr(10)" if s == "\n" else "'" + s + "'"
            sql = f"replace({sql}, {literal}, chr(27) || '{code[1]}')"
    return sql


ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN 7 + length({_escaped_sql("text")})
       ELSE 14 + length({_escaped_sql("role", True)}) + length({_escaped_sql("text")}) END) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id, lone
"""
