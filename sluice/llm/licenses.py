"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import sliced

#: The phrases that every scan must find, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases, as words.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause license": "bsd-3-clause",
    "bsd 2 clause license": "bsd-2-clause",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier\s*:[ \t]*", re.I)
_END = re.compile(r"[\r\n#]|\*/|-->")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: How much a license of each family asks of those who reuse the text; other names count as UNKNOWN.
DEMANDS = {
    0.2: ("mit", "apache", "bsd", "0bsd", "isc", "zlib", "unlicense", "cc0", "public-domain", "cc-by"),
    0.5: ("lgpl", "mpl", "epl", "cddl"),
    0.8: ("gpl", "agpl", "cc-by-sa"),
    1.0: ("cc-by-nc", "cc-by-nd", "all-rights-reserved"),
}
UNKNOWN = 0.6


def label_of(identifier: str) -> str:
    """An identifier's label: lower case, without "or later", a Creative Commons version or a closing ".0"."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    return re.sub(r"\.0$", "", re.sub(r"^(cc-by(?:-nc)?(?:-sa|-nd)?)-[0-9].*$", r"\1", name))


@lru_cache(4096)
def demand(label: str) -> float:
    """The value of the longest family name that the label begins with."""
    found = [(len(f), value) for value, families in DEMANDS.items() for f in families if label == f or label.startswith(f + "-")]
    return max(found)[1] if found else UNKNOWN


def evaluate(expression: str, beginning: bool = False) -> tuple[frozenset[str], float]:
    """Labels of an expression and its demand: the choice of OR takes the lesser, AND the greater, and an exception
    after WITH softens strong terms to 0.5. Raises ValueError where the expression is malformed; with ``beginning``, the
    longest run of its first words that isn't malformed is read, and it raises only where there is none."""
    values: list[tuple[set[str], float]] = []
    operators: list[str] = []

    def reduce() -> None:
        operator = operators.pop()
        (b, y), (a, x) = values.pop(), values.pop()
        if operator == "with":
            if len(a) != 1 or len(b) != 1:
                raise ValueError("an exception belongs to one license")
            values.append(({f"{min(a)}-with-{min(b)}"}, min(x, 0.5)))
        else:
            if len(a) < len(b):
                a, b = b, a
            a |= b  # the smaller goes into the greater, so that long expressions stay cheap
            values.append((a, min(x, y) if operator == "or" else max(x, y)))

    wants_value, at, depth, whole = True, 0, 0, 0
    text = expression.strip()
    try:
        while at < len(text):
            token = _TOKEN.match(text, at)
            if not token:
                raise ValueError("odd character")
            at, word = token.end(), token[1]
            operator = word.lower() if word.lower() in PRECEDENCE else None
            if (word == "(" or not operator and word != ")") != wants_value:
                raise ValueError("operator and operand out of turn")
            if word == "(":
                operators.append("(")
                depth += 1
            elif operator:
                while operators and operators[-1] != "(" and PRECEDENCE[operators[-1]] >= PRECEDENCE[operator]:
                    reduce()
                operators.append(operator)
                wants_value = True
            else:
                if word == ")":
                    if not depth:
                        raise ValueError("unbalanced")
                    while operators[-1] != "(":
                        reduce()
                    operators.pop()
                    depth -= 1
                else:
                    label = label_of(word)
                    values.append(({label}, demand(label)))
                    wants_value = False
                if operators and operators[-1] == "with":  # nothing binds closer
                    reduce()
                if not depth and (at == len(text) or text[at].isspace()):
                    whole = at
        if whole < len(text):
            raise ValueError("unfinished")
    except ValueError:
        if beginning and whole:
            return evaluate(text[:whole])
        raise
    while operators:
        reduce()
    if len(values) != 1:
        raise ValueError("empty")
    return frozenset(values[0][0]), values[0][1]


def tagged(text: str) -> list[tuple[frozenset[str], float]]:
    """The findings of identifier tags. An expression ends with its line, a comment's end, the next tag or, if that leaves it
    malformed, with the longest beginning that can be read; one that can't be read at all is "unknown"."""
    found = []
    tags = list(_TAGGED.finditer(text))
    for i, tag in enumerate(tags):
        limit = tags[i + 1].start() if i + 1 < len(tags) else len(text)
        end = _END.search(text, tag.end(), limit)
        words = text[tag.end() : end.start() if end else limit].rstrip(" \t.;,").split()
        try:
            found.append(evaluate(" ".join(words), beginning=True))
        except ValueError:
            found.append((frozenset({"unknown"}), UNKNOWN))
    return found


#: A-Z to lower case; what isn't a letter, digit or beyond ASCII to a blank. Bytes beyond ASCII are word bytes in UTF-8.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    machine.make_automaton()
    return machine


def scan_text(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    words = text.encode().translate(_FOLD).split()
    line = b" " + b" ".join(words) + b" "
    starts, base, labels, score, tag = [], set(), set(), 0.0, False
    for end, (length, label, is_base) in _automaton().iter(line.decode("latin-1")):
        if is_base:
            starts.append(end - length + 1)
            base.add(label)
        if label:
            labels.add(label)
            score = max(score, demand(label))
        else:
            tag = True
    if tag:
        for more, value in tagged(text):
            labels |= more
            score = max(score, value)
    first = last = None
    if starts:  # a phrase's place is that of the blank before it
        first, last = (line.count(b" ", 0, at + 1) - 1 for at in (min(starts), max(starts)))
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the scan's columns in place of ``text``, one row for each row.

    n_words, n_base (places of base phrases, overlapping ones too), first_word and last_word (their smallest and
    largest start; null without any), base_labels, labels (base, notices and tags; distinct, sorted, comma-joined,
    empty without any) and score (the greatest demand found, 0 without any). Null text counts as empty. Other columns
    pass through, those named as the scan's columns are replaced; rows are independent of each other.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [scan_text(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            found = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            columns = [*batch.columns[:-1], *found]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    kept = [f for f in docs.schema.fields if f.name not in (text, *names)]
    inner = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(text).cast("string").alias("text"))
    kinds = [*(f.dataType.simpleString() for f in kept), *["long"] * 4, "string", "string", "double"]
    return inner.mapInArrow(run, ", ".join(f"c{i} {t}" for i, t in enumerate(kinds))).toDF(*[f.name for f in kept], *names)


def op2(docs: DataFrame) -> DataFrame:
    return license_scan(docs.select("doc_id", "text"))
