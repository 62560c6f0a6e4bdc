"""Repetition inside single documents: a ledger of rules, evaluated once, that policies and ablations read.

Every rule is evaluated once a document.  Its measurements and one failure bit a rule are stored; a *policy* is a
versioned pair of bit masks, so changing one, comparing two, or asking what a rule contributes costs a bitwise
filter or aggregate over the ledger instead of another pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.text import mix, runs_of_words, word_hashes

_SENTENCE = re.compile(r"[.!?\n]\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the rules; the share rules fail at the threshold or above."""

    run: int = 5
    min_words: int = 50
    run_share: float = 0.30
    line_share: float = 0.30
    paragraph_share: float = 0.30
    sentence_share: float = 0.30
    top_phrase_share: float = 0.20
    phrase: int = 3


#: Bit of each rule in the ledger, in the order they are evaluated.
BITS = {name: 1 << i for i, name in enumerate(("few_words", "runs", "lines", "paragraphs", "sentences", "top_phrase"))}


@dataclass(frozen=True)
class Policy:
    """A document is marked if a rule of ``any_of`` fails and none of ``unless`` does."""

    name: str
    version: int
    any_of: tuple[str, ...]
    unless: tuple[str, ...] = ("few_words",)

    def masks(self) -> tuple[int, int]:
        return sum(BITS[r] for r in self.any_of), sum(BITS[r] for r in self.unless)


POLICIES = (
    Policy("repeated_runs", 1, ("runs",)),
    Policy("repeated_blocks", 1, ("lines", "paragraphs", "sentences")),
    Policy("any_repetition", 1, ("runs", "lines", "paragraphs", "sentences", "top_phrase")),
    Policy("any_repetition", 2, ("runs", "paragraphs", "sentences")),
)

LEDGER = (
    "n_words long, n_runs long, n_repeated_runs long, repeated_run_share double, repeated_line_share double, "
    "repeated_paragraph_share double, repeated_sentence_share double, top_phrase_share double, failed int"
)


def _repeated_share(parts: list[str]) -> float:
    """Share of the parts' characters that lies in parts met before; 0 if there are none."""
    total = repeated = 0
    seen = set()
    for p in parts:
        total += len(p)
        if p in seen:
            repeated += len(p)
        seen.add(p)
    return repeated / total if total else 0.0


def measure(texts: list[str | None], rules: Rules = Rules()) -> list[np.ndarray]:
    """The ledger columns (see ``LEDGER``) of a batch of texts."""
    n = len(texts)
    hashes, n_words = word_hashes(texts)
    key, of = runs_of_words(hashes, n_words, rules.run)
    n_runs = np.bincount(of, minlength=n)
    first, _ = _distinct(key, of)
    again = n_runs - np.bincount(of[first], minlength=n)
    key, of = runs_of_words(hashes, n_words, rules.phrase)
    first, times = _distinct(key, of)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of[first], times)
    at_least_1 = np.maximum(n_words, 1)
    top_share = np.where(top > 1, np.minimum(1.0, top * rules.phrase / at_least_1), 0.0)
    run_share = again / np.maximum(n_runs, 1)
    blocks = np.zeros((3, n))
    for i, t in enumerate(texts):
        if t:
            for k, parts in enumerate((t.split("\n"), _PARAGRAPH.split(t), _SENTENCE.split(t))):
                blocks[k, i] = _repeated_share([p for p in map(str.strip, parts) if p]) if len(parts) > 1 else 0.0
    fails = {
        "few_words": n_words < rules.min_words, "runs": (n_runs > 0) & (run_share >= rules.run_share), "lines": blocks[0] >= rules.line_share,
        "paragraphs": blocks[1] >= rules.paragraph_share, "sentences": blocks[2] >= rules.sentence_share, "top_phrase": top_share >= rules.top_phrase_share,
    }
    failed = sum(BITS[r] * hit.astype(np.int32) for r, hit in fails.items())
    return [n_words, n_runs, again, run_share, *blocks, top_share, failed]


def _distinct(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each different key of each text stands, and how often that key occurs in it."""
    own = mix(key + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    own = own[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    return order[new], np.diff(np.append(new, len(own)))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``(id_col, measurements, failed)`` for every row: one map over the scan, no shuffle.

    Null, empty and blank texts have no words: all shares are 0 and only ``few_words`` fails.  Whole texts are
    measured.  Rows are neither dropped nor merged; further columns are ignored; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in LEDGER.split(", "))]
    types = [pa.int64()] * 3 + [pa.float64()] * 5 + [pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = measure(batch.column(1).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types)], names)

    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{id_col} {kind}, {LEDGER}")


def marked(led: DataFrame, policy: Policy) -> DataFrame:
    """The ledger rows that a policy marks."""
    any_of, unless = policy.masks()
    return led.where((F.col("failed").bitwiseAND(any_of) != 0) & (F.col("failed").bitwiseAND(unless) == 0))


def ablations(led: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """``(policy, version, without, n_marked)``: how many documents each policy marks, with all its rules (``without``
    is '') and with each of its rules left out.  One aggregate over the ledger: it is grouped by its failure bits
    first, so what is shuffled is at most one row for each combination of bits."""
    by_bits = led.groupBy("failed").agg(F.count("*").alias("n"))
    cases = []
    for p in policies:
        any_of, unless = p.masks()
        for out in ("", *p.any_of):
            cases.append((p.name, p.version, out, any_of & ~BITS.get(out, 0), unless))
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("policy"), F.lit(b).alias("version"), F.lit(c).alias("without"), F.lit(d).alias("any_of"), F.lit(e).alias("unless")) for a, b, c, d, e in cases)))
    hit = (F.col("failed").bitwiseAND(F.col("c.any_of")) != 0) & (F.col("failed").bitwiseAND(F.col("c.unless")) == 0)
    return (
        by_bits.select("failed", "n", grid.alias("c"))
        .groupBy("c.policy", "c.version", "c.without")
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))).alias("n_marked"))
    )
