"""Noise in text from scanned pages: named, and repaired into continuous paragraphs.

Learned from the whole table: the vocabulary with its counts, and skip-gram vectors of its words (the factorised
point-wise mutual information of words and the frequent words around them, which is what skip-gram training with
negative samples converges to).  A rare word is linked to frequent words that differ from it by plausible glyph edits;
where an edit also makes letters of letters, the context's vectors decide whether, and to which word, it is
corrected.  Then running lines and page numbers are removed, divided words joined and the lines reflowed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.buckets import binary, payloads, whole_runs
from quernel.plans.lineage import cut, release


KINDS = ("hyphen", "glyph", "header", "page")
# Glyphs that recognition confuses; those of one line are read for one another.
_TWO = (("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"))
_ONE = {"é": "c", "è": "c", "ë": "c", "e": "c", "@": "a", "0": "o", "ï": "i", "l": "i", "1": "i", "|": "i", "†": "t", "5": "s", "#": "s", "$": "s", "h": "b", "q": "g", "y": "v", "€": "c"}
_CANONICAL = str.maketrans(_ONE)
_FREE_DIGITS = re.compile(r"(?<!\S)\d+(?!\S)")
_HARD = frozenset(c for c in _ONE if not (c.isascii() and c.isalpha()))

_WORD = re.compile(r"[^\W_]+(?:[-’'@†|#$€][^\W_]+|[@†|#$€])*|[@†|#$€]+[^\W_]+(?:[-’'@†|#$€][^\W_]+|[@†|#$€])*")
_BROKEN = re.compile(r"(?<=[^\W\d_])([-‐‑¬­])[ \t\r\x0c]*\n[ \t]*(?=[^\W\d_])")
_LETTERS = re.compile(r"[^\W\d_]+")
_BARE = re.compile(r"[ \t]*\d{1,4}[ \t\r\x0c]*")
_MARKED = re.compile(
    r"\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|(?:p|pp|s|pág|page|seite|página)\.?\s*\d{1,4}(?:\s*(?:of|/|von|de|sur)\s*\d{1,4})?|\d{1,4}\s*(?:/|of|von|de|sur)\s*\d{1,4})\s*", re.IGNORECASE
)
_LIST = re.compile(r"\s*(?:[-*•]\s|\d{1,3}[.)]\s|\||#|>|```|--\s)")
_SENTENCE_END = re.compile(r"[.!?:;,…]\s*$")
# Numerals above 399 do not number pages.
_NUMERAL = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_ROMAN = re.compile(rf"\s*(?:{_NUMERAL}|(?:[-–—]\s*{_NUMERAL}\s*[-–—]|\[\s*{_NUMERAL}\s*\]|\(\s*{_NUMERAL}\s*\)))\s*", re.IGNORECASE)
_ROMAN_VALUE = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


@dataclass(frozen=True)
class Settings:
    """A word that occurs ``known_least`` times is vocabulary and has a vector, whatever the table's size and however
    many there are.  ``contexts``: frequent words that vectors are learned from; ``dim``: their length; ``window``: words to either side.  ``rarer``: a word linked to another must be this many
    times rarer; ``rarer_hard``: the same if it holds a digit or sign where a letter should be; ``support``: least mean
    affinity with the context for edits that make letters of letters."""

    known_least: int = 5
    rarer_hard: float = 8.0
    contexts: int = 128
    dim: int = 32
    window: int = 3
    rarer: float = 50.0
    support: float = 0.0
    header: int = 80


@dataclass
class Model:
    count: dict[str, int]
    place: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    rarer: float = 50.0
    rarer_hard: float = 8.0

    def __post_init__(self):
        self.longest = max(map(len, self.count), default=0)
        self.by_shape: dict[str, list[str]] = {}
        for w in self.count:
            if len(w) > 2 and w.isalpha():
                self.by_shape.setdefault(_shape(w), []).append(w)
        # An error made often enough to be vocabulary is still far rarer than the word it stands for.
        self.misread = frozenset(w for w, n in self.count.items() if max((self.count[x] for x in self.by_shape.get(_shape(w), ())), default=0) >= self.far(w) * n)

    def far(self, word: str) -> float:
        """How many times as frequent the word must be that a word was misread from."""
        return self.rarer_hard if _is_hard(word) else self.rarer

    def suspect(self, word: str) -> bool:
        """Whether a word may be a misread one: outside the vocabulary, with the shape of a word in it."""
        return (word not in self.count or word in self.misread) and 3 <= len(word) <= self.longest + 2 and _shape(word) in self.by_shape

    def affinity(self, word: str, around: list[str]) -> float | None:
        """Mean affinity of a word with the context words around it; None if none of them is one."""
        i = self.place.get(word)
        c = [j for w in around if (j := self.place.get(w, 1 << 30)) < len(self.contexts)]
        return float((self.contexts[c] @ self.vectors[i]).mean()) if c and i is not None else None


def _is_hard(word: str) -> bool:
    """Whether a word holds a digit or a sign among its letters."""
    return any(c in _HARD and c not in "éèë" for c in word) and any(map(str.isalpha, word))


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def learn(df: DataFrame, text_col: str = "text", how: Settings = Settings()) -> Model:
    """Vocabulary and skip-gram vectors of all texts.  What is collected is the vocabulary, all of it, and ``dim`` values
    for each word that another may be misread from; counts of words beside each other stay in tables."""

    def words_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n.update(tokens(t))
            if len(n) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])
                n = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    texts = df.select(F.col(text_col).cast("string").alias("t")).where("t is not null")
    counts = texts.mapInArrow(words_, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= how.known_least).toArrow()
    order = sorted(zip(rows["w"].to_pylist(), rows["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    count = {w: n for w, n in order if len(w) > 1 or w.isalpha()}
    place = {w: i for i, w in enumerate(count)}
    v, c = len(place), min(how.contexts, len(place))
    if not v:
        return Model(count, rarer=how.rarer, rarer_hard=how.rarer_hard)
    dense = min(v, 5_000)  # a task counts the most frequent words in a matrix and the others by their keys

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dense * c, np.int64)
        held, size = [], 0

        def rows_(cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cell // c), pa.array(cell % c), pa.array(n)], ["word", "context", "n"])

        for batch in batches:
            # every text's words as places, with a gap of the window's width between texts
            gap = ("",) * how.window
            ids = np.fromiter((place.get(w, -1) for t in batch.column(0).to_pylist() for w in (*tokens(t), *gap)), np.int64)
            for d in range(1, how.window + 1):
                a, b = ids[:-d], ids[d:]
                for x, y in ((a, b), (b, a)):
                    ok = (x >= 0) & (y >= 0) & (y < c)
                    cell = x[ok] * c + y[ok]
                    often = cell < dense * c
                    total += np.bincount(cell[often], minlength=dense * c)
                    held.append(cell[~often])
                    size += len(held[-1])
            if size > 2_000_000:
                yield rows_(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        at = np.flatnonzero(total)
        yield rows_(at, total[at])
        if size:
            yield rows_(*np.unique(np.concatenate(held), return_counts=True))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, context, n in whole_runs(batches, lambda b: [x.to_numpy() for x in b.columns], 100_000):
            own, at = np.unique(word, return_inverse=True)
            for lo in range(0, len(own), 10_000):
                part = (at >= lo) & (at < lo + 10_000)
                m = np.zeros((min(10_000, len(own) - lo), c), np.int64)
                np.add.at(m, (at[part] - lo, context[part]), n[part])
                yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + 10_000]), binary(m)], ["word", "line"])

    met = texts.mapInArrow(pairs, "word long, context long, n long")
    table = cut(met.repartition("word").sortWithinPartitions("word").mapInArrow(lines, "word long, line binary"))  # a row a word

    def summed(value: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
        """The sum of what ``value`` makes of the lines of a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [value(payloads(b.column(1), 8 * c).view(np.int64)) for b in batches if b.num_rows]
            if total:
                yield pa.RecordBatch.from_arrays([binary(np.sum(total, axis=0).reshape(1, -1))], ["total"])

        found = table.mapInArrow(run, "total binary").collect()
        return np.sum([np.frombuffer(r.total, kind) for r in sorted(found, key=lambda r: bytes(r.total))] or [np.zeros(1, kind)], axis=0)

    beside = summed(lambda n: n.sum(axis=0), np.int64)
    power = beside**0.75 / max(1.0, (beside**0.75).sum())

    def pmi(n: np.ndarray) -> np.ndarray:
        return np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) * power + 0.5))

    # the right singular vectors of the words' lines are the eigenvectors of their products' sum
    products = np.broadcast_to(summed(lambda n: pmi(n).T @ pmi(n), np.float64), c * c).reshape(c, c)
    axes = np.linalg.eigh(products)[1][:, ::-1][:, : min(how.dim, v, c)]
    # a word less frequent than this is none that another was misread from, so that its vector is never asked for
    asked = max(c, sum(n >= min(how.rarer, how.rarer_hard) for n in count.values()))

    def vectors_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (pmi(payloads(b.column(1), 8 * c).view(np.int64)) @ axes).astype(np.float32) if b.num_rows else np.zeros((0, axes.shape[1]), np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), binary(x)], ["word", "vector"])

    got = table.where(F.col("word") < asked).mapInArrow(vectors_, "word long, vector binary").toArrow()
    release(table)
    vectors = np.zeros((asked, axes.shape[1]), np.float32)
    if got.num_rows:
        vectors[got["word"].to_numpy()] = np.frombuffer(b"".join(got["vector"].to_pylist()), np.float32).reshape(got.num_rows, -1)
    return Model(count, {w: i for w, i in place.items() if i < asked}, vectors, axes, how.rarer, how.rarer_hard)


def _shape(line: str) -> str:
    """A word or line in which confusable glyphs are one, without blanks, marks and free-standing digits: what is
    read and what was printed agree."""
    s = line.lower()
    if " " in s or s.isdigit():
        s = _FREE_DIGITS.sub("", s)
    for a, b in _TWO:
        if a in s:
            s = s.replace(a, b)
    s = s.translate(_CANONICAL)
    return s if s.isalpha() else "".join(c for c in s if c.isalpha())


def printed(word: str, around: list[str], model: Model, how: Settings) -> str | None:
    """The frequent word that a rare one was misread from, or None.  ``word`` is in lower case."""
    if len(word) < 3 or len(word) > model.longest + 2 or not any(c.isalpha() for c in word):
        return None
    near = model.by_shape.get(_shape(word))
    if not near:
        return None
    own, hard, far = model.count.get(word, 0), _is_hard(word), model.far(word)
    best, top = None, -1e9
    for w in near:
        if w != word and model.count[w] >= far * max(own, 1):
            fit = model.affinity(w, around)
            if hard or (fit is not None and fit > how.support) or (fit is None and len(w) > 4):
                score = fit if fit is not None else 0.0
                if score > top:
                    best, top = w, score
    return best


def _roman(line: str) -> tuple[int, bool] | None:
    """The Roman numeral that is all of a line, and whether dashes or brackets mark it; None if there is none."""
    n = line.strip("-–—[]() \t\r\x0c")
    if not _ROMAN.fullmatch(line) or not (n.islower() or n.isupper()):
        return None
    v = [_ROMAN_VALUE[c] for c in n.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0])), line.strip() != n


def _roman_pages(lines: list[str], full: list[int]) -> set[int]:
    """The lines that are page numbers in Roman numerals: apart from each other, and where a single letter
    without a mark is one, with a lesser before or a greater one after it."""
    found = {i: n for i in full if len(lines[i]) < 40 and (n := _roman(lines[i]))}
    if not found or len(full) < 2:
        return set()
    place = {i: k for k, i in enumerate(full)}
    apart = [i for i in found if not any(0 <= k < len(full) and full[k] in found for k in (place[i] - 1, place[i] + 1))]
    values = [found[i][0] for i in apart]
    rises = [any(x < v for x in values[:k]) or any(x > v for x in values[k + 1 :]) for k, v in enumerate(values)]
    return {i for i, up in zip(apart, rises) if up or found[i][1] or len(lines[i].strip()) > 1}


def _unspaced(line: str) -> str:
    """The line without letter-spacing."""
    if line[1:2] != " " or max(map(len, line.split()), default=0) > 1:
        return line
    return re.sub(r"(?<=\S) (?=\S)", "", line)


def _abbreviated(line: str) -> bool:
    """Whether the stop at the line's end is that of 'et al.', misread or not."""
    last = [_shape(w) for w in _unspaced(line).split()[-2:]]
    return last == ["ct", "ai"]


def furniture(lines: list[str], how: Settings) -> tuple[dict[int, str], set[str]]:
    """The lines that are page furniture (``page`` or ``header``), and the kinds found."""
    out: dict[int, str] = {}
    kinds: set[str] = set()
    full = [i for i, line in enumerate(lines) if line.strip()]
    bare = {i for i in full if _BARE.fullmatch(lines[i])}
    for k, i in enumerate(full):
        if _MARKED.fullmatch(lines[i]):
            out[i] = "page"
        elif i in bare:
            near = [full[j] for j in (k - 1, k + 1) if 0 <= j < len(full)]
            if not any(j in bare for j in near) and len(full) > 1:
                out[i] = "page"
    for i in _roman_pages(lines, full):
        out[i] = "page"
    groups: dict[str, list[int]] = {}
    for i in full:
        s = lines[i].strip()
        if i not in out and i not in bare and 4 <= len(_unspaced(s)) <= how.header and not _LIST.match(lines[i]):
            shape = _shape(s)
            if len(shape) >= 4:
                groups.setdefault(shape, []).append(i)
    place = {i: k for k, i in enumerate(full)}

    def breaks(i: int) -> bool:
        """Whether a line stands at a page break: beside a page number or form feed, or inside a sentence."""
        before, after = (full[k] if 0 <= k < len(full) else None for k in (place[i] - 1, place[i] + 1))
        if "\x0c" in lines[i] or any(j is not None and (out.get(j) == "page" or "\x0c" in lines[j]) for j in (before, after)):
            return True
        return before is not None and after is not None and not _SENTENCE_END.search(lines[before]) and lines[after].lstrip()[:1].islower()

    for at in groups.values():
        ended = [i for i in at if _SENTENCE_END.search(lines[i]) and not _abbreviated(lines[i].strip())]
        if len(at) > 1 and (not ended or 2 * sum(map(breaks, ended)) > len(ended)):
            kinds.add("header")
            numbers = [re.findall(r"\d+", lines[i]) for i in at]
            ends = [(n[0] if n else None, n[-1] if n else None) for n in numbers]
            if all(numbers) and (len({e[0] for e in ends}) > 1 or len({e[1] for e in ends}) > 1):
                kinds.add("page")
            for i in at:
                out[i] = "header"
    if "page" in out.values():
        kinds.add("page")
    return out, kinds


def _undivided(left: str, mark: str, right: str, model: Model) -> bool:
    """Whether a word was divided over a line end; false where the hyphen is the word's own."""
    if mark == "-":
        own = model.count.get(f"{left}-{right}".lower(), 0)
        if own and own >= model.count.get((left + right).lower(), 0):
            return False
        if right[0].isupper() and not left.isupper():
            return False
    return True


def _joined(text: str, model: Model) -> tuple[str, bool]:
    """The text with words at line ends in one piece, and whether a divided one was among them."""
    out, at, divided = [], 0, False
    for m in _BROKEN.finditer(text):
        a = m.start()
        while a > at and text[a - 1].isalpha():
            a -= 1
        whole = _undivided(text[a : m.start()], m[1], _LETTERS.match(text, m.end())[0], model)
        divided |= whole
        out += [text[at : m.start()], "" if whole else m[1]]
        at = m.end()
    return "".join([*out, text[at:]]), divided


def repair(text: str | None, model: Model, how: Settings = Settings()) -> tuple[str | None, set[str]]:
    """The text in continuous paragraphs without its scan noise, and the kinds of noise found."""
    if not text or not text.strip():
        return text, set()
    lines = text.split("\n")
    gone, kinds = furniture(lines, how)
    kept: list[str] = []
    for i, line in enumerate(lines):
        if i not in gone:
            kept.append(line)
        elif kept and not kept[-1].strip() and i + 1 < len(lines) and not lines[i + 1].strip():
            kept.append("\0")  # a page break between blank lines: the paragraph may go on
    body = re.sub(r"\n\s*\n?\0\n\s*\n?", "\n", "\n".join(kept)).replace("\0", "")

    body, divided = _joined(body, model)
    if divided:
        kinds.add("hyphen")
    pieces, at = [], 0
    suspects = {w for w in set(tokens(body)) if model.suspect(w)}
    words = [(m.start(), m.end(), m[0], m[0].lower()) for m in _WORD.finditer(body)] if suspects else []
    for k, (a, b, w, low) in enumerate(words):
        if low not in suspects:
            continue
        found = printed(low, [x[3] for x in words[max(0, k - how.window) : k] + words[k + 1 : k + 1 + how.window]], model, how)
        if found:
            kinds.add("glyph")
            pieces += [body[at:a], found.upper() if w.isupper() and len(w) > 1 else found.capitalize() if w[0].isupper() else found]
            at = b
    body = "".join([*pieces, body[at:]])
    for i in gone:  # misread running lines are glyph noise as well
        if gone[i] == "header" and "glyph" not in kinds:
            near = [w.lower() for w in _WORD.findall(lines[i])]
            if any(model.suspect(w) and printed(w, near, model, how) for w in near):
                kinds.add("glyph")
    return _reflowed(body), kinds


def _reflowed(text: str) -> str:
    """Lines of one paragraph joined: a line goes on where it is neither short for its block nor a list or code."""
    out: list[str] = []
    for block in re.split(r"\n[ \t\r\x0c]*\n", text):
        lines = [x.strip(" \t\r\x0c") for x in block.split("\n")]
        lines = [x for x in lines if x]
        if not lines:
            continue
        if "```" in block:
            out.append("\n".join(lines))
            continue
        joined = lines[0]
        for line in lines[1:]:
            joined += ("\n" if _LIST.match(line + " ") or _BARE.fullmatch(line) else " ") + line
        out.append(joined)
    flowing: list[str] = []
    for block in out:  # a paragraph that a page break cut in two
        if flowing and flowing[-1][-1].isalpha() and block[0].islower():
            flowing[-1] += " " + block
        else:
            flowing.append(block)
    return "\n\n".join(flowing)


def _mapped(df: DataFrame, id_col: str, text_col: str, model: Model | None, how: Settings, row, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model or learn(df, text_col, how))  # grows with the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            done = [repair(t, m, how) for t in batch.column(1).to_pylist()]
            yield row(batch.column(0), done)

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, schema)


def found(df: DataFrame, id_col: str = "id", text_col: str = "text", how: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """``(id_col, noise)``, one row for each kind of noise found in a text.

    Null, empty and blank texts have none.  Rows repeated under one id count once.  Whole texts are read.  Further
    columns are ignored; an empty table gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def row(ids: pa.Array, done: list) -> pa.RecordBatch:
        at = [(i, k) for i, (_, kinds) in enumerate(done) for k in sorted(kinds)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in at], pa.int32())), pa.array([k for _, k in at], pa.string())], [id_col, "noise"])

    return _mapped(df, id_col, text_col, model, how, row, f"{id_col} {kind}, noise string").distinct()


def repaired(df: DataFrame, id_col: str = "id", text_col: str = "text", how: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """``(id_col, text, noise array<string>)``: every row's text repaired; null and blank texts stay as they are."""
    kind = df.schema[id_col].dataType.simpleString()

    def row(ids: pa.Array, done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([t for t, _ in done], pa.string()), pa.array([sorted(k) for _, k in done], pa.list_(pa.string()))], [id_col, "text", "noise"])

    return _mapped(df, id_col, text_col, model, how, row, f"{id_col} {kind}, text string, noise array<string>")
