"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, letters that look like Latin ones, digits and signs that stand
for letters), cut into words, and matched by an Aho-Corasick automaton. Lexicon entries are words and word
beginnings that labelled toxic documents share; their weights are log odds. A match inside an exception
phrase, one that is mostly found in harmless documents or that the caller gives, does not count. The
weights found, and the same by the text's length, go through a logistic function fitted on the labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import fold, slices, staged, text_or_empty, worker_state
from .text_stats import training_labels

TRAINING_ROWS = 100_000  # labelled rows that the fit reads at most
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that may become entries
MOST_ENTRIES = 20_000  # of the lexicon, and of the exception phrases: those found most often
LEAST_DOCS, LEAST_PRECISION, CHANCE = 5, 0.9, 1e-8

# fixed values: letters that look like Latin ones, and digits that stand for letters ("l" and "1" join "i")
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "ё": "e", "ғ": "f", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ı": "i", "ӏ": "l", "ј": "j",
    "к": "k", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "օ": "o", "ս": "u", "ո": "n", "ց": "g", "հ": "h",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
INVISIBLE = "­​‌‍‎‏⁠﻿"
FOLD = str.maketrans({k: v.replace("l", "i") for k, v in (HOMOGLYPHS | DIGITS).items()} | {"l": "i"} | dict.fromkeys(INVISIBLE))
SIGN = re.compile(r"(?<![^\W_])([@$!|€]+)(?=[^\W\d_])|(?<=[^\W\d_])([@$!|€])(?=[^\W_])")
FOLDED_WORD = re.compile(r"[^\W_]+")


def folded_words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(c in text for c in SIGNS):
        text = SIGN.sub(lambda m: "".join(SIGNS[c] for c in m[2]) if m[2] else "".join(SIGNS[c] for c in m[1]) if len(m[1]) == 1 else " ", text)
    return FOLDED_WORD.findall(text.translate(FOLD))


@dataclass
class Lexicon:
    """Entries " stem" (a word's beginning) or " word " with their weights, and exception phrases of the same form."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            found.add_word(entry, (w, len(entry), entry))
        for phrase in self.exceptions:
            found.add_word(phrase, (0.0, len(phrase), ""))
        if len(found):
            found.make_automaton()
        return found


def hits(found, words: list[str]) -> dict[int, tuple[float, str]]:
    """Place of a word in the joined text -> its heaviest entry, without those in exception phrases."""
    if not len(found) or not words:
        return {}
    best: dict[int, tuple[float, str]] = {}
    spared: list[tuple[int, int]] = []
    for end, (w, n, entry) in found.iter(" " + " ".join(words) + " "):
        start = end + 1 - n
        if not entry:
            spared.append((start, end))
        elif start not in best or best[start][0] < w:
            best[start] = (w, entry)
    return {p: e for p, e in best.items() if not any(a <= p < b for a, b in spared)} if spared else best


def _automaton(lexicon: Lexicon, key: str):
    state = worker_state("toxicity")
    if state.get("lexicon", ("",))[0] != key:
        state["lexicon"] = (key, lexicon.automaton())
    return state["lexicon"][1]


def _context(words: list[str]) -> int:
    """The smallest hash of the text's three-word runs: near copies share it."""
    import xxhash

    runs = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
    return min(xxhash.xxh64_intdigest(" ".join(r)) for r in runs) - (1 << 63)


def learn_entries(train: DataFrame) -> dict[str, float]:
    """Lexicon from ``train`` (``_id``, ``_text``, ``y``). Near copies count as one document, so what a
    much-copied document says is no evidence by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        for batch in slices(batches):
            words = [folded_words(t) for t in batch.column("_text").to_pylist()]
            context = pa.array([_context(w) if w else 0 for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y"), context, pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))],
                                             names=["id", "y", "context", "words"])

    said = train.select("_id", "_text", "y").mapInArrow(run, "id long, y int, context long, words array<string>")
    one = staged(said.groupBy("y", "context").agg(F.min_by("words", "id").alias("words")), "contexts")
    n = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    toxic, clean = n.get(1, 0), n.get(0, 0)
    counts = lambda: (F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = one.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    forms = F.array_compact(F.array(F.concat(F.lit(" "), "word", F.lit(" ")), *[F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in STEMS]))
    entries = words.select(F.explode(forms).alias("entry"), "toxic", "clean").groupBy("entry").agg(*counts())
    # so often in toxic documents alone that, at their share of all, no word of a million does so by chance
    share = toxic / max(toxic + clean, 1)
    least = max(LEAST_DOCS, math.log(CHANCE) / math.log(share) if toxic and clean else 0)
    top = entries.filter((F.col("toxic") >= least) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
    found = {r["entry"]: (r["toxic"], r["clean"]) for r in top.orderBy(F.desc("toxic"), "entry").limit(MOST_ENTRIES).collect()}
    found = {e: c for e, c in found.items() if _beyond_chance(*c, share)}
    return {e: math.log((found[e][0] + 0.5) / (toxic + 1)) - math.log((found[e][1] + 0.5) / (clean + 1)) for e in _needed(found)}


def _beyond_chance(toxic: int, clean: int, share: float) -> bool:
    """Whether an entry's own counts are less likely than ``CHANCE`` where ``share`` of all documents are toxic,
    by their likelihood ratio. How many documents there are does not matter."""
    if not 0 < share < 1:
        return True
    n = toxic + clean
    ratio = (toxic * math.log(toxic / n / share) if toxic else 0) + (clean * math.log(clean / n / (1 - share)) if clean else 0)
    return toxic > n * share and -ratio <= math.log(CHANCE)


def _needed(found: dict[str, tuple[int, int]]) -> list[str]:
    """Entries without those that a longer one replaces at no loss, or a shorter one covers."""
    longer: dict[str, int] = {}
    for entry, (toxic, _) in found.items():
        for k in range(2, len(entry)):
            longer[entry[:k]] = max(longer.get(entry[:k], 0), toxic)
    kept: set[str] = set()
    for entry in sorted(found, key=len):
        if longer.get(entry, 0) < 0.95 * found[entry][0] and not any(entry[:k] in kept for k in range(2, len(entry))):
            kept.add(entry)
    return sorted(kept)


def learn_exceptions(train: DataFrame, lexicon: Lexicon) -> list[str]:
    """Phrases of an entry and the word before it, or of its whole word and the word after, that are found
    in harmless documents above all."""
    if not lexicon.weights:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        found = lexicon.automaton()
        for batch in slices(batches):
            ys, phrases = [], []
            for text, y in zip(batch.column("_text").to_pylist(), batch.column("y").to_pylist()):
                words = folded_words(text)
                joined = " " + " ".join(words) + " "
                mine = set()
                for p, (_, entry) in hits(found, words).items():
                    before = joined.rfind(" ", 0, p)
                    if before >= 0:
                        mine.add(joined[before:p] + entry)
                    end = joined.find(" ", p + 1)
                    after = joined.find(" ", end + 1)
                    if after >= 0:
                        mine.add(joined[p : after + 1])
                phrases.extend(sorted(mine))
                ys.extend([y] * len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(ys, pa.int32())], names=["phrase", "y"])

    counts = train.select("_text", "y").mapInArrow(run, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    harmless = counts.filter((F.col("clean") >= LEAST_DOCS) & (F.col("clean") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
    return [r["phrase"] for r in harmless.orderBy(F.desc("clean"), "phrase").limit(MOST_ENTRIES).collect()]


def weighed(rows: DataFrame, lexicon: Lexicon, keep: list[str], inside: int | None = None) -> DataFrame:
    """``rows`` (``_text`` and ``keep``) to ``keep``, ``weight`` (of all matches) and ``n_words``. Where the text
    is a field of ``_doc`` anyway, ``inside`` is that field's number, and it is not sent to Python twice."""
    schema = rows.select(*keep).schema.add("weight", "double").add("n_words", "long")
    key = f"{hash((tuple(sorted(lexicon.weights.items())), tuple(lexicon.exceptions)))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(lexicon, key)
        for batch in slices(batches):
            texts = batch.column("_text") if inside is None else pc.struct_field(batch.column("_doc"), [inside])
            words = (folded_words(t or "") for t in texts.to_pylist())
            got = [(math.fsum(w for w, _ in hits(found, ws).values()), len(ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())],
                                             names=[*keep, "weight", "n_words"])

    return rows.select(*keep, *(["_text"] if inside is None else [])).mapInArrow(run, schema)


def _inputs():
    """The weight, and the weight by length."""
    return F.log1p("weight"), F.log1p(100 * F.col("weight") / (F.col("n_words") + 20))


def calibrate(rows: DataFrame) -> tuple[float, float, float]:
    """Logistic coefficients from ``rows`` (``weight``, ``n_words``, ``y``), counted in cells of a grid."""
    a, b = (F.round(x * 8) / 8 for x in _inputs())
    cells = rows.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()  # a few thousand at most
    if not cells:
        return 0.0, 0.0, 0.0
    x = np.array([[1.0, r["a"], r["b"]] for r in cells])
    n, toxic = np.array([r["n"] for r in cells], float), np.array([r["toxic"] for r in cells], float)
    use = np.array([True, True, True])
    while True:
        beta = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            ridge = np.array([0.01, 0.5, 0.5])
            slope = x.T @ (toxic - n * p) - ridge * beta
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.zeros(3)
            step[use] = np.linalg.solve(curve[np.ix_(use, use)], slope[use])
            beta = beta + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        wrong = [k for k in (1, 2) if use[k] and beta[k] < 0]  # more matches never lower a score
        if not wrong:
            return tuple(float(v) for v in beta)
        use[1 if use[1] else 2] = False  # the score stays normalised by length


def _scored(docs: DataFrame, labels: DataFrame, folds: int, held: int, label: str, id_col: str, text_col: str, exceptions: tuple[str, ...],
            training_rows: int, keep: tuple[str, ...]) -> DataFrame:
    """``_doc`` (id and ``keep``), ``held_out``, ``score``."""
    fields = list(dict.fromkeys((id_col, *keep)))
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*[F.col(f"`{k}`") for k in fields]).alias("_doc"), text_or_empty(text_col).alias("_text"))
    inside = fields.index(text_col) if text_col in fields and isinstance(docs.schema[text_col].dataType, StringType) else None
    known = training_labels(labels, label, fold(id_col, folds) != held, training_rows, id_col).select(F.col(id_col).alias("_id"), "y")
    train = staged(rows.select(F.col("_id").cast("long").alias("_id"), "_text").join(F.broadcast(known), "_id"), "training")
    given = [" " + " ".join(folded_words(p)) + " " for p in exceptions]
    lexicon = Lexicon(learn_entries(train), given)
    lexicon = Lexicon(lexicon.weights, given + learn_exceptions(train, lexicon))
    base, by_weight, by_length = calibrate(weighed(train, lexicon, ["y"]))
    a, b = _inputs()
    score = 1 / (1 + F.exp(-(F.lit(base) + a * by_weight + b * by_length)))
    return weighed(rows, lexicon, ["_id", "_doc"], inside).select("_doc", (fold("_id", folds) == held).alias("held_out"), score.alias("score"))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, label: str = "toxic", threshold: float = 0.7, id_col: str = "doc_id",
           text_col: str = "text", exceptions: tuple[str, ...] = (), training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per document: id, ``held_out`` (crc32 of the id modulo ``folds`` is ``held``), ``score``,
    ``predicted``.

    Only labels of rows that are not held out are learnt, from at most about ``training_rows`` of them. Null
    and empty texts have no matches and score as any text without. Without labelled rows every score is 0.5.
    Rows with one id are scored each by its text; a null id is never a training row. ``exceptions`` are
    phrases whose words do not count. An empty table gives no rows.
    """
    out = _scored(docs, labels, folds, held, label, id_col, text_col, exceptions, training_rows, ())
    return out.select("_doc.*", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, label: str = "toxic", threshold: float = 0.7, id_col: str = "doc_id",
                  text_col: str = "text", exceptions: tuple[str, ...] = (), training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    out = _scored(docs, labels, folds, held, label, id_col, text_col, exceptions, training_rows, tuple(docs.columns))
    return out.filter(F.col("score") < threshold).select(*[F.col(f"_doc.`{c}`") for c in docs.columns])
