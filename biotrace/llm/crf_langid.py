"""Language of documents by a linear-chain conditional random field over their words.

Each word is labelled. Its features are affixes, character n-grams and the word itself (the
lexicon), hashed into a table of weights; learned transitions tie neighbouring labels.
Forward-backward gives the posterior of every label at every word, so a text that switches
between languages gets each part's own label. The document's language has the largest mean
posterior, which is its score.

The field is fitted on the driver to a bounded sample: PER_LANGUAGE documents of each
language, none longer than MAX_CHARS, taken by a hash of the id. Their words are cut into
segments and strung together across languages, so that the transitions see switches.
Every document is then labelled from its whole text, inside Spark's tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_LANGUAGE = 150
MAX_CHARS = 8_000
MAX_LANGUAGES = 200
# Words of a training sequence, and the longest segment of one language in it.
SEQUENCE, SEGMENT = 120, 40
BUCKETS = 1 << 15
STEPS = 40
RATE = 0.15
DECAY = 1e-4
# Words labelled at a time in a task, and words a task remembers.
AT_ONCE = 600_000
REMEMBERED = 300_000

UNKNOWN = "und"
# Word characters but decimal digits; numbers among them, such as fractions, are cut out.
_WORD = re.compile(r"[^\W\d_]+")

_LABELLED = "doc_id long, lang_pred string, score double"


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    apart = ("".join(c if c.isalpha() else " " for c in word).split() for word in words)
    return [part for parts in apart for part in parts]


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, affixes of up to three letters, 2- and 3-grams."""
    edged = f"^{word}$"
    names = ["w" + word]
    for n in (1, 2, 3):
        names += ["p" + word[:n], "s" + word[-n:]]
    for n in (2, 3):
        names += [edged[i : i + n] for i in range(len(edged) - n + 1)]
    return [zlib.crc32(name.encode()) % BUCKETS for name in names]


@dataclass
class Field:
    """A fitted field: labels, weights per feature and label, and transition scores."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def _emissions(flat: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[flat], starts, axis=0)


def posteriors(
    scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, transitions: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label at each word, and the expected count of each transition.

    scores has a row per word; sequence i takes sizes[i] >= 1 rows from starts[i]. All
    sequences move on together, one word at a time; the longest stand first.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    moves = np.exp(transitions - transitions.max())
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    ahead = np.empty_like(local)
    state = None
    for t in range(sizes[0]):
        at = starts[: active[t]] + t
        state = local[at] if state is None else (state[: active[t]] @ moves) * local[at]
        state /= state.sum(axis=1, keepdims=True)
        ahead[at] = state
    expected = np.zeros_like(moves)
    back = np.ones((len(starts), local.shape[1]), local.dtype)
    out = np.empty_like(local)
    for t in range(sizes[0] - 1, -1, -1):
        live = active[t]
        at = starts[:live] + t
        if t + 1 < sizes[0]:
            going = active[t + 1]
            later = local[at[:going] + 1] * back[:going]
            pairs = np.einsum("ni,ij,nj->nij", ahead[at[:going]], moves, later)
            expected += (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            later = later @ moves.T
            back[:going] = later / later.sum(axis=1, keepdims=True)
        both = ahead[at] * back[:live]
        out[at] = both / both.sum(axis=1, keepdims=True)
    return out, expected


def _sequences(texts: list[str], langs: list[str], labels: list[str]) -> tuple[list[str], np.ndarray]:
    """Words and labels of segments of all documents, shuffled together."""
    random = np.random.Generator(np.random.PCG64(9))
    segments = []
    for text, lang in zip(texts, langs, strict=True):
        words, at = words_of(text), 0
        while at < len(words):
            size = int(random.integers(3, SEGMENT + 1))
            segments.append((words[at : at + size], labels.index(lang)))
            at += size
    words, tags = [], []
    for i in random.permutation(len(segments)):
        part, tag = segments[i]
        words += part
        tags += [tag] * len(part)
    return words, np.array(tags, np.int64)


def fit(texts: list[str], langs: list[str]) -> Field | None:
    """Fit by gradient steps on the conditional likelihood; None without a labelled word."""
    labels = sorted(set(langs))
    words, tags = _sequences(texts, langs, labels)
    if not words:
        return None
    types, ids = np.unique(np.array(words, object).astype(str), return_inverse=True)
    lists = [features(word) for word in types.tolist()]
    flat = np.array([f for one in lists for f in one], np.int64)
    starts = np.cumsum([0] + [len(one) for one in lists[:-1]])
    owner = np.repeat(np.arange(len(lists)), [len(one) for one in lists])
    begins = np.arange(0, len(ids), SEQUENCE)
    sizes = np.minimum(SEQUENCE, len(ids) - begins)
    inside = np.ones(len(ids) - 1, bool)
    inside[begins[1:] - 1] = False
    n = len(labels)
    seen = np.zeros((n, n))
    np.add.at(seen, (tags[:-1][inside], tags[1:][inside]), 1)
    truth = np.zeros((len(ids), n))
    truth[np.arange(len(ids)), tags] = 1
    params = [np.zeros((BUCKETS, n)), np.zeros((n, n))]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        scores = _emissions(flat, starts, params[0])[ids]
        found, moved = posteriors(scores, begins, sizes, params[1])
        by_type = np.zeros((len(types), n))
        by_feature = np.zeros((BUCKETS, n))
        for k in range(n):
            by_type[:, k] = np.bincount(ids, truth[:, k] - found[:, k], len(types))
            by_feature[:, k] = np.bincount(flat, by_type[owner, k], BUCKETS)
        for i, gradient in enumerate((by_feature, seen - moved)):
            gradient = gradient / len(ids) - DECAY * params[i]
            first[i] = 0.9 * first[i] + 0.1 * gradient
            second[i] = 0.99 * second[i] + 0.01 * gradient**2
            scale = np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8
            params[i] += RATE * first[i] / (1 - 0.9**step) / scale
    return Field(labels, params[0].astype(np.float32), params[1].astype(np.float32))


def _label(
    batches: Iterator[pa.RecordBatch], field: Field, at: int, keep: list[int]
) -> Iterator[pa.RecordBatch]:
    """Kept columns with the label and score of the text in column `at`."""
    known: dict[str, int] = {}
    rows: list[np.ndarray] = []

    def ids_of(words: list[str]) -> np.ndarray:
        fresh = [word for word in dict.fromkeys(words) if word not in known]
        if fresh:
            lists = [features(word) for word in fresh]
            flat = np.array([f for one in lists for f in one], np.int64)
            starts = np.cumsum([0] + [len(one) for one in lists[:-1]])
            rows.append(_emissions(flat, starts, field.weights))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def posterior_means(docs: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        rows[:] = [np.concatenate(rows)]
        scores = rows[0][np.concatenate(docs)]
        found, _ = posteriors(scores, starts, sizes, field.transitions)
        return list(np.add.reduceat(found, starts, axis=0, dtype=np.float64) / sizes[:, None])

    for batch in batches:
        means: list[np.ndarray | None] = [None] * batch.num_rows
        held, places, count = [], [], 0
        for row in range(batch.num_rows + 1):
            words = words_of(batch.column(at)[row].as_py()) if row < batch.num_rows else []
            if words:
                held.append(ids_of(words))
                places.append(row)
                count += len(words)
            if held and (count >= AT_ONCE or row == batch.num_rows):
                for place, mean in zip(places, posterior_means(held), strict=True):
                    means[place] = mean
                held, places, count = [], [], 0
                if len(known) > REMEMBERED:
                    known.clear()
                    rows.clear()
        best = [UNKNOWN if m is None else field.labels[int(m.argmax())] for m in means]
        score = [0.0 if m is None else min(1.0, float(m.max())) for m in means]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], pa.array(best, pa.string()), pa.array(score, pa.float64())],
            [*[batch.schema.names[i] for i in keep], "lang_pred", "score"],
        )


def is_held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field | None:
    """Fit a field to the labelled rows that are not held out; None if there are none."""
    labelled = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).where(
        "id IS NOT NULL AND lang IS NOT NULL"
    ).where(F.length("text").between(1, MAX_CHARS) & ~is_held_out(F.col("id")))
    # Ids first: the texts of the sample alone travel.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled.select("id", "lang").withColumn("n", F.row_number().over(order))
    ids = chosen.where(F.col("n") <= PER_LANGUAGE).orderBy("n", "lang").limit(PER_LANGUAGE * MAX_LANGUAGES)
    sample = labelled.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
    rows = sample.orderBy("id", "text").limit(PER_LANGUAGE * MAX_LANGUAGES).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    `und` with score 0 for null texts and texts without a letter, and for all texts when no
    field could be fitted. Rows repeated under one id all appear; an empty table gives an
    empty result; equal posteriors go to the first label in order. Only the two named
    columns are read.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    if field is None:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return texts.mapInArrow(partial(_label, field=field, at=1, keep=[0]), _LABELLED)


def keep_known(
    docs: DataFrame, field: Field | None, least: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """docs whose text has letters and whose language scores at least `least`.

    Without a field every text with a letter stays. Columns stay as they are, whatever
    their names and types; the rows are labelled where they stand, without a shuffle.
    """
    lettered = docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    if field is None:
        return lettered
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType(
        [
            *[T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    mark = partial(_label, field=field, at=docs.columns.index(text_col), keep=list(range(len(names))))
    marked = lettered.toDF(*names).mapInArrow(mark, schema)
    known = marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return known.select(*names).toDF(*docs.columns)


def label_words(text: str, field: Field) -> list[tuple[str, str, float]]:
    """Every word of one text with its label and posterior, for code-switched texts."""
    words = words_of(text)
    if not words:
        return []
    lists = [features(word) for word in words]
    flat = np.array([f for one in lists for f in one], np.int64)
    starts = np.cumsum([0] + [len(one) for one in lists[:-1]])
    scores = _emissions(flat, starts, field.weights)
    found, _ = posteriors(scores, np.array([0]), np.array([len(words)]), field.transitions)
    return [(w, field.labels[int(p.argmax())], float(p.max())) for w, p in zip(words, found, strict=True)]
