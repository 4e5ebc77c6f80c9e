"""Quality rules: base counts, and a linear-chain CRF whose Viterbi path marks every line as content or boilerplate.

A document is the sequence of its lines with a word. A line has FEATURES numbers
(length, shares of symbols, capitals, digits, repeated words and so on), the
chain two states. The document stays, if content lines hold at least
CONTENT_SHARE of its words and the base rules don't reject it.

The CRF is fitted by maximum likelihood on a bounded sample of labelled
documents: at most TRAIN_ROWS, of at most TRAIN_BYTES each, and only rows whose
crc32(doc_id as text) mod 3 is not 1. Labels name documents, not lines, so lines
are partly supervised: those of documents of quality 1 are content; in documents
of quality 0 the states are hidden, but for one line at least that is boilerplate.
A line-by-line fit starts from all of these as boilerplate and finds those that
look like content elsewhere; then the chain is fitted, its Viterbi paths replace
the hidden states, and it is fitted again. Transitions are thus learned
from documents that have both kinds of lines. Decoding runs over every line of every whole text.

Defined cases: null text has no words (base_failed). Without labels, or with one
class alone, all lines are content, and the base rules decide. Repeated rows are
judged each. A document of very many lines is decoded as one sequence. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import U64, batch_of, conf_text_batches, grams, mix, slices, span_hashes, table, word_hashes, words
from .op9_quality_classifier import sample

TRAIN_ROWS = 1_000
TRAIN_BYTES = 60_000
CONTENT_SHARE = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Lines in a training sequence; longer documents are parted.
TRAIN_LINES = 32
STEPS = 250
RIDGE = 5e-5

BOILERPLATE, CONTENT = 0, 1
FEATURES = ["one", "log_words", "short", "symbols", "bangs", "capitals", "digits", "word_length", "ends_sentence", "again", "bars", "odd", "seen", "edge"]

_IS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"symbols": b"#*$%&|<>", "bangs": b"!?", "bars": b"|", "digits": b"0123456789", "capitals": bytes(range(65, 91)), "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 256)])}.items()}
_STOPS = np.isin(np.arange(256), list(b".!?:;\""))


class Lines:
    """Words, lines and base counts of a slice of documents."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.docs = len(offs) - 1
        self.starts, self.ends, self.first = words(data, offs)
        self.hashes = word_hashes(data, self.starts, self.ends)
        breaks = np.flatnonzero(data == 10) + 1
        edges = np.unique(np.concatenate([offs[:-1], breaks, offs[-1:]]))
        lines_from, lines_to = edges[:-1], edges[1:]
        lines_to = lines_to - ((lines_to > lines_from) & (data[lines_to - 1] == 10)) if len(lines_to) else lines_to
        word_from = np.searchsorted(self.starts, lines_from)
        word_to = np.searchsorted(self.starts, np.append(lines_from[1:], len(data))) if len(lines_from) else word_from
        full = np.flatnonzero(word_to > word_from)
        self.lines_from, self.lines_to, self.word_from, self.word_to = lines_from[full], lines_to[full], word_from[full], word_to[full]
        self.doc = np.searchsorted(offs, self.lines_from, "right") - 1
        whole = span_hashes(data, self.lines_from, self.lines_to, 11) ^ mix(self.doc.astype(U64) + U64(1))
        _, at = np.unique(whole, return_index=True)
        self.seen = np.ones(len(full), bool)  # equal to an earlier line of the document
        self.seen[at] = False
        self.n_lines = np.bincount(self.doc, minlength=self.docs)

    def base(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        n_words = np.diff(self.first)
        heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        chars = np.append(0, np.cumsum(heads[self.ends] - heads[self.starts]))
        symbols = np.append(0, np.cumsum(_IS["symbols"][data]))
        repeated = np.zeros(len(self.starts) + 1, np.int64)
        if len(self.starts) >= WINDOW:
            row = np.repeat(np.arange(self.docs), n_words)
            runs = grams(self.hashes, WINDOW, 12)
            inside = np.flatnonzero(row[: len(runs)] == row[WINDOW - 1 :])
            keys = runs[inside] ^ mix(row[inside].astype(U64) + U64(1))
            order = np.argsort(keys)
            same = keys[order[1:]] == keys[order[:-1]]
            twice = np.zeros(len(keys), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = inside[twice]
            np.add.at(repeated, at, 1)
            np.add.at(repeated, at + WINDOW, -1)
        covered = np.append(0, np.cumsum(np.cumsum(repeated[:-1]) > 0))
        return n_words, np.diff(chars[self.first]), np.diff(symbols[offs]), np.bincount(self.doc, self.seen, self.docs).astype(np.int64), np.diff(covered[self.first])

    def features(self, data: np.ndarray) -> np.ndarray:
        n = (self.word_to - self.word_from).astype(float)
        out = np.zeros((len(n), len(FEATURES)))
        if not len(n):
            return out
        sums = {name: np.append(0, np.cumsum(is_[data])) for name, is_ in _IS.items()}
        count = {name: (s[self.lines_to] - s[self.lines_from]).astype(float) for name, s in sums.items()}
        size = np.append(0, np.cumsum(self.ends - self.starts))
        size = (size[self.word_to] - size[self.word_from]).astype(float)
        again = np.zeros(len(self.hashes), bool)
        again[1:] |= self.hashes[1:] == self.hashes[:-1]
        again[2:] |= self.hashes[2:] == self.hashes[:-2]
        again = np.append(0, np.cumsum(again))
        edge = np.ones(len(n))
        edge[1:-1] = (self.doc[1:-1] != self.doc[:-2]) | (self.doc[1:-1] != self.doc[2:])
        columns = {
            "one": 1.0, "log_words": np.log1p(n) / 4, "short": n < 3, "symbols": np.minimum(count["symbols"] / n, 1), "bangs": np.minimum(count["bangs"] / n, 1),
            "capitals": count["capitals"] / np.maximum(count["letters"], 1), "digits": count["digits"] / size, "word_length": np.minimum(size / n, 30) / 10,
            "ends_sentence": _STOPS[data[self.ends[self.word_to - 1] - 1]], "again": (again[self.word_to] - again[self.word_from]) / n, "bars": np.minimum(count["bars"] / n, 1),
            "odd": 1 - count["letters"] / size, "seen": self.seen, "edge": edge,
        }
        for k, name in enumerate(FEATURES):
            out[:, k] = columns[name]
        return out


# --------------------------------------------------------------------------
# The chain


def viterbi(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best states. scores: (lines, 2), one sequence after another; all sequences take a step at a time."""
    state = np.zeros(len(scores), np.int8)
    if not len(scores):
        return state
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    start = (np.append(0, np.cumsum(lengths[np.argsort(order, kind="stable")]))[:-1])[order]
    active = int((lengths > 0).sum())
    best = scores[start[:active]].copy()
    back = np.zeros((len(scores), 2), np.int8)
    ends = np.zeros((active, 2))
    step = 1
    while active:
        done = int(np.searchsorted(-lengths[:active], -step, "right"))  # sequences that have a line `step`
        ends[:active] = best[:active]
        active = int((lengths[:active] > step).sum()) if done else 0
        if not active:
            break
        at = start[:active] + step
        options = best[:active, :, None] + transitions[None]
        back[at] = options.argmax(1)
        best[:active] = options.max(1) + scores[at]
        step += 1
    total = int((lengths > 0).sum())
    now = ends.argmax(1).astype(np.int8)
    for k in range(int(lengths[0]) - 1, -1, -1):
        n = int((lengths[:total] > k).sum())
        at = start[:n] + k
        state[at] = now[:n]
        if k:
            now[:n] = back[at, now[:n]]
    return state


class Crf:
    """Weights of the lines' features (FEATURES x 2) and of transitions (2 x 2)."""

    def __init__(self, weights: np.ndarray | None = None, transitions: np.ndarray | None = None):
        self.weights, self.transitions = weights, transitions

    def content(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(features), bool)
        return viterbi(features @ self.weights, lengths, self.transitions) == CONTENT



def _adam(params: list[np.ndarray], gradients, steps: int) -> None:
    moments = [np.zeros_like(p) for p in params for _ in range(2)]
    for step in range(1, steps + 1):
        for q, g, a, b in zip(params, gradients(), moments[::2], moments[1::2], strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


def line_weights(x: np.ndarray, y: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Logistic weights of single lines' features: positive for content."""
    w = np.zeros(x.shape[1])
    _adam([w], lambda: [x.T @ (heavy * (1 / (1 + np.exp(-(x @ w))) - y)) + RIDGE * w], 3 * STEPS)
    return w


def fit_chain(crf: Crf, x: np.ndarray, mask: np.ndarray, states: np.ndarray, heavy: np.ndarray) -> None:
    """Adam on the likelihood of the states (sequences x lines), from the weights that crf has. heavy: the sequences' weights."""
    w, t = crf.weights, crf.transitions
    n, longest = mask.shape
    truth = np.eye(2)[states] * mask[..., None]
    moves = np.einsum("nka,nkb,n->ab", truth[:, :-1], truth[:, 1:], heavy)
    flat = x.reshape(-1, x.shape[-1])

    def gradients() -> list[np.ndarray]:
        s = x @ w
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = s[:, 0]
        for k in range(1, longest):
            ahead[:, k] = np.logaddexp(ahead[:, k - 1, :1] + t[0], ahead[:, k - 1, 1:] + t[1]) + s[:, k]
        behind = np.zeros((n, longest, 2))
        for k in range(longest - 2, -1, -1):
            on = s[:, k + 1] + behind[:, k + 1]
            behind[:, k] = np.logaddexp(on[:, :1] + t[:, 0], on[:, 1:] + t[:, 1]) * mask[:, k + 1, None]
        z = np.logaddexp(*(ahead[:, 0] + behind[:, 0]).T)
        p = np.exp(ahead + behind - z[:, None, None]) * mask[..., None]
        two = np.exp(ahead[:, :-1, :, None] + t[None, None] + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        return [flat.T @ ((p - truth) * heavy[:, None, None]).reshape(-1, 2) + RIDGE * w, np.einsum("nlab,n->ab", two, heavy) - moves + RIDGE * t]

    _adam([w, t], gradients, STEPS)


def train(sequences: list[tuple[np.ndarray, int]]) -> Crf:
    """sequences: (features, quality of the document). Both qualities are as heavy as each other."""
    labels = np.array([y for _, y in sequences])
    if not len(labels) or labels.min() == labels.max():
        return Crf()
    lengths = np.array([len(f) for f, _ in sequences])
    n, longest = len(sequences), lengths.max()
    mask = (np.arange(longest) < lengths[:, None]).astype(float)
    x = np.zeros((n, longest, len(FEATURES)))
    x[mask > 0] = np.concatenate([f for f, _ in sequences])
    heavy = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / n
    hidden = (labels == 0)[:, None] & (mask > 0)

    def with_one(states: np.ndarray, content: np.ndarray) -> np.ndarray:
        """These states in documents of quality 0, where the least content-like line is boilerplate in any case; content in the others."""
        out = np.where(hidden, states, CONTENT)
        worst = np.where(mask > 0, content, np.inf).argmin(1)
        out[labels == 0, worst[labels == 0]] = BOILERPLATE
        return out

    inside = mask > 0
    each = np.repeat(heavy / np.maximum(lengths, 1), lengths)
    single = x @ line_weights(x[inside], np.repeat(labels, lengths).astype(float), each)
    states = with_one(np.where(single > -1, CONTENT, BOILERPLATE), single)
    crf = Crf(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
    for _ in range(2):
        fit_chain(crf, x, mask, states, heavy)
        path = np.full(mask.shape, CONTENT)
        path[inside] = crf.content(x[inside], lengths)
        scores = x @ crf.weights
        states = with_one(path, scores[..., CONTENT] - scores[..., BOILERPLATE])
    return crf


# --------------------------------------------------------------------------
# On Spark

_SAMPLE = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("lines", pa.binary())])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        lines = Lines(data, offs)
        f = lines.features(data).astype("<f4")
        cut = np.append(0, np.cumsum(lines.n_lines))
        yield batch_of(_SAMPLE, batch.column(0), batch.column(1), [f[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])


def fit(docs: DataFrame, labels: DataFrame) -> Crf:
    rows = sample(docs, labels, TRAIN_ROWS, TRAIN_BYTES).mapInArrow(_sample_features, "doc_id long, quality int, lines binary").collect()
    sequences = []
    for _, quality, raw in sorted(rows, key=lambda r: (r[0], r[2])):
        f = np.frombuffer(raw, "<f4").reshape(-1, len(FEATURES)).astype(float)
        sequences += [(f[a : a + TRAIN_LINES], int(quality > 0)) for a in range(0, len(f), TRAIN_LINES)]
    return train(sequences)


JUDGED = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("content_lines", pa.list_(pa.bool_()))])
JUDGED_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, content_lines array<boolean>"


def _judge(batches: Iterator[pa.RecordBatch], crf: Crf) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        lines = Lines(data, offs)
        n_words, *rest = lines.base(data, offs)
        failed = (n_words < MIN_WORDS) | (100 * rest[-1] > MAX_REPEAT_PERCENT * n_words)
        content = crf.content(lines.features(data), lines.n_lines)
        share = np.bincount(lines.doc, (lines.word_to - lines.word_from) * content, lines.docs) / np.maximum(n_words, 1)
        marks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lines.n_lines)), pa.int32()), pa.array(content))
        yield batch_of(JUDGED, batch.column(0), n_words, *rest, failed, ~failed & (share >= CONTENT_SHARE), share, marks)


def judge(docs: DataFrame, crf: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, verdict, share of content, and the state of each line with a word."""
    conf_text_batches(docs.sparkSession)
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return own.mapInArrow(lambda it: _judge(it, crf), JUDGED_SQL)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    conf_text_batches(spark)
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("content_lines")
