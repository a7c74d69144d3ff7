"""Quality classifier by co-training of two views.

The content view sees a document's words and its layout, the metadata view its other columns (language, source,
length). For each head (quality, toxicity) both views are fitted on labelled documents. Between rounds each view judges
every other document of the table where it lies, and what it is sure of teaches the other view: the metadata view gets
counts of its cells (language, source, length) by pseudo-label, the content view counts of words by pseudo-label. Only
such counts travel, combined before the shuffle. A view is sure where its probability is beyond `SURE` and `LIFT` times
the odds that any document has, so a view that knows nothing teaches nothing; all pseudo-labels together weigh `EXTRA`
times the labelled documents at most. Held-out labels then calibrate the views and combine them, and every document
is scored where it lies.

What is fitted sees at most `LABELLED` labelled documents, chosen by the smallest hashes of their ids; pseudo-labels
and scores cover all documents. Word weights are log odds of a word's presence, kept only where they are many standard
deviations from nothing; of the words that only pseudo-labels speak for, a model takes the `MODEL_WORDS` strongest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_slices, let_go, texts_of, written
from .decontaminate import words_of

LABELLED, ROUNDS, SURE, LIFT, EXTRA, MODEL_WORDS = 12_000, 3, 0.97, 3.0, 0.5, 20_000
#: Words that a task counts before it hands its counts on.
COUNTED = 200_000
#: Share of the good held-out documents that a head must keep at its threshold, where that rejects more than 0.5 does.
KEEP = 0.995
HEADS = ("quality", "toxic")
#: Heads whose content view reads the layout besides the words.
BY_LAYOUT = ("quality",)
#: Hash places of the metadata view for sources and languages.
PLACES = 64


def layout(text: str, words: list[bytes], distinct: int) -> list[float]:
    """Shares and sizes that tell prose from lists, markup and repetition."""
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    tokens = max(1, text.count(" ") + text.count("\n") + 1)
    return [
        1.0,
        math.log1p(len(words)),
        distinct / w,
        sum(map(len, words)) / w,
        sum(text.count(c) for c in "%$#&*") / n * 10,
        text.count("|") / tokens * 10,
        sum(text.count(c) for c in ".,;!?") / tokens,
        math.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
    ]


N_LAYOUT = 11
N_META = 1 + 2 * PLACES + 12


def _place(value: str | None, salt: int) -> int:
    import zlib

    return zlib.crc32(f"{salt}:{value if value is not None else ''}".encode()) % PLACES


def cell(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """Places of the language and the source, and the length in steps of its logarithm."""
    return _place(lang, 1), _place(source, 2), min(11, int(math.log1p(max(0, n_chars or 0))))


def metadata(cells: list[tuple[int, int, int]]) -> np.ndarray:
    """For each cell a one, and a one at each of its places."""
    out = np.zeros((len(cells), N_META))
    if cells:
        lang, source, step = np.array(cells).T
        rows = np.arange(len(cells))
        out[:, 0] = out[rows, 1 + lang] = out[rows, 1 + PLACES + source] = out[rows, 1 + 2 * PLACES + step] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge-penalised logistic regression by Newton steps with halving."""
    beta = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * b @ b)

    now = loss(beta)
    for _ in range(30):
        p = sigmoid(x @ beta)
        grad = x.T @ (weight * (p - y)) + ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        rate = 1.0
        while rate > 1e-4 and loss(beta - rate * step) > now:
            rate /= 2
        beta = beta - rate * step
        was, now = now, loss(beta)
        if was - now < 1e-6 * max(1.0, was):
            break
    return beta


LEAST_DOCUMENTS = 4


@dataclass
class Taught:
    """What pseudo-labels of all unlabelled documents say: counts of words and of cells by label, and their weight."""

    words: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    documents: tuple[float, float] = (0.0, 0.0)
    cells: dict[tuple[int, int, int], tuple[float, float]] = field(default_factory=dict)


def _weigh(labelled: int, documents: tuple[float, float]) -> float:
    """The weight of a pseudo-label."""
    return min(EXTRA, EXTRA * labelled / max(1.0, sum(documents)))


def word_weights(docs: list[list[bytes | None]], y: np.ndarray, weight: np.ndarray, least: float = 16.0, taught: Taught | None = None) -> dict[bytes, float]:
    """Log odds of presence, of words whose likelihood ratio against independence of the label is high."""
    ones, zeros = Counter(), Counter()
    for words, label, w in zip(docs, y, weight, strict=True):
        if w:
            (ones if label > 0.5 else zeros).update(words)
    n1, n0 = float((weight * (y > 0.5)).sum()) + 1, float((weight * (y <= 0.5)).sum()) + 1
    if taught is not None and taught.words:
        each = _weigh(int((weight > 0).sum()), taught.documents)
        n1, n0 = n1 + each * taught.documents[0], n0 + each * taught.documents[1]
        for word, (a, b) in taught.words.items():
            ones[word] += each * a
            zeros[word] += each * b
    out = {}
    share = n1 / (n1 + n0)
    for word in ones.keys() | zeros.keys():
        a, b = ones[word], zeros[word]
        if word is not None and a + b >= LEAST_DOCUMENTS and a < n1 and b < n0:
            ratio = 2 * sum(o * math.log(o / ((a + b) * e)) for o, e in ((a, share), (b, 1 - share)) if o)
            if ratio >= least:
                out[word] = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
    return out


N_WORDS = 5


def word_features(words: list[bytes], weights: dict[bytes, float]) -> list[float]:
    """Of the known words: the largest and smallest weight, the sums of each sign (damped), and their share."""
    found = [weights[w] for w in words if w in weights]
    up, down = [x for x in found if x > 0], [x for x in found if x < 0]
    n = math.sqrt(len(words) + 10)
    return [max(up, default=0.0), min(down, default=0.0), 5 * sum(up) / n, 5 * sum(down) / n, math.log1p(len(up))]


@dataclass
class Head:
    by_layout: bool = True
    words: dict[bytes, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_LAYOUT + N_WORDS))
    spread: np.ndarray = field(default_factory=lambda: np.ones(N_LAYOUT + N_WORDS))
    content: np.ndarray = field(default_factory=lambda: np.zeros(N_LAYOUT + N_WORDS))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(N_META))
    mixing: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: A document counts as 1 from here on.
    threshold: float = 0.5
    #: Log odds of any document.
    prior: float = 0.0

    def rows(self, words: list[list[bytes]], lay: np.ndarray, weights: dict[bytes, float]) -> np.ndarray:
        found = np.array([word_features(w, weights) for w in words]).reshape(len(words), N_WORDS)
        if not self.by_layout:
            lay = np.where(np.arange(N_LAYOUT) == 0, lay, 0)
        return np.concatenate([lay, found], axis=1)

    def content_logit(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.spread) @ self.content

    def probability(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return sigmoid(np.stack([np.ones(len(content)), content, meta], 1) @ self.mixing)


def _fit_content(head: Head, words: list, lay: np.ndarray, y: np.ndarray, taught: Taught | None) -> None:
    """Each half's rows use the words of the other half, so that weights aren't judged on what made them."""
    half = np.arange(len(y)) % 2 == 0
    rows = np.zeros((len(y), N_LAYOUT + N_WORDS))
    for own in (half, ~half):
        weights = word_weights(words, y, (~own).astype(float), taught=taught)
        at = np.flatnonzero(own)
        rows[at] = head.rows([words[k] for k in at], lay[at], weights)
    head.mean, head.spread = rows.mean(0), rows.std(0) + 1e-3
    head.mean[0], head.spread[0] = 0, 1
    head.content = logistic((rows - head.mean) / head.spread, y, np.ones(len(y)))
    head.words = word_weights(words, y, np.ones(len(y)), taught=taught)


class Learner:
    """One head's labelled documents; every round fits both views with what pseudo-labels teach them."""

    def __init__(self, words: list, lay: np.ndarray, meta: np.ndarray, y: np.ndarray, by_layout: bool = True, one_is_bad: bool = False):
        """y: 0, 1, or -1 for a document without this label."""
        self.words, self.lay, self.meta, self.y, self.one_is_bad = words, lay, meta, y, one_is_bad
        self.head = Head(by_layout)
        known = np.flatnonzero(y >= 0)
        share = (float((y[known] == 1).sum()) + 0.5) / (len(known) + 1)
        self.head.prior = math.log(share / (1 - share))
        #: Without both labels the head knows only how frequent they are.
        self.knows = len(known) >= 20 and len(set(y[known])) == 2
        self.head.mixing = np.array([self.head.prior, 0, 0])
        self.held = known[np.arange(len(known)) % 10 >= 7]
        self.fit_on = np.setdiff1d(known, self.held)

    def fit(self, taught: Taught | None = None) -> None:
        at = self.fit_on
        if not self.knows or len(set(self.y[at])) < 2:
            self.knows = False
            return
        _fit_content(self.head, [self.words[i] for i in at], self.lay[at], self.y[at], taught)
        x, y, weight = [self.meta[at]], [self.y[at]], [np.ones(len(at))]
        if taught is not None and taught.cells:
            counts = np.array(list(taught.cells.values()), float)
            each = _weigh(len(at), (counts[:, 0].sum(), counts[:, 1].sum()))
            rows = metadata(list(taught.cells))
            for label in (1, 0):
                x.append(rows)
                y.append(np.full(len(rows), float(label)))
                weight.append(each * counts[:, 1 - label])
        self.head.meta = logistic(np.concatenate(x), np.concatenate(y), np.concatenate(weight), ridge=3.0)

    def finish(self) -> Head:
        """Calibrates, combines and sets the threshold on the held-out documents."""
        head, held = self.head, self.held
        if not self.knows:
            return head
        y = self.y[held]
        z = np.stack([np.ones(len(held)), head.content_logit(head.rows([self.words[i] for i in held], self.lay[held], head.words)), self.meta[held] @ head.meta], 1)
        head.mixing = logistic(z, y.astype(float), np.ones(len(held)), ridge=0.1)
        p = sigmoid(z @ head.mixing)
        if self.one_is_bad:
            head.threshold = float(np.clip(np.quantile(p[y == 0], KEEP) + 1e-6, 0.1, 0.5)) if (y == 0).any() else 0.5
        else:
            head.threshold = float(np.clip(np.quantile(p[y == 1], 1 - KEEP), 0.5, 0.9)) if (y == 1).any() else 0.5
        return head


def sure_of(logit: np.ndarray, prior: float, sure: float = SURE, lift: float = LIFT) -> np.ndarray:
    """1 and 0 where a view is sure of it, else -1."""
    edge, shift = math.log(sure / (1 - sure)), math.log(lift)
    return np.where((logit >= edge) & (logit >= prior + shift), 1, np.where((logit <= -edge) & (logit <= prior - shift), 0, -1))


def _views(text: str) -> tuple[list[bytes], list[float]]:
    words = words_of(text)
    distinct = sorted(set(words))
    return distinct, layout(text, words, len(distinct))


_COLS = ("doc_id", "text", "lang", "source", "n_chars")


def _seen(part: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray, list[tuple[int, int, int]]]:
    seen = [_views(t) for t in texts_of(part.column("text"))]
    cols = [part.column(c).to_pylist() for c in ("lang", "source", "n_chars")]
    return [w for w, _ in seen], np.array([x for _, x in seen]).reshape(len(seen), N_LAYOUT), [cell(*r) for r in zip(*cols, strict=True)]


def _labelled(docs: DataFrame, labels: DataFrame, labelled: int) -> tuple:
    """Distinct words, layout, cells and labels of the labelled sample, and its ids."""
    by_hash = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(h).alias(h) for h in HEADS)).orderBy(*by_hash).limit(labelled)
    chosen = chosen.select(F.col("doc_id").alias("id"), *HEADS)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    # One row for each id, the smallest, however often an id is repeated.
    rows = rows.groupBy("id", *HEADS).agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d")).select("id", *HEADS, "d.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in (p for batch in batches for p in byte_slices(batch)):
            words, lay, cells = _seen(part)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("id", *HEADS)),
                    pa.array([b" ".join(w) for w in words], pa.binary()),
                    pa.array(lay.tolist(), pa.list_(pa.float64())),
                    pa.array([list(c) for c in cells], pa.list_(pa.int32())),
                ],
                names=["id", *HEADS, "words", "layout", "cell"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("id", *HEADS)) + ", words binary, layout array<double>, cell array<int>"
    got = rows.mapInArrow(run, schema).toPandas().sort_values(["id", "words"], kind="stable")
    # Words in fewer than four documents can't get a weight; as None they only count. The others are kept once.
    seen = Counter()
    for data in got["words"]:
        seen.update(data.split())
    frequent = {w: w for w, n in seen.items() if n >= LEAST_DOCUMENTS}
    del seen
    words = [[frequent.get(w) for w in data.split()] for data in got.pop("words")]
    lay = np.array(got["layout"].tolist(), float).reshape(len(got), N_LAYOUT)
    y = {h: np.where(got[h].isna(), -1, got[h].fillna(0) > 0).astype(float) for h in HEADS}
    return words, lay, metadata([tuple(c) for c in got["cell"]]), y, frozenset(got["id"].tolist())


def _judged(docs: DataFrame, heads: dict[str, Head], known: frozenset) -> DataFrame:
    """(head, view, key, ones, zeros): counts of all documents outside the sample by what the other view is sure of.

    View `cell`: key is lang,source,length places. View `word`: key is a word, or empty for the documents themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast((heads, known))

    def rows_of(counts: dict) -> pa.RecordBatch:
        rows = [(h, v, k, a, b) for (h, v), own in counts.items() for k, (a, b) in own.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["head", "view", "key", "ones", "zeros"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        heads, known = shared.value
        counts: dict[tuple[str, str], dict[bytes, list[int]]] = {(h, v): {} for h in heads for v in ("cell", "word")}
        for part in (p for batch in batches for p in byte_slices(batch)):
            others = [k for k, i in enumerate(part.column("doc_id").to_pylist()) if i not in known]
            words, lay, cells = _seen(part.take(pa.array(others, pa.int64())))
            meta = metadata(cells)
            for h, m in heads.items():
                by_content = sure_of(m.content_logit(m.rows(words, lay, m.words)), m.prior)
                by_meta = sure_of(meta @ m.meta, m.prior)
                own = counts[h, "cell"]
                for k in np.flatnonzero(by_content >= 0).tolist():
                    own.setdefault(b",".join(b"%d" % x for x in cells[k]), [0, 0])[1 - by_content[k]] += 1
                own = counts[h, "word"]
                for k in np.flatnonzero(by_meta >= 0).tolist():
                    at = 1 - by_meta[k]
                    for w in (b"", *words[k]):
                        own.setdefault(w, [0, 0])[at] += 1
            if sum(map(len, counts.values())) > COUNTED:
                yield rows_of(counts)
                counts = {k: {} for k in counts}
        yield rows_of(counts)

    each = docs.mapInArrow(run, "head string, view string, key binary, ones long, zeros long")
    return each.groupBy("head", "view", "key").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def _taught(docs: DataFrame, learners: dict[str, Learner], known: frozenset, least: float = 16.0) -> dict[str, Taught]:
    heads = {h: x.head for h, x in learners.items() if x.knows}
    out = {h: Taught() for h in learners}
    if not heads:
        return out
    counts = written(_judged(docs, heads, known), "taught")
    for r in counts.where("view = 'cell'").collect():  # at most 64 * 64 * 12 for each head
        out[r["head"]].cells[tuple(map(int, bytes(r["key"]).split(b",")))] = (r["ones"], r["zeros"])
    for r in counts.where("view = 'word' and key = X''").collect():
        out[r["head"]].documents = (r["ones"], r["zeros"])
    for h, head in heads.items():
        n1, n0 = out[h].documents
        if not n1 and not n0:
            continue
        each, share = _weigh(len(learners[h].fit_on), (n1, n0)), (n1 + 1) / (n1 + n0 + 2)
        a, b = F.col("ones"), F.col("zeros")
        ratio = sum(F.when(o > 0, o * F.log(o / ((a + b) * F.lit(e)))).otherwise(F.lit(0.0)) for o, e in ((a, share), (b, 1 - share)))
        words = counts.where((F.col("head") == h) & (F.col("view") == "word") & (F.col("key") != F.lit(b""))).withColumn("ratio", 2 * each * ratio)
        strong = words.where((F.col("ratio") >= least) & (each * (a + b) >= LEAST_DOCUMENTS)).orderBy(F.desc("ratio"), "key").limit(MODEL_WORDS)
        # By Arrow, as rows would go through a Python worker of another kind, which executors then keep.
        in_model = docs.sparkSession.createDataFrame(pa.table({"key": pa.array(list(head.words), pa.binary())}))
        both = strong.select("key", "ones", "zeros").union(words.join(F.broadcast(in_model), "key", "left_semi").select("key", "ones", "zeros"))
        out[h].words = {bytes(r["key"]): (r["ones"], r["zeros"]) for r in both.collect()}
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, Head]:
    """Heads fitted on a bounded labelled sample and on the counts that all other documents give.

    What comes to the driver: a row of distinct words for each sampled document; cells; the words of the models.
    """
    bounded_batches(docs.sparkSession)
    words, lay, meta, y, known = _labelled(docs, labels, labelled)
    learners = {h: Learner(words, lay, meta, y[h], h in BY_LAYOUT, h == "toxic") for h in HEADS}
    taught: dict[str, Taught | None] = dict.fromkeys(HEADS)
    for k in range(rounds):
        for h, learner in learners.items():
            learner.fit(taught[h])
        if k + 1 < rounds:
            taught = _taught(docs, learners, known)
    return {h: learner.finish() for h, learner in learners.items()}


def _score_batch(part: pa.RecordBatch, heads: dict[str, Head]) -> dict[str, np.ndarray]:
    words, lay, cells = _seen(part)
    meta = metadata(cells)
    # Rounded, as the order of sums in a product of matrices may depend on where a row stands.
    return {h: np.round(m.probability(m.content_logit(m.rows(words, lay, m.words)), meta @ m.meta), 9) for h, m in heads.items()}


def keeps(p: dict[str, np.ndarray], heads: dict[str, Head]) -> np.ndarray:
    return (p["quality"] >= heads["quality"].threshold) & (p["toxic"] < heads["toxic"].threshold)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic and keep for every document.

    Null texts count as empty, null metadata as a value of its own. Labels may be missing, repeated (the larger
    value holds) or null (then unlabelled for that head); without labels of both kinds a head returns their share.
    """
    picked = docs.select(*_COLS)
    heads = docs.sparkSession.sparkContext.broadcast(train(picked, labels.select("doc_id", *HEADS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in (p for batch in batches for p in byte_slices(batch)):
            p = _score_batch(part, heads.value)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(p["quality"]), pa.array(p["toxic"]), pa.array(keeps(p, heads.value))],
                names=["doc_id", "p_quality", "p_toxic", "keep"],
            )

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, p_quality double, p_toxic double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject; all columns stay, whatever their names.

    Null and empty texts are judged by their metadata and an empty layout; repeated rows are judged alike and all stay
    or go; without labels of both kinds only their share decides. An empty table gives no rows.
    """
    heads = docs.sparkSession.sparkContext.broadcast(train(docs.select(*_COLS), labels.select("doc_id", *HEADS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in (p for batch in batches for p in byte_slices(batch)):
            yield part.filter(pa.array(keeps(_score_batch(part, heads.value), heads.value)))

    return docs.mapInArrow(run, docs.schema)
